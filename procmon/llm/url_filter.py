"""URL filtering: rules indexed by their rarest literal token, regular expressions only on candidates.

A rule is (rule, verdict, pattern, literals): a regular expression over `host path`, and the literal
tokens that every URL it fits must contain. Each rule is filed under whichever of its literals is
rarest in the URLs at hand. The tokens of a URL fetch the rules filed under them, and only those
rules run their expressions. Rules without a literal meet every URL.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: what
follows the host up to `?`, `#` or the end. A null URL and one without `://` have both empty.
The longest fitting rule wins; among equally long ones block wins, then the smaller text. Without
a host rule the pattern rules decide (block if one fits), and without those the URL is allowed.
Repeated rows are judged like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rule table travels with a broadcast hint only up to this many rules of at most RULE_CHARS.
BROADCAST_RULES = 100_000
RULE_CHARS = 500
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """`listed` rules are reported by name; the others only decide where no listed rule fits."""

    rule: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = field(default=())
    listed: bool = True


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`.

    A literal is a run of letters and digits with a boundary on both sides; the end of `path` is
    open, so what touches it is no literal.
    """
    closed = re.findall(TOKEN, host.lower()) + [m[0] for m in re.finditer(TOKEN, path.lower()) if m.end() < len(path)]
    pattern = rf"^(?:[^ ]*\.)?{_quoted(host.replace(' ', '#'))} {_quoted(path)}"
    return Rule(host + path, verdict, pattern, tuple(dict.fromkeys(closed)))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """Fits where the host holds the word, bounded by dots, hyphens or the ends."""
    return Rule(word, verdict, rf"^(?:[^ ]*[.-])?{_quoted(word.replace(' ', '#'))}(?:[.-][^ ]*)? ", tuple(re.findall(TOKEN, word)), False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/ -])", r"\\\1", text)


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _filed(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its rarest literal as `token`; null if it has none."""
    literal = rules.select("rule_no", F.explode_outer("literals").alias("token"))
    counts = tokens.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rated = literal.join(counts, "token", "left").groupBy("rule_no").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    return rules.join(rated, "rule_no").drop("literals")


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row of `pages`."""
    spark = pages.sparkSession
    schema = "rule_no int, rule string, verdict string, pattern string, literals array<string>, listed boolean"
    table = spark.createDataFrame([(i, r.rule, r.verdict, r.pattern, list(r.literals), r.listed) for i, r in enumerate(rules)], schema)
    small = len(rules) <= BROADCAST_RULES and all(len(r.pattern) <= RULE_CHARS for r in rules)
    sized = F.broadcast if small else (lambda df: df)
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    # Equal URLs are judged once; the answer depends on host and path alone.
    parts = own.select("_key", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    known = parts.select("host", "path").distinct()
    tokens = known.select(
        "host", "path", F.explode(F.array_distinct(F.expr(rf"regexp_extract_all(lower(concat(host, ' ', path)), '{TOKEN}', 0)"))).alias("token")
    )
    filed = _filed(tokens.select("token"), table)
    # Patterns take the first blank as the end of the host; blanks inside a host become '#', which no host holds.
    fits = F.expr("concat(translate(host, ' ', '#'), ' ', path) rlike pattern")
    indexed = tokens.join(sized(filed.where("token is not null")), "token").where(fits)
    shape = ["host", "path", "rule", "verdict", "listed"]
    met = indexed.select(*shape)
    if any(not r.literals for r in rules):
        # Few by nature: what has no literal is compared with every URL, in the order of the rule list.
        loose = [r for r in rules if not r.literals]
        each = F.array(*[
            F.when(F.concat(F.translate("host", " ", "#"), F.lit(" "), "path").rlike(r.pattern), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed")))
            for r in loose
        ])
        met = met.unionByName(known.select("host", "path", F.explode(F.array_compact(each)).alias("r")).select("host", "path", "r.*"))
    rank = F.struct(
        F.when(F.col("listed"), -F.length("rule")).otherwise(F.lit(1)).alias("longest"),
        F.when(F.col("verdict") == "block", 0).otherwise(1).alias("first"),
        "rule", "verdict", "listed",
    )
    best = met.groupBy("host", "path").agg(F.min(rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path",
        F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )
