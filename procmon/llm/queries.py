"""The operators applied to whole tables with production parameters, and their DuckDB equivalents."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from procmon.catalog.registry import query
from procmon.llm import (
    bag_minhash, bottom_k, context_tree, cross_polytope, exact_dedup, language_id, merkle, mixing, pieces, repeats, subvectors, toxicity, url_filter,
)
from procmon.llm.common import fold, read, stored

# ---------------------------------------------------------------- sources to target weights

MIX_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), ''))) - 1 AS pos FROM documents
), sized AS (
  SELECT source, count(*) AS n_docs, (count(*) + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS} AS n FROM documents GROUP BY source
), sources AS (
  -- The weight as a whole number of parts: release floor(k L / a), deadline ceil((k + 1) L / a), L the sum of a over the sources with blocks left.
  SELECT source, n, greatest(1, CAST(round(pow(n_docs, {mixing.POWER}) / sum(pow(n_docs, {mixing.POWER})) OVER () * {mixing.PARTS}) AS HUGEINT)) AS a,
    row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM sized
), one AS (SELECT list({{'n': n, 'a': a}} ORDER BY i) AS s, sum(n) AS slots, CAST(sum(a) AS HUGEINT) AS total FROM sources
), steps AS (
  SELECT s, slots, CAST(-1 AS BIGINT) AS t, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS done, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS had,
    CAST(0 AS BIGINT) AS since, total, CAST(0 AS BIGINT) AS p FROM one WHERE slots > 0
  UNION ALL
  SELECT s, slots, t, now, CASE WHEN now[p] < s[p].n THEN had ELSE now END, CASE WHEN now[p] < s[p].n THEN since ELSE t + 1 END,
    CASE WHEN now[p] < s[p].n THEN total ELSE CAST(coalesce(list_sum(list_transform(s, lambda x, i: CASE WHEN now[i] < x.n THEN x.a ELSE 0 END)), 0) AS HUGEINT) END, p
  FROM (SELECT *, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END) AS now FROM (
    SELECT s, slots, t + 1 AS t, done, had, since, total, CAST(list_min(list_transform(s, lambda x, i:
      CASE WHEN done[i] < x.n AND ((done[i] - had[i]) * total) // x.a <= t + 1 - since
        THEN (((done[i] - had[i] + 1) * total + x.a - 1) // x.a) * 100000 + i ELSE CAST(9000000000000000000 AS HUGEINT) END)) % 100000 AS BIGINT) AS p
    FROM steps WHERE t < slots - 1))
), turns AS (SELECT t AS slot, p AS i, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS block FROM steps WHERE t >= 0)
SELECT d.doc_id, d.source, CAST(t.block AS BIGINT) AS block, t.slot, CAST(d.pos % {mixing.BLOCK_DOCS} AS INTEGER) AS place
FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source JOIN turns t ON t.i = s.i AND t.block = d.pos // {mixing.BLOCK_DOCS}
"""


@query("op4_mix_sources", MIX_SQL)
def op4_mix_sources(spark, sf_dir):
    """Documents of all sources interleaved; weights follow the square root of the source's size."""
    rows = mixing.interleave(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


# ---------------------------------------------------------------- exact copies


@query(
    "op6_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
      doc_id = keep_id AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)
    """,
)
def op6_exact_dedup(spark, sf_dir):
    """All documents against a new index, in four ranges of doc_id: the later ones meet the stored digests of the earlier ones."""
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark), parts=4)


# ---------------------------------------------------------------- pages by their URLs

# Host and path of the listed rules, and whether they allow.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Words of hosts that are blocked where no listed rule fits.
URL_WORDS = ["spam-farm", "cheap-pills", "casino", "malware", "phishing", "adult-only", "free-money"]


def _url_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
    ranked = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ranked)
    words = " OR ".join(f"regexp_matches(host, '(^|[.-]){w}([.-]|$)')" for w in URL_WORDS)
    return f"""
    WITH raw AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM raw)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {words} THEN 'block' ELSE 'allow' END AS verdict FROM p
    """


@query("op10_url_filter", _url_sql())
def op10_url_filter(spark, sf_dir):
    """All pages judged by the listed rules, then by the blocked words."""
    rules = [url_filter.host_rule(*r) for r in URL_RULES] + [url_filter.word_rule(w) for w in URL_WORDS]
    return url_filter.judge(read(spark, sf_dir, "pages"), rules)


# ---------------------------------------------------------------- language and toxicity


@query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 4).alias("part"))
    model = language_id.train(docs.where("part <> 2"))
    return language_id.identify(docs.withColumn("held_out", F.col("part") == 2), model, keep=("doc_id", "held_out"))


def toxicity_model(spark, docs, sf_dir):
    """Learned from the labelled documents outside the held-out fifth."""
    return toxicity.train(docs.select("doc_id", "text").where(fold("doc_id", 5) != 0), read(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity.score(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# ---------------------------------------------------------------- language-model scores


@query("op1_context_tree")
def op1_context_tree(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    return context_tree.score_documents(docs, "held_out")


# ---------------------------------------------------------------- near-duplicate embeddings


@query(
    "op3_near_embeddings",
    """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL),
    u AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
    r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
    k AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY 1),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM k LEFT JOIN n USING (vec_id)
    """,
)
def op3_near_embeddings(spark, sf_dir):
    return cross_polytope.near_duplicates(read(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- near-duplicate documents


@query(
    "op2_near_documents",
    r"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
    c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY 1, 2),
    z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
    r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a),
    k AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, component_id, count(*) OVER (PARTITION BY component_id) AS group_size, doc_id = component_id AS kept FROM k
    """,
)
def op2_near_documents(spark, sf_dir):
    return bag_minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("row")


# ---------------------------------------------------------------- repeated passages


@query(
    "op8_repeats",
    """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS bin, hex(encode(coalesce(text, ''))) AS h FROM documents),
    i AS (SELECT rid, bin, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400),
    w AS (SELECT rid, i, md5(bin[i + 1:i + 200]) AS k FROM i),
    e AS (SELECT rid, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    f AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i) > 200, true) AS new FROM e),
    g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY rid ORDER BY i) AS run FROM f),
    spans AS (SELECT rid, run, min(i) AS b, max(i) + 200 AS e FROM g GROUP BY 1, 2),
    cut AS (SELECT rid, b, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS z FROM spans),
    parts AS (SELECT d.rid, string_agg(substr(h, 2 * z + 1, 2 * (b - z)), '' ORDER BY b) AS kept, max(e) AS last, sum(e - b) AS gone, count(*) AS runs
      FROM d JOIN cut USING (rid) GROUP BY 1)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN parts USING (rid)
    """,
)
def op8_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- pieces


def coded(docs, keep=("doc_id",)):
    """Ids of all texts, their number, and the SHA-256 of the text that the ids decode to."""
    rows = pieces.encode(docs, pieces.model_bytes(), keep=keep, digest="decoded_sha256")
    return rows.select(*keep, "ids", F.size("ids").alias("n_ids"), "decoded_sha256")


@query("op5_pieces")
def op5_pieces(spark, sf_dir):
    return coded(read(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- manifest of the documents


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a string in DuckDB, from its hexadecimal bytes, bit by bit."""
    bit = "(CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    eight = "c"
    for _ in range(8):
        eight = f"list_transform([{eight}], lambda c: {bit})[1]"
    step = eight.replace("[c]", "[xor(c, b)]", 1)
    bytes_of = f"list_transform(range(0, octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _merkle_sql(levels: int = 14) -> str:
    """Trees with up to 3 ** levels leaves a source and as many sources."""
    value = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: f"sha256({' || '.join(map(value, fields))} || {value(text)})"
    parts = []

    def tree(name: str, start: str) -> None:
        """Levels name0, name1, ... of (g, pos, h, n) with the siblings to the left and to the right of each node."""
        parts.append(f"{name}0 AS ({start})")
        for k in range(levels):
            run = "PARTITION BY g, pos // 3"
            near = lambda side: f"coalesce(string_agg(h, '') OVER ({run} ORDER BY pos ROWS BETWEEN {side}), '')"
            parts.append(
                f"{name}s{k} AS (SELECT g, pos, h, n, CASE WHEN n > 1 THEN {near('UNBOUNDED PRECEDING AND 1 PRECEDING')} ELSE '' END AS l, "
                f"CASE WHEN n > 1 THEN {near('1 FOLLOWING AND UNBOUNDED FOLLOWING')} ELSE '' END AS r FROM {name}{k})"
            )
            parts.append(
                f"{name}{k + 1} AS (SELECT g, pos // 3 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, "
                f"(any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, pos // 3)"
            )

    def climb(name: str, before: str, out: str) -> None:
        """From rows (i, g, pos, fold, proof): the same at the top of their tree."""
        parts.append(f"{out}0 AS ({before})")
        for k in range(levels):
            parts.append(
                f"{out}{k + 1} AS (SELECT i, c.g, c.pos // 3 AS pos, CASE WHEN s.n > 1 THEN sha256(s.l || c.fold || s.r) ELSE c.fold END AS fold, c.proof || s.l || s.r AS proof "
                f"FROM {out}{k} c JOIN {name}s{k} s ON s.g = c.g AND s.pos = c.pos)"
            )

    parts.append(
        f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 "
        f"THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now, coalesce('=' || source, '-') AS g FROM documents)"
    )
    parts.append("o AS (SELECT row_number() OVER () AS i, doc_id, leaf, now, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)")
    tree("a", "SELECT g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM o")
    parts.append(f"sub AS (SELECT g AS source, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM a{levels})")
    tree("b", "SELECT 0 AS g, pos, h, count(*) OVER () AS n FROM sub")
    climb("a", "SELECT i, g, pos, now AS fold, '' AS proof FROM o", "c")
    climb("b", f"SELECT i, 0 AS g, s.pos, c.fold, c.proof FROM c{levels} c JOIN sub s ON s.source = c.g", "e")
    return f"""
    WITH {", ".join(parts)}
    SELECT o.doc_id, o.leaf, s.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = t.h AS verified
    FROM o JOIN sub s ON s.source = o.g JOIN e{levels} e ON e.i = o.i CROSS JOIN b{levels} t
    """


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    """The manifest of all documents; half of them are tampered with and folded to a root again."""
    docs = read(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.when(fold("doc_id", 2) == 0, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    rows = merkle.manifest(docs, "doc_id", "source", leaf(F.col("text")), {"now": tampered})
    siblings = F.array_join(F.flatten(F.transform("proof", lambda level: level["siblings"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), merkle.folded(F.col("proof"), F.col("now")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# ---------------------------------------------------------------- clusters of embeddings


def _clusters_sql(rounds: int = 3) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
    m{k} AS (SELECT v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v CROSS JOIN c{k} c),
    a{k} AS (SELECT vec_id, x, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM m{k} GROUP BY vec_id, x),
    s{k} AS (SELECT cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY cluster, i),
    c{k + 1} AS (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{k} c LEFT JOIN (
      SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY cluster) n USING (cluster))""")
    return f"""
    WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    v AS (SELECT vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS x FROM f
      WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster, x FROM v QUALIFY cluster < 16),{",".join(steps)}
    SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
    """


@query("op11_subvector_clusters", _clusters_sql())
def op11_subvector_clusters(spark, sf_dir):
    """All embeddings of 64 components, as whole numbers, in 16 clusters after three rounds."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    assigned, centroids = subvectors.cluster(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 16, 3, order, 64.0)
    rows = subvectors.with_inertia(stored(assigned, "assigned"))
    # At most 16 digests.
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.get(F.array(*map(F.lit, digests)), F.col("cluster")) if digests else F.lit(None).cast("string")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", of.alias("centroid_sha256"))


# ---------------------------------------------------------------- fingerprints

_TERMS = lambda at: " + ".join(f"coalesce(w[{at} + {j}] * {c}, 0)" for j, c in enumerate(bottom_k.FACTORS))
_SKETCH_SQL = (
    "list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] "
    f"WHEN len(w) < {bottom_k.WORDS} THEN [({_TERMS(1)}) % {bottom_k.PRIME}] "
    f"ELSE list_transform(range(1, len(w) - {bottom_k.WORDS - 2}), lambda i: ({_TERMS('i')}) % {bottom_k.PRIME}) END))[1:{bottom_k.K}]"
)
_LIKE_SQL = (
    "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE (SELECT count(*) FILTER (list_contains({0}, h) AND list_contains({1}, h)) / count(*) "
    f"FROM (SELECT h FROM (SELECT unnest(list_distinct(list_concat({{0}}, {{1}}))) AS h) ORDER BY h LIMIT {bottom_k.K})) END"
)
FINGERPRINT_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS i, doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
e AS (SELECT a.i, a.doc_id, b.doc_id AS next_doc_id, a.n, a.t, b.i AS j, substr(a.t, 1, CAST(a.n - a.n // 4 AS BIGINT)) || substr(b.t, 1, CAST(a.n // 4 AS BIGINT)) AS u
  FROM d a JOIN d b ON b.i = a.i % (SELECT count(*) FROM d) + 1),
texts AS (SELECT i, 0 AS side, t FROM e UNION ALL SELECT i, 1, u FROM e),
split AS (SELECT i, side, list_filter(string_split_regex(translate(t, '{bottom_k.UPPER}', '{bottom_k.LOWER}'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS s FROM texts),
each AS (SELECT i, side, unnest(s) AS word, unnest(range(len(s))) AS nth FROM split),
known AS (SELECT word, {_crc32_sql('word')} AS c FROM (SELECT DISTINCT word FROM each)),
coded AS (SELECT i, side, list(c ORDER BY nth) AS w FROM each JOIN known USING (word) GROUP BY i, side),
sketched AS (SELECT i, side, {_SKETCH_SQL} AS s FROM coded),
met AS (SELECT e.*, coalesce(x.s, []) AS a, coalesce(y.s, []) AS b, coalesce(z.s, []) AS c FROM e
  LEFT JOIN sketched x ON x.i = e.i AND x.side = 0 LEFT JOIN sketched y ON y.i = e.i AND y.side = 1 LEFT JOIN sketched z ON z.i = e.j AND z.side = 0)
SELECT doc_id, n AS n_chars, sha256(u) AS edited_sha256, coalesce(array_to_string(list_transform(a, lambda h: printf('%016x', h)), ''), '') AS fingerprint,
  coalesce(array_to_string(list_transform(b, lambda h: printf('%016x', h)), ''), '') AS edited_fingerprint, {_LIKE_SQL.format('a', 'b')} AS near_edited, {_LIKE_SQL.format('a', 'c')} AS near_next, next_doc_id
FROM met
"""


@query("op13_bottom_k", FINGERPRINT_SQL)
def op13_bottom_k(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    rows = bottom_k.followed(read(spark, sf_dir, "documents"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("start"))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_sketch", "next_key")
    rows = rows.select("*", bottom_k.sketch(F.col("text")).alias("own"), bottom_k.sketch(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        bottom_k.as_text(F.col("own")).alias("fingerprint"), bottom_k.as_text(F.col("other")).alias("edited_fingerprint"),
        bottom_k.resemblance(F.col("own"), F.col("other")).alias("near_edited"), bottom_k.resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        F.col("next_key").alias("next_doc_id"),
    )
