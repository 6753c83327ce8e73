"""Finding stretches that satisfy performance conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.config import StateFilter
from procmon.functions.columns import col, is_finite, require_columns, to_number, within
from procmon.operators.runs import longest_runs, runs

LONGEST = 10


def _filters(conditions: Sequence[Mapping]) -> list[StateFilter]:
    """Performance conditions are range filters; bounds may come as text, blank for none."""
    number = lambda v: None if v is None or (isinstance(v, str) and not v.strip()) else float(v)
    filters = [StateFilter(str(c.get("column", "")).strip(), number(c.get("minimum")), number(c.get("maximum"))) for c in conditions]
    if not filters or len({f.column for f in filters}) < len(filters):
        raise ValueError("performance conditions must name at least one column, and each once")
    return filters


def screen(
    df: DataFrame,
    conditions: Sequence[Mapping],
    interval_us: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    width: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, rows matched per condition, longest matching runs).

    All conditions must hold. A missing or infinite performance value is an error.
    """
    checked = [(f.column, f.minimum, f.maximum) for f in _filters(conditions)]
    require_columns(df, [*keys, ts, *[name for name, _, _ in checked]])
    key_cols = [col(k) for k in keys]
    flags = []
    for i, (name, low, high) in enumerate(checked):
        value = to_number(df, name)
        fail = F.raise_error(F.lit(f"performance column {name} must hold finite numbers")).cast("boolean")
        flags.append(F.when(is_finite(value), within(value, low, high)).otherwise(fail).alias(f"ok{i}"))
    marked = df.select(*key_cols, col(ts).alias("ts"), *flags)
    together = reduce(lambda a, b: a & b, [F.col(f"ok{i}") for i in range(len(checked))])
    counted = marked.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(together).alias("matched_rows"),
        F.avg(together.cast("double")).alias("match_share"),
        *[F.count_if(F.col(f"ok{i}")).alias(f"n{i}") for i in range(len(checked))],
    )
    per_condition = counted.select(
        *key_cols,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.lit(low).cast("double").alias("minimum"),
                        F.lit(high).cast("double").alias("maximum"),
                        F.col(f"n{i}").alias("matched_rows"),
                    )
                    for i, (name, low, high) in enumerate(checked)
                ]
            )
        ),
    )
    totals = counted.drop(*[f"n{i}" for i in range(len(checked))])
    found = runs(marked.where(together), interval_us, keys=keys, width=width)
    return totals, per_condition, longest_runs(found, LONGEST, keys=keys)
