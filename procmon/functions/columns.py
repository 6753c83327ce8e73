"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.config import MINUTE

INF = float("inf")

# What stands between tag and lag in a feature's name, and after the lag.
LAG_MARK, LAG_UNIT = "__lag_", "min"

# Statuses by severity, and the reasons a row may stay unscored.
STATUSES = ("normal", "attention", "abnormal")
NOT_SCORED = "not_scored"
INVALID_REASONS = (
    "warming_up",
    "insufficient_context",
    "missing_input",
    "non_finite_input",
    "sampling_mismatch",
    "time_gap_reset",
)


def col(name: str) -> Column:
    """A column by its literal name; plant tags often contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in dict.fromkeys(names) if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def refused(message: str, kind: str) -> Column:
    """A value of the given type that stops the query with a message where it is evaluated."""
    return F.raise_error(F.lit(message)).cast(kind)


def given(value: Column, kind: str, message: str) -> Column:
    """The value, refusing NULLs with a message.

    The last value is never reached. It tells the planner that there are no NULLs, which would otherwise test every join
    key before the grouping below it, with the whole expression copied into the test.
    """
    return F.coalesce(value, refused(message, kind), F.lit("0").cast(kind) if kind != "string" else F.lit(""))


# Types of which "0" or an empty text is a value.
_SIMPLE = ("string", "tinyint", "smallint", "int", "bigint", "float", "double")


def present(df: DataFrame, name: str) -> Column:
    """The column, refusing NULLs: keys and times that name no row would be lost in joins and comparisons."""
    kind = df.schema[name].dataType.simpleString()
    if kind in _SIMPLE:
        return given(col(name), kind, f"{name} must not be null")
    return F.when(col(name).isNull(), refused(f"{name} must not be null", kind)).otherwise(col(name))


# ---- numbers -------------------------------------------------------------------------


def to_number(df: DataFrame, name: str) -> Column:
    """The column as a double; unparsable text and NaN become NULL, infinities stay."""
    data_type = df.schema[name].dataType
    value = col(name)
    if isinstance(data_type, T.StringType):
        value = F.expr(f"try_cast(trim(`{name.replace('`', '``')}`) AS DOUBLE)")
    elif isinstance(data_type, T.BooleanType):
        value = value.cast("int").cast("double")
    else:
        value = value.cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def is_finite(value: Column) -> Column:
    """True for an ordinary number, false for NULL, NaN and infinities."""
    return F.coalesce(F.abs(value) < F.lit(INF), F.lit(False))


def all_finite(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(v) for v in values], F.lit(True))


def is_blank(value: Column) -> Column:
    return F.trim(value) == ""


def within(value: Column, lower: float | None, upper: float | None) -> Column:
    """Closed range test; NULL is outside."""
    inside = value.isNotNull()
    if lower is not None:
        inside = inside & (value >= F.lit(float(lower)))
    if upper is not None:
        inside = inside & (value <= F.lit(float(upper)))
    return inside


def outside(value: Column, lower: float, upper: float) -> Column:
    """True for a finite value below `lower` or above `upper`."""
    return is_finite(value) & ((value < F.lit(float(lower))) | (value > F.lit(float(upper))))


def range_deviation(value: Column, lower: float, upper: float) -> Column:
    """Distance from the closed target range, 0 inside it."""
    return F.greatest(F.lit(float(lower)) - value, value - F.lit(float(upper)), F.lit(0.0))


def near_integer(ratio: Column) -> Column:
    """Whether a ratio is a whole number up to rounding (relative 1e-5, absolute 1e-8)."""
    whole = F.rint(ratio)
    return F.abs(ratio - whole) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(whole)


def is_close(a: Column, b: Column, rel: float, abs_tol: float) -> Column:
    """Equal up to `abs_tol + rel * |b|`; two NULLs are equal."""
    close = F.abs(a - b) <= F.lit(abs_tol) + F.lit(rel) * F.abs(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


# ---- time ----------------------------------------------------------------------------


DAY_US = 24 * 60 * MINUTE


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a naive time, by its day and the time since midnight: no time zone takes part.

    An interval turns into a whole number by its seconds; a day of microseconds, taken as seconds, fits.
    """
    naive = ts.cast("timestamp_ntz")
    day = naive.cast("date")
    since = (naive - day.cast("timestamp_ntz")) * F.lit(1_000_000)
    return F.unix_date(day).cast("long") * DAY_US + since.cast("interval second").cast("long")


def from_micros(us: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return epoch + F.expr("INTERVAL '0.000001' SECOND") * us.cast("long")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def bucket_label(us: Column, width: int) -> Column:
    """Right end of the right-closed, epoch-anchored bucket that holds `us`."""
    return us + F.pmod(-us, F.lit(width))


def minutes(us: Column) -> Column:
    return us / F.lit(float(MINUTE))


def covered_minutes(start_us: Column, end_us: Column, interval_us: int) -> Column:
    """Elapsed minutes plus one sampling interval."""
    return F.round(minutes(end_us - start_us + F.lit(interval_us))).cast("long")


# ---- features and statuses -----------------------------------------------------------


def feature_name(tag: str, lag: int) -> str:
    return f"{tag}{LAG_MARK}{lag:03d}{LAG_UNIT}"


def parse_feature(name: str) -> tuple[str, int]:
    tag, _, lag = name.rpartition(LAG_MARK)
    digits = lag.removesuffix(LAG_UNIT)
    if not tag or digits == lag or not digits.isdecimal():
        raise ValueError(f"not a dynamic feature name: {name}")
    return tag, int(digits)


def severity(value: Column, limit_95: float, limit_99: float) -> Column:
    return F.when(value >= F.lit(limit_99), 2).when(value >= F.lit(limit_95), 1).otherwise(0)


def status_of(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), code + 1)


def append_columns(df: DataFrame, compute, fields: Sequence[T.StructField]) -> DataFrame:
    """Add columns computed from Arrow batches; `compute` maps a pandas batch to a dict.

    Columns travel under neutral names, as dotted ones cannot be passed to Python.
    """
    names = df.columns
    safe = [f"c{i}" for i in range(len(names))]
    added = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            values = compute(batch.set_axis(names, axis=1))
            yield batch.assign(**{n: values[n] for n in added})

    renamed = df.toDF(*safe)
    result = renamed.mapInPandas(run, T.StructType([*renamed.schema.fields, *fields]))
    return result.toDF(*names, *added)
