"""Small literal series for the tests."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

DAY = datetime(2026, 1, 1)


def at(text):
    hour, minute = text.split(":")
    return DAY + timedelta(hours=int(hour), minutes=int(minute))


def series(spark, times, series_id="s", start=DAY, **columns):
    """Readings with `times` in minutes after `start` (or "HH:MM") and the given columns."""
    names = list(columns)
    fields = [T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    for name in names:
        text = any(isinstance(v, str) for v in columns[name])
        fields.append(T.StructField(name, T.StringType() if text else T.DoubleType()))
    rows = []
    for i, t in enumerate(times):
        ts = at(t) if isinstance(t, str) else start + timedelta(minutes=t)
        values = [columns[n][i] for n in names]
        typed = [
            None if v is None else (str(v) if isinstance(f.dataType, T.StringType) else float(v))
            for v, f in zip(values, fields[2:])
        ]
        rows.append((series_id, ts, *typed))
    return spark.createDataFrame(rows, T.StructType(fields))


def by_time(df, *columns):
    """{HH:MM: value or tuple} of a result, ordered by time."""
    rows = df.select("ts", *[f"`{c}`" for c in columns]).orderBy("ts").collect()
    out = {}
    for row in rows:
        values = tuple(row)[1:]
        out[row["ts"].strftime("%H:%M")] = values[0] if len(values) == 1 else values
    return out
