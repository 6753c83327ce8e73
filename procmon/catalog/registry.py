"""Registered queries: a Spark function and, where SQL can say it, the DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Averages of short decimals often sit exactly on a rounding tie, where the last bit of a
# sum decides. Both engines shift values off such ties before rounding.
NUDGE = 1.2345e-8


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value + F.lit(NUDGE), digits) + F.lit(0.0)


def r(expression: str, digits: int = 6) -> str:
    return f"(round(({expression}) + {NUDGE}, {digits}) + 0e0)"


def text_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def t(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S')"


def number(value: float) -> str:
    """A SQL literal DuckDB reads as a double."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def with_ctes(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n"
