"""Query registry: a DataFrame function, its output columns and an equivalent SQL text.

Columns are declared once as ``name:type`` and used for both sides, so rounding,
casts and names cannot drift apart. Types: i integer, f double rounded to 6
digits, e to 7, g to 4, d date as text, s text, b boolean as 0/1.

Doubles are rounded by the same arithmetic on both sides (scaled, to the nearest
whole double, ties to even), for any size of value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK: dict[str, Callable[[Column], Column]] = {
    "i": lambda c: c.cast("bigint"),
    "f": lambda c: F.rint(c.cast("double") * 1e6) / 1e6,
    "e": lambda c: F.rint(c.cast("double") * 1e7) / 1e7,
    "g": lambda c: F.rint(c.cast("double") * 1e4) / 1e4,
    "d": lambda c: c.cast("date").cast("string"),
    "s": lambda c: c.cast("string"),
    "b": lambda c: c.cast("int").cast("bigint"),
}
_SQL = {
    "i": "CAST({0} AS BIGINT)",
    "f": "round_even(CAST({0} AS DOUBLE) * 1e6::DOUBLE, 0) / 1e6::DOUBLE",
    "e": "round_even(CAST({0} AS DOUBLE) * 1e7::DOUBLE, 0) / 1e7::DOUBLE",
    "g": "round_even(CAST({0} AS DOUBLE) * 1e4::DOUBLE, 0) / 1e4::DOUBLE",
    "d": "CAST(CAST({0} AS DATE) AS VARCHAR)",
    "s": "CAST({0} AS VARCHAR)",
    "b": "CAST(CAST({0} AS INT) AS BIGINT)",
}


def _columns(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in text.split()]


def query(name: str, columns: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` may use the shared CTEs named in ``ctes``."""
    cols = _columns(columns)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_SPARK[t](F.col(c)).alias(c) for c, t in cols])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            body = " ".join(sql.split())
            if ctes:
                from daystrata.plans.bindings import with_clause
                shared = with_clause(ctes)
                body = f"{shared}, {body[5:]}" if body.startswith("WITH ") else f"{shared} {body}"
            picked = ", ".join(f"{_SQL[t].format('q.' + c)} AS {c}" for c, t in cols)
            ORACLES[name] = f"SELECT {picked} FROM ({body}) q"
        return fn

    return register
