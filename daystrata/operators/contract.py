"""Feature-contract projection and checks (an ordered list of model inputs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daystrata.spec import PASSTHROUGH


def project(df: DataFrame, contract: list[str], keys: list[str] | None = None) -> DataFrame:
    """Contract columns in order, as doubles, after the keys."""
    return df.select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in contract])


def strip_passthrough(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*PASSTHROUGH, *extra)


def complete_rows(df: DataFrame, contract: list[str]) -> DataFrame:
    return df.na.drop(subset=contract)


def null_names(columns: list[str], limit: int | None = None) -> Column:
    """Names of the columns that are null in this row, in order."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return F.slice(names, 1, limit) if limit else names


def check(df: DataFrame, contract: list[str], strict_order: bool = False) -> DataFrame:
    """One row per finding (severity, finding, columns); empty when the frame fits.

    Names, order and types come from the schema; nulls need one aggregation.
    """
    spark = df.sparkSession
    have = [c for c in df.columns if c not in PASSTHROUGH]
    missing = [c for c in contract if c not in have]
    extra = [c for c in have if c not in contract]
    rows = []
    if missing:
        rows.append(("error", "missing", missing))
    if extra:
        rows.append(("warning", "extra", extra))
    if not missing and [c for c in df.columns if c in contract] != contract:
        rows.append(("error" if strict_order else "warning", "order", []))
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in contract if c in types and not isinstance(types[c], T.NumericType)]
    if text:
        rows.append(("error", "not_numeric", text))
    found = spark.createDataFrame(rows, "severity string, finding string, columns array<string>")
    if missing:
        return found
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in contract])
    listed = nulls.select(F.lit("error").alias("severity"), F.lit("null").alias("finding"),
                          F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in contract])).alias("columns"))
    return found.unionByName(listed.filter(F.size("columns") > 0))
