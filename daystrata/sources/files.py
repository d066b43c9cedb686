"""Readers and writers: panels, JSON payloads, registries, logs, model splits."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.functions.scalar import nan_to_null
from daystrata.operators.prefix import shared_folder
from daystrata.operators.quality import null_status
from daystrata.spec import PanelSpec

PAYLOAD_DAYS = (31, 60)
REGISTRY_ENTRY = ("name string, state string, region string, region_type string, lat double, lon double, country string,"
                  " dataset_region string, timezone string, elevation double, model_status string")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as Parquet and read back: cuts the lineage, survives lost executors, and
    later readers still prune columns."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_panel(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """One or many (also gzip) CSV files with a header and a declared schema; NaN becomes NULL.

    A gzip file is one task: convert large ones to Parquet once.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return nan_to_null(spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(paths))


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def write_panel(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, optionally partitioned by a low-cardinality column (region, split, year)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def save_bucketed(df: DataFrame, table: str, spec: PanelSpec, buckets: int) -> None:
    """A table bucketed and sorted by entity: every later per-entity window, join or
    aggregation reads it without a shuffle. Rows are sent to their bucket's task first,
    so each bucket is one sorted file."""
    (df.repartition(buckets, spec.entity).write.mode("overwrite")
     .bucketBy(buckets, spec.entity).sortBy(spec.entity, spec.date).saveAsTable(table))


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_metadata(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def payload_type(variables: Sequence[str]) -> str:
    arrays = ", ".join(f"{v}: array<double>" for v in variables)
    return f"struct<daily: struct<time: array<string>, {arrays}>>"


def parse_payloads(df: DataFrame, text: str, variables: Sequence[str], limits: tuple[int, int] = PAYLOAD_DAYS) -> DataFrame:
    """Parse {"daily": {"time": [...], var: [...]}} and add ``ok``: every array is
    present, all have the same length, and it lies within the limits."""
    x = df.withColumn("_p", F.from_json(text, payload_type(variables)))
    n = F.size("_p.daily.time")
    same = F.lit(True)
    for v in variables:
        same = same & (F.size(f"_p.daily.{v}") == n)
    return x.withColumn("ok", F.coalesce(n.between(*limits) & same, F.lit(False)))


def payload_rows(parsed: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """One row per date of the accepted payloads."""
    arrays = [F.col("_p.daily.time").alias("time"), *[F.col(f"_p.daily.{v}").alias(v) for v in variables]]
    flat = parsed.filter("ok").select(*keys, *arrays)
    rows = flat.select(*keys, F.explode(F.arrays_zip("time", *variables)).alias("_r"))
    return rows.select(*keys, F.to_date("_r.time").alias("date"), *[F.col(f"_r.{v}").alias(v) for v in variables])


def rejected_payloads(parsed: DataFrame) -> DataFrame:
    return parsed.filter("NOT ok").drop("_p", "ok")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """JSON object keyed by entity -> rows with the file order as ``code``; the status column is hidden."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.from_json("value", f"map<string, struct<{REGISTRY_ENTRY.replace(' string', ': string').replace(' double', ': double')}>>").alias("m"))
    rows = entries.select(F.posexplode("m"))
    return rows.select(F.col("key").alias("entity"), F.col("pos").alias("code"), "value.*").drop("model_status")


def save_normals(table: DataFrame, path: str) -> None:
    """Normals rounded to six digits."""
    number = [f.name for f in table.schema.fields if f.dataType.typeName() == "double"]
    table.withColumns({c: F.round(c, 6) for c in number}).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only by design: the same forecast logged twice is two rows."""
    df.write.mode("append").parquet(path)


def promote(staged: DataFrame, target: str, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """Overwrite only the staged entities' partitions of a panel partitioned by entity,
    leaving out entities with an entirely null column; returns the refused ones."""
    bad = null_status(staged, list(columns), [spec.entity]).filter("status = 'FAIL'")
    refused = bad.groupBy(spec.entity).agg(F.sort_array(F.collect_list("column")).alias("null_columns"))
    good = staged.join(refused.select(spec.entity), spec.entity, "left_anti")
    (good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(spec.entity).parquet(target))
    return refused


def save_splits(df: DataFrame, path: str) -> None:
    """One dataset partitioned by split; X, y and meta are projections of it."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def payload_of(df: DataFrame, entity: str, date: str, variables: Sequence[str], chunk: Column) -> DataFrame:
    """The inverse: one JSON payload per entity and chunk (a chunk must stay small, such as a month)."""
    row = F.struct(F.date_format(date, "yyyy-MM-dd").alias("time"), *variables)
    g = df.groupBy(entity, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("_l"))
    daily = F.struct(*[F.col("_l").getField(v).alias(v) for v in ("time", *variables)])
    return g.select(entity, "chunk", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))
