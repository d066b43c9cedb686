"""Live operators: landing files to features, forecasts, log and outcomes.

The same batch operators run inside ``foreachBatch``; state is a table, so a late
correction of an old day simply recomputes the rows that can see it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daystrata.operators import features as ft
from daystrata.spec import PanelSpec
from daystrata.streaming.log import FOLDERS, CompactedLog
from daystrata.streaming.outcomes import left_outer

# Fixed value: the observed signal starts here where an entity has no threshold of its own.
DEFAULT_THRESHOLD = 40.0


def tail(df: DataFrame, spec: PanelSpec, rows: int, out: str = "_from_end") -> DataFrame:
    """The last ``rows`` rows of each entity."""
    w = Window.partitionBy(spec.entity).orderBy(F.desc(spec.date))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= rows).drop(out)


def touched_tail(panel: DataFrame, batch: DataFrame, spec: PanelSpec, history: int | None = None) -> DataFrame:
    """Rows needed to recompute everything a batch can change: per touched entity all
    rows from ``history`` positions before its earliest new date."""
    history = spec.look_back() if history is None else history
    first = batch.groupBy(spec.entity).agg(F.min(spec.date).alias("_first"))
    mine = panel.join(first, spec.entity)
    older = tail(mine.filter(F.col(spec.date) < F.col("_first")), spec, history)
    return older.unionByName(mine.filter(F.col(spec.date) >= F.col("_first"))).drop("_first")


def refresh(panel: DataFrame, batch: DataFrame, spec: PanelSpec, history: int | None = None) -> DataFrame:
    """Features of every row a batch of new or corrected days can change.

    ``panel`` already contains the batch. Only the touched entities are read, from
    ``history`` rows before their earliest new day.
    """
    first = batch.groupBy(spec.entity).agg(F.min(spec.date).alias("_first"))
    built = ft.build(touched_tail(panel, batch, spec, history), spec, live=True).drop("_row", "_rows")
    return built.join(first, spec.entity).filter(F.col(spec.date) >= F.col("_first")).drop("_first")


def run_refresh(stream: DataFrame, spec: PanelSpec, panel_path: str, out_path: str, checkpoint: str,
                prepare: Callable[[DataFrame], DataFrame]) -> None:
    """Files of daily rows -> panel log -> refreshed features, batch by batch.

    ``panel_path`` is a ``CompactedLog`` of the raw rows (a later batch wins for the same day), in folders by a hash of the
    entity; ``prepare`` adds normals, departures and flags. Of the log, only the runs that the manifest lists for the folders of
    the batch's entities are read, and of those only its entities. Both sinks are written per batch id, so a replayed batch
    overwrites itself.
    """
    keys = [spec.entity, spec.date]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CompactedLog(spark, panel_path, keys, spec.entity)
        written = log.append(batch, batch_id)
        panel = latest(touched_log(spark, f"{panel_path}/data", written, spec, lambda folders: log.paths(batch_id, folders)), keys)
        fresh = refresh(prepare(panel), written.select(*keys), spec)
        fresh.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/part={batch_id:08d}")

    (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .foreachBatch(step).start().awaitTermination())


def _folder(spec: PanelSpec) -> Column:
    return F.pmod(F.xxhash64(F.col(spec.entity).cast("string")), F.lit(FOLDERS)).cast("int")


def touched_log(spark: SparkSession, panel_path: str, batch: DataFrame, spec: PanelSpec,
                paths: Callable[[list[int]], list[str]] | None = None) -> DataFrame:
    """The log's rows of the batch's entities; folders of no such entity are pruned. ``paths`` names the runs of the folders
    that count; without it all do."""
    entities = batch.select(spec.entity).distinct()
    folders = [r[0] for r in entities.select(_folder(spec)).distinct().collect()]  # at most FOLDERS numbers
    runs = [panel_path] if paths is None else paths(folders)
    if not runs:  # an empty batch
        return batch.limit(0)
    log = spark.read.option("basePath", panel_path).parquet(*runs).filter(F.col("_folder").isin(folders))
    return log.join(entities, spec.entity, "left_semi")


def newest_features(panel: DataFrame, spec: PanelSpec, history: int | None = None, last: int = 7) -> DataFrame:
    """Features of the newest complete rows from a bounded tail, with the live label proxy."""
    recent = tail(panel, spec, (spec.look_back() if history is None else history) + last)
    built = ft.build(recent, spec, live=True).drop("_row", "_rows")
    needed = [c for c in spec.lag_names() + spec.roll_names() + spec.trend_names() if c in built.columns]
    return tail(built.na.drop(subset=needed), spec, last)


def forecast_rows(df: DataFrame, spec: PanelSpec, today: str) -> DataFrame:
    """Rows from today on, tagged, with the horizon as position in the entity's list.

    The horizon counts rows that later fail to score, so it is taken before any filter.
    """
    now, d = F.lit(today).cast("date"), F.col(spec.date)
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    ahead = df.filter(d >= now)
    return ahead.withColumns({"kind": F.when(d > now, "forecast").otherwise("today"),
                              "horizon": F.row_number().over(w) - 1})


def loggable(forecasts: DataFrame) -> DataFrame:
    return forecasts.filter(F.col("probability").isNotNull())


def match_outcomes(log: DataFrame, observed: DataFrame, today: str, thresholds: DataFrame,
                   default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Past forecasts with the observed value and signal; unmatched ones stay pending (NULL). An entity without a row in
    ``thresholds`` has the default one."""
    past = log.filter(F.col("date") < F.lit(today).cast("date"))
    x = past.join(observed, ["entity", "date"], "left").join(thresholds, "entity", "left")
    x = x.withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    return x.withColumn("observed_signal", (F.col("observed") >= F.col("threshold")).cast("int"))


def pending(log: DataFrame, outcomes: DataFrame, today: str, key: str = "id") -> DataFrame:
    return log.filter(F.col("date") < F.lit(today).cast("date")).join(outcomes.select(key).distinct(), key, "left_anti")


# ---- streams -------------------------------------------------------------------------------


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(folder)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For many small keys: no look-up before each write only to count the keys, and a batch stores its changes, not the tables' files.
SMALL_KEYS = {"trackTotalNumberOfRows": "false", "changelogCheckpointing.enabled": "true"}


@contextmanager
def rocksdb(spark: SparkSession, **options: str) -> Iterator[None]:
    """Streams started inside keep their state on disk beside the executors, not in their memory. ``options`` are those of the
    state store (spark.sql.streaming.stateStore.rocksdb...)."""
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                **{f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in options.items()}}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def outcome_stream(log: DataFrame, observed: DataFrame, thresholds: DataFrame, delay: str = "2 days", grace: str = "1 day",
                   default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Forecasts (entity, date, ...) with what was observed (entity, date, observed), both as streams.

    A left outer join: both sides are late by ``delay`` at most and wait for each other in the state, kept by blocks of entities. A
    forecast whose day, ``grace`` and delay have passed without an observation comes out once, as pending (NULL); later rows of
    either side are dropped. The day bounds how long a row is kept. The output has the columns of ``match_outcomes``.
    """
    x = left_outer(log, observed, delay, grace).join(thresholds, "entity", "left")
    x = x.withColumn("threshold", F.coalesce("threshold", F.lit(default)))
    return x.withColumn("observed_signal", (F.col("observed") >= F.col("threshold")).cast("int"))


def run_outcomes(log: DataFrame, observed: DataFrame, thresholds: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Process what is there; outcomes and expired forecasts are appended to ``path``, each once."""
    with rocksdb(log.sparkSession, **SMALL_KEYS):
        (outcome_stream(log, observed, thresholds, **options).writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """First row per key within the watermark; state is dropped when it passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_totals(stream: DataFrame, keys: list[str], time: str, value: Column, delay: str = "2 days") -> DataFrame:
    """Tumbling one-day aggregate with late-data bound."""
    day = F.window(time, "1 day")
    g = stream.withWatermark(time, delay).groupBy(*keys, day).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.to_date("window.start").alias("date"), "total", "n")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                   transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is available; each micro-batch replaces its own folder, so a retried
    batch does not duplicate rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id:08d}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of an upsert log: the row of the newest batch per key."""
    rest = [c for c in table.columns if c not in keys and c not in ("_batch", "part", "_folder")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
