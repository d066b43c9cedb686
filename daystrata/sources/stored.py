"""Stored order: Parquet rows by file and position in the file, which Spark exposes as hidden metadata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daystrata.spec import PanelSpec

#: Rows of a stored range that one window may see.
RANGE_ROWS = 100_000
#: Rows of a task, about: tasks grow in number with the table, not in size.
TASK_ROWS = 500_000


def with_place(scan: DataFrame) -> DataFrame:
    """A plain Parquet scan with ``_file`` and ``_row`` (from 0, in the file). Files count in the order of their paths."""
    return scan.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def stored_order(scan: DataFrame, spec: PanelSpec, entity=None, date=None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per entity, how many rows stand after a row of a later date (``descents``) or of the same date (``repeats``).

    Each row is compared with the one of its entity that is stored before it. Rows are compared inside of ranges of a file;
    then the last date of a range with the first one of the entity's next range, by one row for a range and entity. So a hot entity
    is never in one window. ``scan`` must be a plain Parquet scan; null dates are skipped.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // TASK_ROWS))
    placed = with_place(scan).select((F.col(spec.entity) if entity is None else entity).alias(spec.entity),
                                     (F.col(spec.date) if date is None else date).alias("_date"), "_file", "_row",
                                     F.floor(F.col("_row") / range_rows).cast("int").alias("_range")).filter("_date IS NOT NULL")
    # a path is far longer than a row: a number for each file, in the order of the paths
    files = scan.select(F.col("_metadata.file_path").alias("_file")).distinct()
    numbers = files.select("_file", F.row_number().over(Window.orderBy("_file")).alias("_part"))  # one row a file
    cell = [spec.entity, "_part", "_range"]
    placed = placed.join(F.broadcast(numbers), "_file").select(*cell, "_row", "_date").repartition(tasks, *cell)
    own = Window.partitionBy(*cell).orderBy("_row")
    steps = placed.withColumn("_before", F.lag("_date").over(own)).groupBy(*cell).agg(
        F.count_if(F.col("_date") < F.col("_before")).alias("_down"), F.count_if(F.col("_date") == F.col("_before")).alias("_same"),
        F.count(F.lit(1)).alias("_n"), F.min_by("_date", "_row").alias("_first"), F.max_by("_date", "_row").alias("_last"))
    across = Window.partitionBy(spec.entity).orderBy("_part", "_range")  # a row for each range of an entity
    joint = steps.repartition(tasks, spec.entity).withColumn("_end", F.lag("_last").over(across))
    out = joint.groupBy(spec.entity).agg(
        F.sum("_n").alias("n"), (F.sum("_down") + F.count_if(F.col("_first") < F.col("_end"))).alias("descents"),
        (F.sum("_same") + F.count_if(F.col("_first") == F.col("_end"))).alias("repeats"))
    return out.withColumn("ok", (F.col("descents") == 0) & (F.col("repeats") == 0))


def with_position(scan: DataFrame, out: str = "_position") -> DataFrame:
    """The rows of a plain Parquet scan with their 0-based place in the whole dataset: rows of earlier files, then the row.

    The offsets (one row a file) are broadcast by name: files of few distinct values are so small that Spark would take the rows.
    """
    placed = with_place(scan)
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_file").withColumn(out, F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """Plain Parquet scans put together row by row, by stored position. Unequal lengths or a column in two parts are errors.

    The lengths come from the files' footers; the rows meet by one join on the position, which spreads them evenly. It is a merge
    join by name, as the size of the files (a constant column takes next to nothing) does not tell the number of rows.
    """
    names = [c.lower() for p in parts for c in p.columns]
    twice = sorted({c for c in names if names.count(c) > 1})
    if twice:
        raise ValueError(f"in more than one part: {twice}")
    lengths = [p.count() for p in parts]
    if len(set(lengths)) > 1:
        raise ValueError(f"parts of unequal length: {lengths}")
    return reduce(lambda a, b: a.join(b.hint("merge"), "_position"), [with_position(p) for p in parts]).drop("_position")
