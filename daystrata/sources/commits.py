"""Appends that count exactly once: rows are staged under their commit's number, checked, and published by one marker file."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daystrata.operators.quality import null_status
from daystrata.spec import PanelSpec


@dataclass
class CommittedTable:
    """Rows under ``root`` by commit. One writer, any readers.

    ``data/commit=<n>`` holds the rows of a commit, ``published/<n>`` is an empty file made last. Readers take the folders
    that have a marker, so a commit is there as a whole or not at all. A number that is published changes nothing when it comes
    again; one that broke before its marker is written anew. The driver lists markers, one for each commit; a stream with many
    small commits belongs in ``streaming.log``.
    """

    spark: SparkSession
    root: str

    def commits(self) -> list[int]:
        found = self._fs().globStatus(self._path(f"{self.root}/published/*")) or []
        return sorted(int(s.getPath().getName()) for s in found)

    def commit(self, rows: DataFrame, number: int, partition: str | None = None,
               check: Callable[[DataFrame], None] = lambda staged: None) -> bool:
        """Publish the rows; False if the number was published before. ``check`` sees them as stored and raises to refuse them."""
        if self._fs().exists(self._path(f"{self.root}/published/{number}")):
            return False
        w = rows.write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(self._data(number))
        check(self.spark.read.schema(rows.schema).parquet(self._data(number)))
        self._fs().create(self._path(f"{self.root}/published/{number}"), False).close()
        return True

    def read(self, schema) -> DataFrame:
        """The rows of all published commits, with ``commit``; equal rows of two commits are two rows."""
        paths = [self._data(n) for n in self.commits()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("commit", F.lit(0).cast("int"))
        typed = self.spark.createDataFrame([], schema).withColumn("commit", F.lit(0).cast("int")).schema
        return self.spark.read.schema(typed).option("basePath", f"{self.root}/data").parquet(*paths)

    def current(self, schema, entity: str) -> DataFrame:
        """Of each entity the rows of the last commit that holds it: a commit replaces whole entities."""
        rows = self.read(schema)
        last = rows.groupBy(entity).agg(F.max("commit").alias("commit"))
        return rows.join(last, [entity, "commit"], "left_semi").drop("commit")

    def _data(self, number: int) -> str:
        return f"{self.root}/data/commit={number}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())


def promote_once(staged: DataFrame, table: CommittedTable, number: int, spec: PanelSpec, columns: Sequence[str]) -> DataFrame:
    """Commit the staged entities but for those with an entirely null column; returns the refused ones with these columns."""
    bad = null_status(staged, list(columns), [spec.entity]).filter("status = 'FAIL'")
    refused = bad.groupBy(spec.entity).agg(F.sort_array(F.collect_list("column")).alias("null_columns"))
    table.commit(staged.join(refused.select(spec.entity), spec.entity, "left_anti").select(*staged.columns), number)
    return refused
