"""A log of micro-batches that does not grow in files: levels of runs, merged as they fill, and a manifest written last."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that are merged into one of the next.
FANOUT = 8
FOLDERS = 64
MANIFEST = "folder int, level int, path string, live boolean"


def files_bound(batches: int, fanout: int = FANOUT) -> int:
    """Most runs of one folder after so many batches: fanout - 1 on each level."""
    levels, room = 1, fanout
    while room <= batches:
        levels, room = levels + 1, room * fanout
    return levels * (fanout - 1)


@dataclass
class CompactedLog:
    """Rows by key under ``root``; of equal keys the row of the later batch holds. One writer, any readers.

    ``data/part=<batch>-<level>/_folder=<hash>`` are runs: a batch writes level 0, and where a folder has ``fanout`` runs of a
    level they become one run of the next, superseded rows left out. So a folder has at most ``files_bound(batches)`` runs and a
    row is rewritten once a level. ``manifest/v=<batch>`` lists the runs that count (at most folders x bound rows).

    A batch works from the manifest of the batch before and writes only under its own number, the manifest last: a crash
    before that leaves the log as it was, and the repeated batch overwrites what the first try wrote. Runs that a batch merged are
    deleted by the next one, as a repetition still needs them.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    entity: str
    fanout: int = FANOUT
    folders: int = FOLDERS

    def folder(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.entity).cast("string")), F.lit(self.folders)).cast("int")

    def manifest(self, version: int) -> list[tuple[int, int, str, bool]]:
        """Runs as (folder, level, path, live); those that are not live were merged by this version."""
        if version < 0:
            return []
        return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(self._manifest(version)).collect()]

    def newest(self) -> int:
        """The last published version, -1 if there is none."""
        found = self._fs().globStatus(self._path(f"{self.root}/manifest/v=*/_SUCCESS")) or []
        return max((int(str(s.getPath().getParent().getName())[2:]) for s in found), default=-1)

    def paths(self, version: int, folders: list[int] | None = None) -> list[str]:
        wanted = None if folders is None else set(folders)
        return [p for f, _, p, live in self.manifest(version) if live and (wanted is None or f in wanted)]

    def read(self, schema, version: int | None = None, folders: list[int] | None = None) -> DataFrame:
        """The log as of a version (the newest one by default), with ``_batch``; every row of equal keys that is still there."""
        return self._runs(self.paths(self.newest() if version is None else version, folders), schema)

    def append(self, rows: DataFrame, batch: int, crash=lambda stage: None) -> DataFrame:
        """Publish the rows of a batch; returns them as written. ``crash`` is called between the steps (for tests)."""
        before = self.manifest(batch - 1)
        live = [(f, level, p) for f, level, p, ok in before if ok]
        placed = rows.withColumns({"_batch": F.lit(batch), "_folder": self.folder()})
        schema = placed.drop("_folder").schema
        live += self._write(placed, batch, 0)
        crash("written")
        merged, level = [], 0
        while True:
            runs = defaultdict(list)
            for f, at, p in live:
                if at == level:
                    runs[f].append(p)
            full = [p for paths in runs.values() if len(paths) >= self.fanout for p in paths]
            if full:
                gone = set(full)
                live = [x for x in live if x[2] not in gone]
                live += self._write(self._latest(self._runs(full, schema)), batch, level + 1)
                merged += full
            elif not any(at > level for _, at, _ in live):
                break
            level += 1
        crash("merged")
        entries = [(f, at, p, True) for f, at, p in live] + [(0, 0, p, False) for p in merged]
        self.spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._manifest(batch))
        crash("published")
        for old in [p for _, _, p, ok in before if not ok] + [self._manifest(batch - 2)]:
            self._fs().delete(self._path(old), True)
        return self._runs([p for _, _, p in self._listed(batch, 0)], schema)

    def _runs(self, paths: list[str], schema) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("_folder", F.lit(None).cast("int"))
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).drop("part")

    def _latest(self, runs: DataFrame) -> DataFrame:
        rest = [c for c in runs.columns if c not in (*self.keys, "_folder")]
        best = runs.groupBy("_folder", *self.keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r"))
        return best.select("_folder", *self.keys, "_r.*")

    def _write(self, rows: DataFrame, batch: int, level: int) -> list[tuple[int, int, str]]:
        # by ranges, so that a large folder is several tasks' work and several files, and small ones share a task
        rows.repartitionByRange("_folder", *self.keys).write.mode("overwrite").partitionBy("_folder").parquet(self._part(batch, level))
        return self._listed(batch, level)

    def _listed(self, batch: int, level: int) -> list[tuple[int, int, str]]:
        found = self._fs().globStatus(self._path(f"{self._part(batch, level)}/_folder=*")) or []
        names = [str(s.getPath().getName()) for s in found]
        return [(int(n.split("=")[1]), level, f"{self._part(batch, level)}/{n}") for n in names]

    def _part(self, batch: int, level: int) -> str:
        return f"{self.root}/data/part={batch:08d}-{level}"

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v={version:08d}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
