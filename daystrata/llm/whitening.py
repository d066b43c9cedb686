"""Embedding whitening from variances alone: the variance of a sum of two dimensions gives their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.common import written

#: Integer grid of the vectors: floor(SCALE * c) + SHIFT. Fixed values.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows of a block of squares.
BLOCK = 1024
_EXACT = 1 << 62


def whole_vector(column: str) -> Column:
    """Not null, and no null or non-finite entry."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False))


def on_grid(column: str) -> Column:
    return F.transform(F.col(column), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("bigint"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.column("x").slice(i, BLOCK))


def _added(total: np.ndarray | None, part: np.ndarray) -> np.ndarray:
    part = part.astype(object)  # of Python's integers, which do not overflow
    return part if total is None else total + part


def exact(block: np.ndarray, most: int) -> np.ndarray:
    """The block itself where ``most`` bounds all that is computed from it, else as Python's integers."""
    return block if most < _EXACT else block.astype(object)


def pairs(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension pairs i <= j in row order; i = j stands for the dimension itself."""
    return np.triu_indices(dim)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _blocks(batches):
            n, total = n + len(x), _added(total, exact(x, int(np.abs(x).max(initial=0)) * BLOCK).sum(axis=0))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"d": pa.array(range(-1, len(total)), pa.int32()), "s": [str(n), *map(str, total)]})

    rows = fit.select("x").mapInArrow(run, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["d"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by[d] for d in range(len(by) - 1)]


def squares(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Exact sum of squares of y_i (key i, i) and of y_i + y_j (key i, j), where y is the vector less the centre.

    Each task adds up its own vectors; one row for a key and task is shuffled.
    """
    middle = np.array(centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            y = x - middle
            y = exact(y, (2 * int(np.abs(y).max(initial=0))) ** 2 * BLOCK)
            parts = []
            for i in range(y.shape[1]):
                s = y[:, i:] + y[:, i:i + 1]
                s[:, 0] = y[:, i]
                parts.append((s * s).sum(axis=0))
            total = _added(total, np.concatenate(parts))
        if total is not None:
            i, j = pairs(len(middle))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": [str(v) for v in total]})

    rows = (fit.select("x").mapInArrow(run, "i int, j int, s string").groupBy("i", "j")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return {(r["i"], r["j"]): int(r["s"]) for r in rows}


@dataclass
class Whitening:
    """Eigenvectors (columns) and eigenvalues of the covariance, by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, n: int, total: list[int], centre: list[int], square: dict[tuple[int, int], int]) -> Whitening:
        """From the sums of squares about an integer centre.

        With r = S - n * centre, n * x - S is n * y - r, so the sum of its squares is n * (n * sum(y * y) - r * r), in integers.
        The variance of a sum is the two variances and twice the covariance; the differences are exact fractions, and each
        entry is rounded once.
        """
        dim = len(total)
        rest = [s - n * c for s, c in zip(total, centre)]

        def variance(i: int, j: int) -> Fraction:
            r = rest[i] if i == j else rest[i] + rest[j]
            return Fraction(n * square[i, j] - r * r, n * n)

        own = [variance(i, i) for i in range(dim)]
        cov = np.zeros((dim, dim))
        for i in range(dim):
            cov[i, i] = float(own[i])
            for j in range(i + 1, dim):
                cov[i, j] = cov[j, i] = float((variance(i, j) - own[i] - own[j]) / 2)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        return cls(n, total, vectors[:, order], values[order], float(sum(own)))

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows; NaN for a component without variance (up to rounding)."""
        y = self.deviations(x).astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (y @ self.vectors[:, :components]) / np.sqrt(np.maximum(self.values[:components], 0))
        out[:, ~self.usable(components)] = np.nan
        return out

    def usable(self, components: int) -> np.ndarray:
        return self.values[:components] > 1e-12 * max(float(self.values[0]), 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return exact(x, self.n * int(np.abs(x).max(initial=1))) * self.n - np.array(self.sums, object if self.n * SHIFT >= _EXACT else np.int64)


def fit(vectors: DataFrame) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors ``x`` (arrays of integers of one length), and these vectors, stored.

    Copies are removed by one shuffle of the vectors, combined map-side, so a vector that a third of all rows holds costs
    one row a task. Two more passes over the stored rows give sums and squares; n, S and the squares of all dimensions and pairs
    reach the driver (about d * d / 2 integers), nothing else. None if there is no vector or no dimension.
    """
    distinct = written(vectors.select("x").distinct())
    n, total = sums(distinct)
    if not n or not total:
        return None, distinct
    centre = [s // n for s in total]
    return Whitening.of(n, total, centre, squares(distinct, centre)), distinct


def identity_error(model: Whitening, distinct: DataFrame, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity (components with variance only)."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = 0.0, 0.0
        for x in _blocks(batches):
            w = shared.value.project(x, components)[:, shared.value.usable(components)]
            total, first = total + w.T @ w, first + w.sum(axis=0)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(total.size + len(first)), pa.int32()), "s": np.concatenate([total.ravel(), first])})

    rows = distinct.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").collect()
    k = int(model.usable(components).sum())
    if not k:
        return 0.0
    s = np.array([r["s"] for r in rows]) / model.n
    mean = s[k * k:]
    return float(np.abs(s[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: the id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are left out, and so are those whose length is not the
    commonest one (of equally common ones the longest). Repeated rows and null ids stay. ``deviation`` is null where it does
    not fit in a long, ``whitened`` is null for a component without variance (a single vector has none at all). Entries
    beyond 2^56 are outside the integer grid and saturate. An empty table, or empty vectors only, give no rows.
    """
    spark = df.sparkSession
    rows = df.filter(whole_vector(vector)).select(F.col(id_column).alias("id"), on_grid(vector).alias("x"))
    schema = (f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None or not size["d"]:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == size["d"])
    model, distinct = fit(rows)
    count = min(components, size["d"])
    error = identity_error(model, distinct, count)
    shared = spark.sparkContext.broadcast(model)
    share = [float(e) / model.trace if model.trace else 0.0 for e in np.maximum(model.values[:count], 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                each = np.repeat(np.arange(part.num_rows), count)
                x = _matrix(part.column("x"))
                d = m.deviations(x)
                d = exact(d, int(np.abs(d).max(initial=0)) ** 2 * d.shape[1])
                far = pa.array([int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), part.num_rows), pa.int32()),
                     pa.array(np.full(len(each), m.n)), far.take(pa.array(each)), pa.array(m.project(x, count).ravel(), from_pandas=True),
                     pa.array(np.tile(share, part.num_rows)), pa.array(np.full(len(each), error))],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
