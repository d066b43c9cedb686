"""Exact k-nearest-neighbour self-join: rows meet inside the cells of pivots, and in the cells that the triangle inequality
cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daystrata.sources.files import materialise

#: Points aimed at in a cell, most points of one task's share of a cell, most pivots (they are broadcast).
CELL_POINTS, SHARE_POINTS, MAX_PIVOTS = 512, 4096, 1024
#: Points compared with the pivots at once, points of a box within a cell.
BLOCK, LEAF = 256, 64
_LISTS = "distances array<double>, keys array<bigint>, vectors array<array<double>>"


@dataclass
class Cells:
    """Pivots with the radius and the number of task shares of each cell."""

    pivots: np.ndarray
    radius: np.ndarray
    shares: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(_squares(x, self.pivots))

    def visits(self, x: np.ndarray, reach: np.ndarray) -> Iterator[np.ndarray]:
        """For every point, the other cells that may hold a point within ``reach`` of it.

        A cell is ruled out if all of it is farther: by its radius, |d(q, p)| - r > reach, or by the plane between the two
        pivots, (d(q, p)^2 - d(q, own)^2) / (2 d(p, own)) > reach. A little slack covers the rounding.
        """
        apart = self.distances(self.pivots)
        for i in range(0, len(x), BLOCK):
            d = self.distances(x[i:i + BLOCK])
            own = d.argmin(axis=1)
            home = d[np.arange(len(d)), own][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart[own] > 0, (d**2 - home**2) / (2 * apart[own]), 0.0)
            least = np.maximum(d - self.radius, plane)
            far = reach[i:i + BLOCK, None]
            near = least <= far + 1e-9 * (1 + np.where(np.isfinite(far), far, 0) + d)
            near[np.arange(len(d)), own] = False
            near &= self.radius >= 0
            yield from (np.flatnonzero(row) for row in near)


def _points(df: DataFrame, key: str, features: list[str], keep: int) -> DataFrame:
    """Distinct vectors with the ``keep`` smallest keys of each; a task forwards at most that many rows of a vector."""
    vector = F.array(*[F.col(c).cast("double") for c in features])
    rows = df.select(F.col(key).cast("bigint").alias("key"), vector.alias("x")).filter(
        "key IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('inf'))")
    rows = rows.withColumn("x", F.transform("x", lambda c: c + F.lit(0.0)))  # one zero
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("key"))).filter(F.col("_n") <= keep)
    return first.groupBy("x").agg(F.sort_array(F.collect_list("key")).alias("ids")).select(F.col("ids")[0].alias("point"), "x", "ids")


def _placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The points with their cell (the nearest pivot, the first of equally near ones) and their distance to the pivot."""
    shared = points.sparkSession.sparkContext.broadcast(Cells(pivots, np.zeros(0), np.zeros(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, away = [], []
            x = np.array(batch["x"].tolist(), np.float64)
            for i in range(0, len(x), BLOCK):
                d = shared.value.distances(x[i:i + BLOCK])
                cell.append(d.argmin(axis=1))
                away.append(d.min(axis=1))
            if cell:
                yield batch.assign(cell=np.concatenate(cell).astype(np.int32), away=np.concatenate(away))

    return points.mapInPandas(run, "point bigint, x array<double>, ids array<bigint>, cell int, away double")


def _boxes(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows of ``x`` in groups of at most ``size``, halved in the middle of their widest column."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        column = x[rows, np.ptp(x[rows], axis=0).argmax()]
        order = np.argpartition(column, len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    square = np.zeros((len(q), len(x)))
    for c in range(x.shape[1]):  # one column after the other: the same sum in any engine
        square += (q[:, c, None] - x[None, :, c]) ** 2
    return square


def _bound(square: np.ndarray, k: int, reach: np.ndarray) -> np.ndarray:
    """What is farther is not among the k nearest, or not wanted."""
    return np.minimum(np.partition(square, k - 1, axis=1)[:, k - 1], reach) if square.shape[1] >= k else reach


def _best(k: int):
    """The k nearest entries of a share of a cell for each point that visits it: by distance, then key, within its reach.

    Points and visitors are put into small boxes. A box of visitors meets the nearest boxes that hold k points, whose distances
    bound the others; a box at a greater distance is left out. The distance of two boxes is summed like that of two points,
    and rounding keeps the order: no point is farther away than its box and left out, nor nearer by a rounding.
    """
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"point": [], "distances": [], "keys": [], "vectors": []}
        if len(asked) and len(held):
            x, q = np.array(held["x"].tolist(), np.float64), np.array(asked["vx"].tolist(), np.float64)
            ids, visitor, reach = held["ids"].tolist(), asked["visitor"].to_numpy(), asked["reach"].to_numpy(np.float64)
            sizes = held["ids"].str.len().to_numpy()
            boxes = _boxes(x, LEAF)
            low, high = (np.array([f(x[b], axis=0) for b in boxes]) for f in (np.min, np.max))
            filled = np.array([len(b) for b in boxes])
            for group in _boxes(q, LEAF):
                v, far = q[group], reach[group]
                apart = np.zeros(len(boxes))
                for c in range(x.shape[1]):
                    apart += np.maximum(np.maximum(low[:, c] - v[:, c].max(), v[:, c].min() - high[:, c]), 0.0) ** 2
                order = np.argsort(apart)
                enough = int(np.searchsorted(np.cumsum(filled[order]), k)) + 1
                least = _bound(_squares(v, x[np.concatenate([boxes[b] for b in order[:enough]])]), k, far).max()
                met = [boxes[b] for b in order[:np.searchsorted(apart[order], least, side="right")]]
                if not met:
                    continue
                near = np.concatenate(met)
                square = _squares(v, x[near])
                wanted = np.flatnonzero((square <= _bound(square, k, far)[:, None]).any(axis=0))
                if not len(wanted):
                    continue
                near = near[wanted]
                keys, owner = np.concatenate([ids[i] for i in near]), np.repeat(np.arange(len(near)), sizes[near])
                by = np.argsort(keys)  # so that a stable sort by distance breaks ties by key
                keys, owner = keys[by], owner[by]
                d = square[:, wanted[owner]]
                top = np.argsort(d, axis=1, kind="stable")[:, :k]
                d = np.take_along_axis(d, top, axis=1)
                for i, n in enumerate((d <= far[:, None]).sum(axis=1)):
                    if n:
                        out["point"].append(visitor[group[i]])
                        out["distances"].append(d[i, :n])
                        out["keys"].append(keys[top[i, :n]])
                        out["vectors"].append(list(x[near[owner[top[i, :n]]]]))
        return pd.DataFrame(out)

    return run


def _searched(asked: DataFrame, held: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Nearest entries for ``asked`` (point, x, cell to visit), from all shares of the visited cells. With a column ``reach``
    (a squared distance), entries beyond it are left out.

    A cell of more than ``SHARE_POINTS`` points is cut into shares by a hash of the point, and so are its visitors: no task
    gets more of either than a share, give or take the hash.
    """
    spark = held.sparkSession
    shares = spark.createDataFrame([(i, int(n)) for i, n in enumerate(cells.shares)], "place int, shares int")  # one row a pivot
    # new names: both sides may come from one table
    reach = F.col("reach") if "reach" in asked.columns else F.lit(float("inf"))
    asked = asked.select(F.col("point").alias("visitor"), F.col("x").alias("vx"), F.col("cell").alias("place"), reach.alias("reach"))
    groups = asked.groupBy("place").agg(F.ceil(F.count("*") / SHARE_POINTS).cast("int").alias("groups"))
    plan = materialise(groups.join(shares, "place"), "visits")  # one row a visited cell
    visitors = asked.join(F.broadcast(plan), "place").select(
        "visitor", "vx", "reach", "place", F.pmod(F.xxhash64("visitor"), F.col("groups")).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    homes = held.join(F.broadcast(plan.withColumnsRenamed({"place": "cell"})), "cell").select(
        "x", "ids", "cell", F.pmod(F.xxhash64("point"), F.col("shares")).cast("int").alias("hshare"),
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("hgroup"))
    return (visitors.groupBy("place", "share", "group").cogroup(homes.groupBy("cell", "hshare", "hgroup"))
            .applyInPandas(_best(k), f"point bigint, {_LISTS}"))


def nearest_rows(df: DataFrame, key: str, features: list[str], k: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """``key, x, neighbours``: for every row the k nearest other rows by Euclidean distance, ties to the smaller key.

    ``neighbours`` is an array of (distance, key, x), nearest first; fewer than k where there are fewer other rows. Rows with
    a null key or a null or non-finite feature take no part. The key must be unique.

    Equal vectors are one point with its k + 1 smallest keys, so that copies, however many, cost one point. Points go to the
    nearest of a hash sample of pivots (about one for ``cell_points`` points, so dense regions get more). A first round
    searches the own cell and gives each point its k-th distance; a second one sends it to those cells that may hold a nearer
    one. No pair of rows meets outside these cells, and inside them a point meets the boxes of points within its reach only, so
    that the work of a visit does not grow with the cell. The result is exact.
    """
    spark = df.sparkSession
    points = materialise(_points(df, key, features, k + 1), "points")
    n = points.count()
    schema = "key bigint, x array<double>, neighbours array<struct<distance:double,key:bigint,x:array<double>>>"
    if not n:
        return spark.createDataFrame([], schema)
    wanted = min(MAX_PIVOTS, -(-n // cell_points))
    pivots = np.array([r[0] for r in points.orderBy(F.xxhash64("point"), "point").limit(wanted).select("x").collect()], np.float64)
    placed = materialise(_placed(points, pivots), "placed")
    stats = placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect()  # one row a pivot
    cells = Cells(pivots, np.full(len(pivots), -1.0), np.ones(len(pivots), np.int64))
    for s in stats:
        cells.radius[s["cell"]], cells.shares[s["cell"]] = s["r"], -(-s["n"] // SHARE_POINTS)
    shared = spark.sparkContext.broadcast(cells)
    own = materialise(_merged(_searched(placed.select("point", "x", "cell"), placed, cells, k + 1), k + 1), "own")

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = list(shared.value.visits(np.array(batch["x"].tolist(), np.float64), np.sqrt(batch["reach"].to_numpy(np.float64))))
                sizes = [len(f) for f in found]
                yield pd.DataFrame({"point": np.repeat(batch["point"].to_numpy(), sizes), "x": batch["x"].repeat(sizes).to_numpy(),
                                    "cell": np.concatenate(found).astype(np.int32), "reach": np.repeat(batch["reach"].to_numpy(), sizes)})

    # a point of which fewer than k + 1 keys were found may have to go anywhere
    reach = F.when(F.size("best") > k, F.element_at("best", -1)["distance"]).otherwise(float("inf"))
    further = (placed.select("point", "x").join(own, "point").select("point", "x", reach.alias("reach"))
               .mapInPandas(visits, "point bigint, x array<double>, cell int, reach double"))
    far = _searched(materialise(further, "visits"), placed, cells, k + 1)
    both = own.select("point", F.col("best")).unionByName(_merged(far, k + 1))
    best = both.groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))  # two lists
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.transform(F.array(*[F.col(c).cast("double") for c in features]),
                                                                         lambda c: c + F.lit(0.0)).alias("x"))
    lists = points.select("point", "x").join(best, "point").select("x", "best")
    other = F.slice(F.filter("best", lambda b: b["key"] != F.col("key")), 1, k)
    return rows.filter("key IS NOT NULL").join(lists, "x").select(
        "key", "x", F.transform(other, lambda b: F.struct(F.sqrt(b["distance"]).alias("distance"), b["key"].alias("key"), b["x"].alias("x"))).alias("neighbours"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best entries of each point (squared distance, key, x) over all places it visited, at most k from each."""
    entry = F.transform(F.arrays_zip("distances", "keys", "vectors"),
                        lambda e: F.struct(e["distances"].alias("distance"), e["keys"].alias("key"), e["vectors"].alias("x")))
    listed = found.select("point", entry.alias("best"))
    return listed.groupBy("point").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
