"""Nearest neighbours by multi-index hashing over learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rotations learned (each gives one bit a dimension), bits of an indexed substring.
ROTATIONS, PART_BITS = 2, 16
#: Vectors that the codes and the radius are fitted on (chosen by a hash), queries searched at once, vectors of one index.
FIT_ROWS, QUERY_BLOCK, INDEX_ROWS = 8192, 8192, 16384
#: Share of true neighbours, on the fitted rows, that the radius must hold.
FIT_RECALL = 0.985


def valid(column: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows, pair by pair, in double precision; pairs of equal vectors give equal scores."""
    dot, aa, bb = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


@dataclass
class Codes:
    """Iterative quantisation: rotations that bring the vectors close to the corners of a cube; the radius to search."""

    rotations: list[np.ndarray]
    radius: int

    @classmethod
    def fit(cls, rows: np.ndarray, k: int, rounds: int = 30, seed: int = 3) -> Codes:
        rng, x = np.random.default_rng(seed), unit(rows)
        rotations = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            rotations.append(r)
        codes = cls(rotations, 0)
        asked = rng.choice(len(x), min(512, len(x)), replace=False)
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argsort(-near, axis=1)[:, :k]
        bits = codes.of(x)
        away = np.bitwise_count(bits[asked][:, None, :] ^ bits[best]).sum(-1) if len(x) > 1 else np.zeros(1, int)
        codes.radius = int(np.quantile(away, FIT_RECALL))
        return codes

    def of(self, unit_rows: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = np.concatenate([unit_rows @ r > 0 for r in self.rotations], axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % PART_BITS)))
        return np.packbits(bits, axis=1).view(np.uint16)


class Index:
    """One hash table for each substring of the codes of distinct vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: Codes, keep: int):
        # Equal vectors are one entry with its ``keep`` smallest ids; no answer can use more of them.
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], np.ascontiguousarray(rows[order]) + 0.0  # no negative zeros
        _, first, group = np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        rank = np.arange(len(ids)) - starts[group[order]]
        order = order[rank < keep]
        self.ids, self.group = ids[order], group[order]
        self.starts = np.searchsorted(self.group, np.arange(len(first) + 1))
        self.rows, self.codes = rows[first], codes
        self.bits = codes.of(unit(self.rows))
        self.tables = []
        for part in self.bits.T:
            self.tables.append(np.unique(part, return_inverse=True))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every entry whose code differs from ``code`` in at most ``radius`` bits.

        Of m substrings, one differs in at most radius // m bits, or one of the first radius % m + 1 does; the others need
        one bit less. The buckets within that many bits are read off the table's own keys.
        """
        m, near = len(self.tables), np.zeros(len(self.rows), bool)
        for j, (keys, bucket) in enumerate(self.tables):
            reach = radius // m - (j > radius % m)
            near |= (np.bitwise_count(keys ^ code[j]) <= reach)[bucket]
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.bits[found] ^ code).sum(1) <= radius]

    def nearest(self, query: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k nearest of what the radius holds; it grows until it holds k vectors or all."""
        radius, most = self.codes.radius, len(code) * PART_BITS
        while True:
            found = self.within(code, radius)
            if (self.starts[found + 1] - self.starts[found]).sum() >= k or radius >= most:
                break
            radius = min(most, radius + max(4, radius // 8))
        score = cosine(np.broadcast_to(query, (len(found), len(query))), self.rows[found])
        top = np.argsort(-score, kind="stable")
        # entries by score; each has at most k ids
        top = top[score[top] >= score[top[min(k, len(top)) - 1]]] if len(top) else top
        ids = np.concatenate([self.ids[self.starts[i]:self.starts[i + 1]] for i in found[top]]) if len(top) else self.ids[:0]
        scores = np.repeat(score[top], self.starts[found[top] + 1] - self.starts[found[top]])
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _search(shared: Broadcast, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, numbers, queries = shared.value
        asked = codes.of(unit(queries))
        best_ids = [np.empty(0, np.int64)] * len(queries)
        best_scores = [np.empty(0)] * len(queries)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            index = Index(np.concatenate([i for i, _ in held]), np.concatenate([r for _, r in held]), codes, k)
            held.clear()
            for q in range(len(queries)):
                ids, scores = index.nearest(queries[q], asked[q], k)
                ids, scores = np.concatenate([best_ids[q], ids]), np.concatenate([best_scores[q], scores])
                order = np.lexsort((ids, -scores))[:k]
                best_ids[q], best_scores[q] = ids[order], scores[order]

        for batch in batches:
            held.append((batch["vec_id"].to_numpy(np.int64), np.array(batch["embedding"].tolist(), np.float64)))
            if sum(len(i) for i, _ in held) >= INDEX_ROWS:
                flush()
        flush()
        sizes = [len(i) for i in best_ids]
        if sum(sizes):
            yield pd.DataFrame({"query": np.repeat(numbers, sizes), "vec_id": np.concatenate(best_ids), "score": np.concatenate(best_scores)})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest vectors found for each query, its own row left out.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding`` (one dimension for all). Vectors that are null, zero or
    hold null or non-finite components take no part, nor do rows without an id. Equal query vectors are searched once, for
    one neighbour more. Each task indexes its own vectors in blocks and keeps k + 1 for each query; blocks of
    ``QUERY_BLOCK`` distinct query vectors are broadcast, one pass each.
    """
    spark = vectors.sparkSession
    usable = valid("embedding") & F.col("vec_id").isNotNull()
    vectors = vectors.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.filter(usable).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.withColumn("query", F.xxhash64(F.to_json("embedding"), "embedding"))
    sample = np.array([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(FIT_ROWS).collect()])
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    codes = Codes.fit(sample, k)
    distinct = queries.groupBy("query").agg(F.first("embedding").alias("embedding"))
    blocks = -(-distinct.count() // QUERY_BLOCK)
    found = None
    for block in range(blocks):
        rows = distinct.filter(F.pmod(F.col("query"), F.lit(blocks)) == block).orderBy("query").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((codes, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])))
        part = vectors.mapInPandas(_search(shared, k + 1), "query bigint, vec_id bigint, score double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    # at most (k + 1) x tasks rows a query meet here
    order = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("away"), "vec_id")))
    best = found.groupBy("query").agg(F.slice(order, 1, k + 1).alias("best"))
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(best, "query").select("query_id", F.posexplode(own).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))
