"""Ranked lexical search with quadtrees of impact maxima over a grid of terms and documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daystrata.llm.common import written
from daystrata.llm.words import ALPHANUMERIC, slices, words

TOP = 10
#: Most bytes of item texts whose terms are broadcast at once; more items are searched in several passes.
BLOCK_BYTES = 4 << 20
#: Documents and postings of one grid, and ranges split at once.
GRID_DOCS, GRID_POSTINGS, FRONTIER = 4096, 1 << 20, 512
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id, after all others
#: Place of a present quadrant among the present ones: one row for each of the 16 sets of quadrants.
_BEFORE = np.array([[bin(s & ((1 << q) - 1)).count("1") for q in range(4)] for s in range(16)], np.int32)


class Vocabulary:
    """Terms of the items as 64-bit hashes, numbered in their order."""

    def __init__(self, texts: list[str]):
        found = words(texts, ALPHANUMERIC, lower=True)
        self.hashes = np.unique(found.hashes)
        self.items = [np.unique(np.searchsorted(self.hashes, found.hashes[a:b])) for a, b in zip(found.offsets, found.offsets[1:])]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._low(self.hashes)] = True

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 20) - 1)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those in no item."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[self._low(hashes)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[at]
        out[at[same]] = place[same]
        return out


def postings(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n, terms, tf``: the length of every document with words, and its counts of the items' terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices(texts):
                found = words(texts[part], ALPHANUMERIC, lower=True)
                sizes = np.diff(found.offsets)
                number = v.numbers(found.hashes)
                at = np.flatnonzero(number >= 0)
                doc = np.repeat(np.arange(len(sizes)), sizes)[at]
                pair, tf = np.unique(doc * len(v.hashes) + number[at], return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(sizes) + 1) * len(v.hashes)).astype(np.int32)
                rows = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(sizes)), pa.array(sizes.astype(np.int64)),
                     pa.ListArray.from_arrays(ends, (pair % len(v.hashes)).astype(np.int32)), pa.ListArray.from_arrays(ends, tf.astype(np.int64))],
                    ["doc_id", "n", "terms", "tf"])
                yield rows.filter(pa.array(sizes > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term adds to a document's score."""
    if int(n.max(initial=0)) * 90 * n_docs < 1 << 62:
        m = 10 + 90 * n * n_docs // n_words
    else:
        m = np.array([10 + 90 * int(x) * n_docs // n_words for x in n], np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Treap:
    """A compressed quadtree over (term, document): only cells that hold a posting exist, each with its largest impact.

    The cells of all levels lie in one array, level by level in Morton order. A cell knows the set of its quadrants that
    exist and where the first of them stands. The last cell stands for an empty one.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int):
        self.height = height
        code = np.zeros(len(rows), np.int64)
        for bit in range(height):
            code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((columns >> bit) & 1) << (2 * bit)
        order = np.argsort(code)
        levels = [(code[order], values[order], np.zeros(len(order), np.uint8), np.zeros(len(order), np.int64))]
        for _ in range(height):
            below, peak = levels[-1][:2]
            first = np.flatnonzero(np.diff(below >> 2, prepend=-1))
            quadrants = np.bitwise_or.reduceat(np.left_shift(1, below & 3).astype(np.uint8), first)
            levels.append((below[first] >> 2, np.maximum.reduceat(peak, first), quadrants, first))
        levels.reverse()
        start = np.cumsum([len(x[0]) for x in levels])  # where the next level begins
        self.peak = np.concatenate([x[1] for x in levels] + [[0]])
        self.quadrants = np.concatenate([x[2] for x in levels] + [np.zeros(1, np.uint8)])
        self.first = np.concatenate([x[3] + s for x, s in zip(levels, start)] + [[0]])

    def search(self, terms: np.ndarray, least: int, take) -> None:
        """Best-first over ranges of documents for the rows ``terms``.

        A range carries the cell of each row's path at its level; its bound is the sum of their maxima. The ranges of the
        largest bounds are split in two together, and all row paths descend one level in each half. A range of one document
        holds its exact score. ``take(documents, scores)`` gets these and returns the least score still wanted; ranges whose
        bound is below are left. Ranges of equal bound are not, so ties are whole.
        """
        cells = np.zeros((1, len(terms)), np.int64)
        level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.peak[cells].sum(axis=1)
        if not self.height:
            take(column, bound)
            return
        while True:
            keep = np.flatnonzero(bound >= max(least, 1))
            if not len(keep):
                return
            if len(keep) > FRONTIER:
                best = np.argpartition(-bound[keep], FRONTIER)
                now, later = keep[best[:FRONTIER]], keep[best[FRONTIER:]]
            else:
                now, later = keep, keep[:0]
            own, deep = cells[now], level[now]
            down = (terms[None, :] >> (self.height - 1 - deep)[:, None]) & 1
            have, first = self.quadrants[own], self.first[own]
            parts = [(cells[later], level[later], column[later], bound[later])]
            for right in (0, 1):
                q = 2 * down + right
                child = np.where((have >> q) & 1, first + _BEFORE[have, q], -1)
                score, at = self.peak[child].sum(axis=1), 2 * column[now] + right
                done = deep + 1 == self.height
                ended = done & (score >= max(least, 1))
                if ended.any():
                    least = take(at[ended], score[ended])
                rest = ~done & (score >= max(least, 1))
                parts.append((child[rest], deep[rest] + 1, at[rest], score[rest]))
            cells, level, column, bound = (np.concatenate(x) for x in zip(*parts))


class Best:
    """The ``k`` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> int:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[order], scores[order]
        return int(self.scores[-1]) if len(order) == self.k else 1


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item, equal scores by ascending doc_id.

    Statistics cover all documents. The counts of the items' terms in each document are stored once; then each task lays its
    documents out in grids (terms by weight, documents by their commonest term, so that neighbours are alike), and passes the
    least score wanted from grid to grid. Only k rows for an item and task are shuffled. Items are broadcast in blocks of
    about ``block_bytes`` of text, each one more pass.

    Terms are compared by 64-bit hashes. Rows of one item_id are one item (its texts' terms together); items without an id or
    terms have no result. Documents without words count nowhere; repeated rows rank side by side; a null doc_id comes after
    all others. Empty tables give no rows.
    """
    spark = docs.sparkSession
    named = items.filter("item_id is not null").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    out = None
    for block in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        found = _ranked(docs, [r["text"] for r in part], k)
        if found is not None:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)],
                                          f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _ranked(docs: DataFrame, texts: list[str], k: int) -> DataFrame | None:
    spark, vocabulary = docs.sparkSession, Vocabulary(texts)
    if not len(vocabulary.hashes):
        return None
    counts = written(postings(docs, vocabulary))
    n_docs, n_words = counts.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = {r["t"]: r["count"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary.hashes))], np.int64)
    row = np.empty(len(weights), np.int64)
    row[np.argsort(-weights, kind="stable")] = np.arange(len(weights))
    asked = [np.sort(row[t[weights[t] > 0]]) for t in vocabulary.items]
    shared = spark.sparkContext.broadcast((weights, row, asked, n_docs, n_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, row, asked, n_docs, n_words = shared.value
        best = [Best(k) for _ in asked]

        def flush(part: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(part).combine_chunks()
            sizes = np.concatenate([x.column("terms").value_lengths().to_numpy() for x in part])
            term = np.concatenate([x.column("terms").flatten().to_numpy() for x in part]).astype(np.int64)
            tf = np.concatenate([x.column("tf").flatten().to_numpy() for x in part])
            ids = rows["doc_id"].fill_null(_LAST).to_numpy()
            doc = np.repeat(np.arange(len(ids)), sizes)
            # each document's commonest term, then its length
            commonest = np.zeros(len(ids), np.int64)
            order = np.lexsort((tf, doc))
            commonest[doc[order]] = term[order]
            n = rows["n"].to_numpy()
            places = np.lexsort((ids, n, commonest))
            column = np.empty(len(ids), np.int64)
            column[places] = np.arange(len(ids))
            value = impacts(weights[term], tf, n[doc], n_docs, n_words)
            used = np.flatnonzero(value > 0)
            if not len(used):
                return
            height = max(int(len(weights) - 1).bit_length(), int(len(ids) - 1).bit_length())
            tree = Treap(row[term[used]], column[doc[used]], value[used], height)
            ids = ids[places]
            for terms, top in zip(asked, best):
                if len(terms):
                    tree.search(terms, top.add(ids[:0], ids[:0]), lambda at, score, top=top: top.add(ids[at], score))

        held, docs_held, size = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, GRID_DOCS // 8):
                piece = batch.slice(i, GRID_DOCS // 8)
                held.append(piece)
                docs_held, size = docs_held + piece.num_rows, size + len(piece.column("terms").flatten())
                if docs_held >= GRID_DOCS - GRID_DOCS // 8 or size >= GRID_POSTINGS:
                    flush(held)
                    held, docs_held, size = [], 0, 0
        if held:
            flush(held)
        for i, top in enumerate(best):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.ids), i, np.int32)), pa.array(top.ids, mask=top.ids == _LAST), pa.array(top.scores)],
                    ["item", "doc_id", "score"])

    found = counts.mapInArrow(run, "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
