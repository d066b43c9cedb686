"""Near-duplicates: SimHash fingerprints linked by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.common import components, fresh, written

SHINGLE = 3
RADIUS = 2
#: Most fingerprints in one tree. A larger bucket is divided by more equal bits, so no link is lost.
TREE_NODES = 1024
_BITS = 64


def simhash(text: str | None, n: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42), as a signed 64-bit integer.

    A-Z are lower-cased, words end at ASCII white space, fewer than n words are one shingle; no word gives 0.
    """
    word = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, for both
    if not word:
        return 0
    shingles = zip(*(word[i:] for i in range(n))) if len(word) >= n else [word]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, shingles)), np.uint64)
    set_in = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="int64")

    return of(text)


class BKTree:
    """A node's children are keyed by their Hamming distance to it; a search follows the edges within the radius only."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            children = self.children[node]
            todo += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A forest over the values with the components that links within the radius make (not all links)."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    mask = (1 << _BITS) - 1
    for i, value in enumerate(values):
        for j in tree.within(value & mask, radius):
            parent[root(j)] = root(i)
        tree.add(value & mask)
    return [(values[i], values[root(i)]) for i in range(len(values)) if root(i) != i]


def _masks(free: int, parts: int) -> list[int]:
    """The free bits, cut into that many masks."""
    bits = [i for i in range(_BITS) if free >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << _BITS) if x >> (_BITS - 1) else x


def links(fingerprints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges ``(a, b)`` that join all of the distinct ``fingerprint`` values within the radius into the right components.

    Fingerprints at r or fewer differing bits agree in one of r + 1 bands, so a shard is the set of fingerprints with one
    value of one band, and a fingerprint asks the trees of its own shards only. (Sending the trees of all documents to
    every task, as the method is often told, would collect all fingerprints.) A shard of more than ``tree_nodes`` is cut
    again by r + 1 bands of its free bits, until it fits: a shard with f free bits has at most 2^f fingerprints, so r free
    bits always fit.
    """
    tree_nodes = max(tree_nodes, 1 << radius)
    found: DataFrame | None = None
    masks = {0: _masks((1 << _BITS) - 1, radius + 1)}
    level = fingerprints.select("fingerprint", F.lit(0).cast("bigint").alias("mask"))
    while True:
        cut = F.create_map(*[x for parent, own in masks.items()
                             for x in (F.lit(_signed(parent)), F.array(*[F.lit(_signed(m)) for m in own]))])
        keyed = (level.select("fingerprint", F.explode(cut[F.col("mask")]).alias("mask")).distinct()
                 .withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask"))))
        sizes = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        keyed = written(keyed.join(sizes, ["mask", "value"]))
        shards = (keyed.filter(F.col("n") <= tree_nodes).groupBy("mask", "value")
                  .agg(F.collect_list("fingerprint").alias("members")).select("members"))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [e for members in batch["members"] for e in tree_links([int(x) for x in members], radius)]
                yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

        edges = written(shards.mapInPandas(search, "a bigint, b bigint"))
        found = edges if found is None else found.union(edges)
        large = keyed.filter(F.col("n") > tree_nodes)
        if large.isEmpty():
            return found
        level = large.select("fingerprint", "mask")
        full = (1 << _BITS) - 1
        masks = {m: [m | part for part in _masks(full & ~m, radius + 1) if part] for own in masks.values() for m in own}


def classes(prints: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(fingerprint, component_id)``: the smallest doc_id of each component (null if all are null).

    ``prints`` has ``doc_id`` and ``fingerprint``. Copies become one row before anything is compared. ``edges`` link
    fingerprints; without them those within the radius are linked.
    """
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    linked = components(links(distinct) if edges is None else edges).withColumnRenamed("node", "fingerprint")
    first = (linked.join(distinct, "fingerprint").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return distinct.join(linked.join(first, "component").drop("component"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (bigint) and ``component_id`` of every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows repeat; a null doc_id is linked
    but names no component unless all its members are null. An empty table gives an empty table.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint")))
    return prints.join(written(classes(prints)), "fingerprint").select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (then the smallest hash of its text).

    Only ids, fingerprints and text hashes take part in the search; the texts are shuffled once, to keep the chosen rows.
    """
    h = fresh(docs, "_text_hash")
    prints = written(docs.select("doc_id", F.xxhash64("text").alias(h), fingerprint(F.col("text")).alias("fingerprint")))
    return keep_first(docs, prints, None, h)


def keep_first(docs: DataFrame, prints: DataFrame, edges: DataFrame | None, h: str) -> DataFrame:
    """The first document of each of the ``classes``. ``prints`` has ``doc_id, fingerprint`` and ``h``, the hash of the text."""
    r = fresh(docs, "_repeated")
    # the best of each fingerprint first: a large group of copies is one row in the join
    best = prints.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(h))).alias("best"))
    kept = (best.join(classes(prints, edges), "fingerprint").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
            .agg(F.min("best").alias("best")).select("best.doc_id", f"best.{h}"))
    times = prints.groupBy("doc_id", h).agg((F.count("*") > 1).alias(r))
    same = [F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), F.col(f"d.{h}") == F.col(f"k.{h}")]
    kept = written(kept.alias("d").join(times.alias("k"), same).select("d.doc_id", f"d.{h}", r))
    keyed, columns = docs.withColumn(h, F.xxhash64("text")), [F.col(f"d.`{c}`") for c in docs.columns]
    once = keyed.alias("d").join(kept.filter(~F.col(r)).alias("k"), same, "left_semi").select(*columns)
    if kept.filter(r).isEmpty():
        return once
    again = keyed.alias("d").join(kept.filter(r).alias("k"), same, "left_semi").dropDuplicates(["doc_id", h])
    return once.union(again.alias("d").select(*columns))
