"""Near copies by resemblance: documents that share at least 0.8 of their distinct five-word shingles.

At a resemblance of 0.8 about a seventh of the bits of a SimHash differ, so no useful band of it is equal. Shards are
therefore made by bands of min-hashes; a shard is searched by a BK-tree of 128-bit SimHashes at a radius that covers 0.8,
and every pair found is confirmed by the exact share of common shingles before it links two documents. Sets of shingles
travel to shards, once for each, and never with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.common import components, fresh, written
from daystrata.llm.simhash import keep_first
from daystrata.llm.words import SOLID, grams, mixed, slices, whole, words

SHINGLE = 5
#: Least resemblance of near copies, as a fraction.
SHARE = (4, 5)
#: A pair at 0.8 shares one of 24 bands of 4 min-hashes with probability 1 - (1 - 0.8^4)^24 = 0.999997.
BANDS, ROWS = 24, 4
#: Of 128 bits about 19 differ at 0.8 (standard deviation 4).
RADIUS = 40
#: Least min-hashes that two sets agree in: 77 of the 96 are expected at 0.8 (standard deviation 4).
AGREE = 56
#: Most members of a block, and of either side of a cell of a shard.
SLICE = 1024
#: Members that one of a block is compared with in the first pass, the nearest ones.
NEAREST = 4
#: Members of a cell above which its BK-tree is grown by itself, and nodes that the searches of one step may visit.
TREE, PAIRS = 64, 1 << 16
#: Members that a task takes at a time, in whole cells: most cells hold two or three.
PACK = 256
_DRAWS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_XOR, _TIMES = _DRAWS[0], _DRAWS[1] | np.uint64(1)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles.

    Words as in ``simhash``: A-Z lower-cased, ended by ASCII white space; fewer than five words are one shingle.
    """
    found = words(texts, SOLID, lower=True)
    o, low, every = found.offsets, whole(found.offsets, SHINGLE), grams(found.hashes, SHINGLE)
    cuts = np.searchsorted(low, o)
    out = []
    for i in range(len(texts)):
        n = int(o[i + 1] - o[i])
        own = every[low[cuts[i]:cuts[i + 1]]] if n >= SHINGLE else grams(found.hashes[o[i]:o[i + 1]], n) if n else every[:0]
        out.append(np.unique(own))
    return out


def sketch(s: np.ndarray) -> tuple[int, bytes, list[int], bytes]:
    """Name of the set of shingles, its SimHash, the keys of its bands, and a byte of each min-hash."""
    name = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=42)).astype(np.int64))
    if not len(s):
        return name, bytes(16), [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    bits = np.zeros(128, np.int64)
    for i in range(0, len(s), 4096):
        part = s[i:i + 4096]
        least = np.minimum(least, ((part[:, None] ^ _XOR) * _TIMES).min(0))
        both = np.stack([part, mixed(part ^ _BAND[0])], axis=1)
        bits += np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    keys = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return name, np.packbits(2 * bits > len(s)).tobytes(), keys.view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def sketches(text: Column) -> Column:
    """``fingerprint`` (name of the set of shingles), ``bits``, ``keys``, ``least`` and ``size``."""
    @F.pandas_udf("fingerprint bigint, bits binary, keys array<bigint>, least binary, size bigint")
    def of(texts: pd.Series) -> pd.DataFrame:
        texts = texts.tolist()
        rows = [(*sketch(s), len(s)) for part in slices(texts) for s in shingles(texts[part])]
        return pd.DataFrame(rows, columns=["fingerprint", "bits", "keys", "least", "size"])

    return of(text)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in slices(texts):
            yield batch.iloc[part].drop(columns="text").assign(s=[s.tobytes() for s in shingles(texts[part])])


def resembles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of distinct hashes share ``SHARE`` of their union."""
    top, bottom = SHARE
    if bottom * min(len(a), len(b)) < top * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bottom * common >= top * (len(a) + len(b) - common)


class Links:
    """Union-find over labels."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        self.parent.update(dict.fromkeys(path, x))
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


class Brief:
    """Members of many cells in one task (``node, bits, least, size``, perhaps ``band``), to be compared by their sketches."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.nodes, self.sizes = rows["node"].to_numpy(), rows["size"].to_numpy()
        self.bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, 2)
        self.least = np.frombuffer(b"".join(rows["least"]), np.uint8).reshape(len(rows), -1)
        self.band = rows["band"].to_numpy() if "band" in rows else np.zeros(len(rows), np.int64)

    def far(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Differing bits of pairs."""
        return np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(-1, dtype=np.int64)

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs those that may share ``SHARE`` and meet in no earlier band, with the min-hashes that they agree in."""
        top, bottom = SHARE
        n, m = self.sizes[i], self.sizes[j]
        ok = (bottom * np.minimum(n, m) >= top * np.maximum(n, m)) & (i != j)
        i, j = i[ok], j[ok]
        ok = self.far(i, j) <= RADIUS
        i, j = i[ok], j[ok]
        same = self.least[i] == self.least[j]
        agree = same.sum(1)
        early = same.reshape(len(i), BANDS, ROWS).all(2) & (np.arange(BANDS) < self.band[i][:, None])
        ok = (agree >= AGREE) & ~early.any(1)
        return i[ok], j[ok], agree[ok]


class Forest:
    """BK-trees over the bits of members, one for each of many cells: a node's children are keyed by their distance to it.

    All trees grow and are searched level by level: the distances of all members (or searches) that have come to a node are
    taken at once, and each goes on along its own edge (or the edges that the radius allows). It is the tree that inserting
    the members one after the other gives; equal bits share a node.
    """

    def __init__(self, brief: Brief, cell: np.ndarray, members: np.ndarray) -> None:
        self.brief = brief
        self.cells, first, node = np.unique(cell[members], return_index=True, return_inverse=True)
        self.lead, parent, apart, settled = [members[first]], [], [], []
        count, left = len(first), members
        while len(left):
            far = brief.far(left, np.concatenate(self.lead)[node] if len(self.lead) > 1 else self.lead[0][node])
            here = far == 0
            settled.append((left[here], node[here]))
            left, node, far = left[~here], node[~here], far[~here]
            edge, first, child = np.unique(node * 129 + far, return_index=True, return_inverse=True)
            self.lead.append(left[first])
            parent.append(edge // 129)
            apart.append(edge % 129)
            node, count = child + count, count + len(edge)
        self.lead, parent, self.apart = np.concatenate(self.lead), np.concatenate(parent or [members[:0]]), np.concatenate(apart or [members[:0]])
        order = np.argsort(parent, kind="stable")
        self.child, self.apart = order + len(self.cells), self.apart[order]  # nodes are numbered as their edges were met
        self.edge = np.searchsorted(parent[order], np.arange(count + 1))
        held, node = (np.concatenate(x) for x in zip(*settled, (members[:0], members[:0])))
        order = np.argsort(node, kind="stable")
        self.held, self.first = held[order], np.searchsorted(node[order], np.arange(count + 1))

    def within(self, asks: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a member that asks and a member of its cell's tree within the radius, all pairs of one that asks together."""
        node = np.searchsorted(self.cells, cell[asks])
        who = np.flatnonzero(np.append(self.cells, -1)[node] == cell[asks])  # a cell without members has no tree
        node, found = node[who], []
        while len(node):
            far = self.brief.far(asks[who], self.lead[node])
            hit = far <= RADIUS
            j, owner = _runs(self.held, self.first, node[hit])
            found.append((who[hit][owner], j))
            e, owner = _runs(np.arange(len(self.child)), self.edge, node)
            near = np.abs(self.apart[e] - far[owner]) <= RADIUS
            who, node = who[owner[near]], self.child[e[near]]
        i, j = (np.concatenate(x) for x in zip(*found, (asks[:0], asks[:0])))
        order = np.argsort(i, kind="stable")
        return asks[i[order]], j[order]


def _runs(values: np.ndarray, cuts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[cuts[w]:cuts[w + 1]]`` of every w, and the place of its w in ``which``."""
    n = cuts[which + 1] - cuts[which]
    owner = np.repeat(np.arange(len(which)), n)
    return values[np.arange(len(owner)) + np.repeat(cuts[which] - (np.cumsum(n) - n), n)], owner


def close(brief: Brief, cell: np.ndarray, asks: np.ndarray, inside: np.ndarray,
          tree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a member that asks and a member inside the same cell within the radius, all pairs of one i together.

    Every cell is searched by a BK-tree of its own. Those of cells of at most ``tree`` members grow and are searched together,
    as many searches at a time as could visit ``PAIRS`` nodes.
    """
    held, asking = np.flatnonzero(inside), np.flatnonzero(asks)
    n = np.bincount(cell[held], minlength=cell.max() + 1 if len(cell) else 0)
    forests = [(held[n[cell[held]] <= tree], asking[n[cell[asking]] <= tree])]
    forests += [(held[cell[held] == c], asking[cell[asking] == c]) for c in np.unique(cell[held]) if n[c] > tree]
    for members, searches in forests:
        forest, visits = Forest(brief, cell, members), np.cumsum(n[cell[searches]])
        for part in np.split(searches, np.flatnonzero(np.diff(visits // PAIRS)) + 1):
            yield forest.within(part, cell)


def _cell(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    return rows.groupby(by, sort=False).ngroup().to_numpy()


def block_links(rows: pd.DataFrame, nearest: int = NEAREST, tree: int = TREE) -> list[tuple[int, int]]:
    """Links of blocks: each member is compared with its nearest ones and with the block's ``home``."""
    rows = rows.drop_duplicates(["home", "part", "node"], ignore_index=True)
    brief, sets, done, found = Brief(rows), _arrays(rows), Links(), []
    cell, every = _cell(rows, ["home", "part"]), np.ones(len(rows), bool)
    at_home = np.flatnonzero(brief.nodes == rows["home"].to_numpy())
    hub = np.full(cell.max() + 1, -1)
    hub[cell[at_home]] = at_home
    housed = np.flatnonzero(hub[cell] >= 0)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist()):
            a, b = int(brief.nodes[x]), int(brief.nodes[y])
            if done.root(a) != done.root(b) and resembles(sets[x], sets[y]):
                done.join(a, b)
                found.append((a, b))

    compare(*brief.alike(housed, hub[cell[housed]])[:2])
    for i, j in close(brief, cell, every, every, tree):
        i, j, agree = brief.alike(i, j)
        order = np.lexsort((brief.nodes[j], -agree, i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        compare(i[rank < nearest], j[rank < nearest])
    return found


def _arrays(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in rows["s"]]


def cell_pairs(rows: pd.DataFrame, tree: int = TREE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members with different labels to be compared, within the cells ``key, i, j``.

    Two strangers (members outside the shard's largest label) are compared from the larger one only, and members that share
    several shards in the first of them only.
    """
    brief, label, stranger = Brief(rows), rows["label"].to_numpy(), rows["stranger"].to_numpy(bool)
    asks, inside = rows["asks"].to_numpy(bool), rows["inside"].to_numpy(bool)
    for i, j in close(brief, _cell(rows, ["key", "i", "j"]), asks, inside, tree):
        ok = (label[j] != label[i]) & (~stranger[j] | (brief.nodes[j] < brief.nodes[i]))
        i, j, agree = brief.alike(i[ok], j[ok])
        order = np.argsort(-agree, kind="stable")
        yield i[order], j[order]


def _needed(rows: pd.DataFrame, tree: int = TREE) -> pd.DataFrame:
    """The rows that take part in a comparison."""
    need = np.zeros(len(rows), bool)
    for i, j in cell_pairs(rows, tree):
        need[i] = need[j] = True
    return rows.loc[need, _CELL]


def cell_links(rows: pd.DataFrame, tree: int = TREE) -> list[tuple[int, int]]:
    """Links of cells between members of different labels: a forest, not all links."""
    sets, done, found = _arrays(rows), Links(), []
    label, nodes = rows["label"].tolist(), rows["node"].tolist()
    for i, j in cell_pairs(rows, tree):
        for x, y in zip(i.tolist(), j.tolist()):
            if done.root(label[x]) != done.root(label[y]) and resembles(sets[x], sets[y]):
                done.join(label[x], label[y])
                found.append((nodes[x], nodes[y]))
    return found


_CELL = ["key", "i", "j", "band", "node", "label", "stranger", "inside", "asks"]
_EDGE = "a bigint, b bigint"


def _cells(members: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Cells ``(key, i, j)`` of the shards that hold several labels.

    A shard's strangers ask all its members. Strangers are cut into slices i and members into slices j of about ``size``, so
    a cell is bounded; a group that is already one component asks nothing.
    """
    labelled = written(members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label")))
    shards = (labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
              .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter("most.n < n")
              .select("key", F.ceil(F.col("n") / size).alias("js"), F.ceil((F.col("n") - F.col("most.n")) / size).alias("is"), F.col("most.label").alias("most")))
    rows = labelled.join(shards, "key").withColumn("stranger", F.col("label") != F.col("most"))
    rows = rows.withColumn("own_i", F.pmod(F.xxhash64("node"), "is")).withColumn("own_j", F.pmod(F.xxhash64("node"), "js"))

    def cell(i: Column, j: Column, inside: Column, asks: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), inside.alias("inside"), asks.alias("asks"))

    one = F.lit(1).cast("bigint")
    as_member = F.transform(F.sequence(one, "is"), lambda k: cell(k - 1, F.col("own_j"), F.lit(True), F.col("stranger") & (F.col("own_i") == k - 1)))
    as_stranger = F.filter(F.transform(F.sequence(one, "js"), lambda k: cell(F.col("own_i"), k - 1, F.lit(False), F.lit(True))),
                           lambda c: F.col("stranger") & (c["j"] != F.col("own_j")))
    return rows.select("*", F.explode(F.concat(as_member, as_stranger)).alias("cell")).select("*", "cell.*").select(*_CELL)


def edges(nodes: DataFrame, docs: DataFrame, size: int = SLICE, nearest: int = NEAREST) -> DataFrame:
    """Edges ``(a, b)`` between the names of shingle sets that resemble each other: enough for the right components.

    ``nodes`` has ``fingerprint, bits, keys, least, size`` and ``best`` (``doc_id, hash`` of one document with that set). A
    shard's hub is its smallest member, and a member's home the smallest hub of its shards. In a first pass each set goes to
    the block of its home and is compared with the hub and its nearest members, which settles most of a large group of near
    copies in linear work. In the second, shards that still hold several components are searched completely: first by the
    sketches, which tell what sets must come, then by the sets.
    """
    keyed = nodes.select(F.col("fingerprint").alias("node"), F.posexplode("keys").alias("band", "key"))
    shards = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    # Spark takes an array for one element and a text for 20 bytes, and would broadcast the keys or the texts of all documents
    members = written(keyed.join(shards.hint("merge"), "key"))
    wanted = members.groupBy("node").agg(F.min("hub").alias("home")).join(nodes.withColumnRenamed("fingerprint", "node"), "node")
    wanted = wanted.select("node", "home", "bits", "least", "size", F.col("best.doc_id").alias("doc_id"), F.col("best.hash").alias("hash"))
    same = [F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("d.hash") == F.col("w.hash")]
    texts = docs.alias("d").join(wanted.hint("merge").alias("w"), same).select("node", "home", "bits", "least", "size", "text").dropDuplicates(["node"])
    sets = written(texts.mapInPandas(_sets, "node bigint, home bigint, bits binary, least binary, size bigint, s binary"))

    homes = sets.groupBy("home").agg(F.count("*").alias("n")).filter("n > 1").select("home", F.ceil(F.col("n") / size).alias("parts"))
    held = sets.join(homes, "home").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    hubs = homes.filter("parts > 1").select(F.col("home").alias("hub"), F.explode(F.sequence(F.lit(1).cast("bigint"), "parts")).alias("part"))
    hubs = (sets.drop("home").join(hubs, F.col("node") == F.col("hub")).withColumnRenamed("hub", "home")
            .withColumn("part", F.col("part") - 1))  # a block of a large home has its hub, so that blocks are linked

    def in_block(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(rows, nearest), columns=["a", "b"], dtype="int64")

    def in_need(rows: pd.DataFrame) -> pd.DataFrame:
        return _needed(rows)

    def in_cell(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cell_links(rows), columns=["a", "b"], dtype="int64")

    packs = F.lit(members.count() // PACK + 1)
    block, pack = F.pmod(F.xxhash64("home", "part"), packs), F.pmod(F.xxhash64("key", "i", "j"), packs)

    first = written(held.unionByName(hubs).groupBy(block).applyInPandas(in_block, _EDGE))
    cells = _cells(members, components(first).select("node", F.col("component").alias("label")), size)
    brief = sets.select("node", "bits", "least", "size")
    need = ", ".join(f"{c} {'boolean' if c in ('stranger', 'inside', 'asks') else 'int' if c == 'band' else 'bigint'}" for c in _CELL)
    needed = written(cells.join(brief, "node").groupBy(pack).applyInPandas(in_need, need))
    second = needed.join(sets.drop("home"), "node").groupBy(pack).applyInPandas(in_cell, _EDGE)
    return first.union(written(second))


def deduplicate(docs: DataFrame, size: int = SLICE, nearest: int = NEAREST) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (then the smallest hash of its text).

    Null and empty texts have no shingles and are copies of each other. A group is what links join, so two of its
    documents may resemble each other less than 0.8.
    """
    h, hashed = fresh(docs, "_text_hash"), docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    prints = written(hashed.select("doc_id", "hash", sketches(F.col("text")).alias("of"))).select("doc_id", "hash", "of.*")
    nodes = written(prints.groupBy("fingerprint").agg(F.first("bits").alias("bits"), F.first("keys").alias("keys"),
                                                  F.first("least").alias("least"), F.first("size").alias("size"), F.min(
        F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("hash"))).alias("best")))
    return keep_first(docs, prints.select("doc_id", F.col("hash").alias(h), "fingerprint"), edges(nodes, hashed, size, nearest), h)
