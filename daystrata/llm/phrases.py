"""Removal of passages that an earlier document has: repeated phrases, located by Aho-Corasick automata.

Three passes over the text. (1) Every window of 13 words is stood for by its anchor, the smallest hash of its six-word
grams; anchors that two documents share make a bit filter of bounded size. (2) Windows whose anchor passes the filter are
confirmed: the first document of each is found, and each bucket of documents is told which windows occur in it and before
it. (3) Each bucket compiles an automaton of its confirmed phrases and streams its documents through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daystrata.llm.words import SOLID, Words, covered, grams, mixed, slices, whole, words

WINDOW, GRAM = 13, 6
#: Text of one bucket of documents (one automaton) and of one shard of hashes, in bytes.
BUCKET_BYTES, SHARD_BYTES = 1 << 20, 16 << 20
#: Bits of the filter for each shard, and in all. A fuller filter lets more windows through; the result is the same.
SHARD_BITS, FILTER_BITS = 1 << 20, 1 << 29
#: Windows under an anchor of more documents take the way that splits a key over tasks.
HOT_DOCS = 100_000
#: Distinct words of a slice that one character each can stand for: all code points but U+0000 and the surrogates.
CHARACTERS = 0x10FFFF - 0x800
#: Hashes that a map task holds before it sends them on.
HELD = 1 << 21


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(np.stack([c.astype(np.int64) for c in columns]).tobytes(), 1)


def _unpack(blobs: list[bytes], columns: int) -> np.ndarray:
    parts = [np.frombuffer(zstandard.decompress(b), np.int64).reshape(columns, -1) for b in blobs]
    return np.concatenate(parts, axis=1) if parts else np.empty((columns, 0), np.int64)


def _bounds(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


class Batch:
    """The windows of some documents: hash, anchor, row of the document."""

    def __init__(self, texts: list[str | None]):
        self.words: Words = words(texts, SOLID)
        self.at = whole(self.words.offsets, WINDOW)
        low = grams(self.words.hashes, GRAM)
        for step in (1, 2, 4):  # the smallest of the 8 grams in a window
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        self.anchors = low[self.at] if len(self.at) else np.empty(0, np.uint64)
        self.rows = np.repeat(np.arange(len(texts)), np.diff(self.words.offsets))[self.at]

    def hashes(self) -> np.ndarray:
        return grams(self.words.hashes, WINDOW)[self.at] if len(self.at) else np.empty(0, np.uint64)


def _least(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    b = _bounds(*keys)
    if not len(b):
        return [*keys, low, high, n]
    return [*[k[b] for k in keys], np.minimum.reduceat(low[order], b), np.maximum.reduceat(high[order], b),
            np.add.reduceat(n[order], b)]


def _sent(held: list[list[np.ndarray]], keys: int, shards: int) -> pd.DataFrame:
    """What has been held, combined and cut by shard."""
    columns = [np.concatenate(c) for c in zip(*held)]
    columns = _least(columns[:keys], *columns[keys:])
    shard = (mixed(columns[0]) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    b = np.append(_bounds(shard[order]), len(order))
    columns[-2] = columns[-2] - columns[-3]  # most windows have one document: zeros, which pack well
    return pd.DataFrame({"shard": shard[order][b[:-1]].astype("int32"),
                         "pack": [_pack(*[c[order[i:j]].astype(np.int64) for c in columns]) for i, j in zip(b, b[1:])]})


def _anchor_map(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64)
            for part in slices(texts):
                found = Batch(texts[part])
                doc = ids[part][found.rows]
                order = np.lexsort((doc, found.anchors))
                b = order[_bounds(found.anchors[order], doc[order])]
                held.append(_least([found.anchors[b]], doc[b], doc[b], np.ones(len(b), np.int64)))
                if sum(len(h[0]) for h in held) > HELD:
                    yield _sent(held, 1, shards)
                    held = []
        if held:
            yield _sent(held, 1, shards)

    return run


def _anchor_reduce(bits: int, hot_docs: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        anchor, low, more, n = _unpack(group["pack"].tolist(), 4)
        anchor, low, high, n = _least([anchor.view(np.uint64)], low, low + more, n)
        shared = low < high
        marks = np.zeros(bits, bool)
        for place in _places(anchor[shared], bits):
            marks[place] = True
        return pd.DataFrame({"shard": [key[0]], "marks": [np.packbits(marks).tobytes()],
                             "hot": [anchor[shared & (n > hot_docs)].view(np.int64).tolist()]})

    return run


def _places(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mixed(anchor ^ np.uint64(0xD6E8FEB86659FD93))
    return [(h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)]


class Filter:
    """Which anchors occur in two documents; may say yes wrongly, never no."""

    def __init__(self, rows: list, shards: int, bits: int):
        self.shards, self.bits = shards, bits
        self.marks = np.zeros((shards, bits // 8), np.uint8)
        for row in rows:
            self.marks[row["shard"]] = np.frombuffer(row["marks"], np.uint8)
        self.hot = np.unique(np.array([x for row in rows for x in row["hot"]], np.int64)).view(np.uint64)

    def passes(self, anchor: np.ndarray) -> np.ndarray:
        shard = (mixed(anchor) % np.uint64(self.shards)).astype(np.int64)
        first, second = ((self.marks[shard, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in _places(anchor, self.bits))
        return (first & second).astype(bool)


def _window_map(shared: Broadcast, hot: bool):
    """Blobs of the windows under ordinary anchors, or rows of those under hot ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, held = shared.value, []
        for batch in batches:
            texts, ids, buckets = batch["text"].tolist(), batch["doc_id"].to_numpy(np.int64), batch["bucket"].to_numpy(np.int64)
            for part in slices(texts):
                found = Batch(texts[part])
                ok = np.flatnonzero(keep.passes(found.anchors) & (np.isin(found.anchors, keep.hot) == hot))
                row = found.rows[ok]
                doc = ids[part][row]
                rows = _least([found.hashes()[ok], buckets[part][row].astype(np.uint64)], doc, doc, np.ones(len(ok), np.int64))
                if hot:
                    yield pd.DataFrame({"h": rows[0].view(np.int64), "bucket": rows[1].astype("int32"), "low": rows[2], "high": rows[3]})
                    continue
                held.append(rows)
                if sum(len(h[0]) for h in held) > HELD:
                    yield _sent(held, 2, keep.shards)
                    held = []
        if held:
            yield _sent(held, 2, keep.shards)

    return run


def _window_reduce(group: pd.DataFrame) -> pd.DataFrame:
    """For each bucket, the windows that occur in a document of it and in an earlier document; with the first document."""
    h, bucket, low, more, n = _unpack(group["pack"].tolist(), 5)
    h, bucket, low, high, _ = _least([h.view(np.uint64), bucket], low, low + more, n)
    b = _bounds(h)
    first = np.repeat(np.minimum.reduceat(low, b), np.diff(np.append(b, len(h)))) if len(b) else low
    late = np.flatnonzero(high > first)
    order = late[np.argsort(bucket[late], kind="stable")]
    cut = np.append(_bounds(bucket[order]), len(order))
    return pd.DataFrame({"bucket": bucket[order[cut[:-1]]].astype("int32"),
                         "pack": [_pack(h[order[i:j]].view(np.int64), first[order[i:j]]) for i, j in zip(cut, cut[1:])]})


def _characters(number: np.ndarray) -> tuple[str, int]:
    """Numbers from 1 on as text, and the characters that each takes: two where there are more numbers than characters.

    The first of two is below the surrogates and the second above U+FFFF, so a match cannot start inside a pair.
    """
    if number.max(initial=0) <= CHARACTERS:
        codes, width = number + np.where(number >= 0xD800, 0x800, 0), 1  # no surrogates
    else:
        codes, width = np.stack([1 + (number >> 20), 0x10000 + (number & 0xFFFFF)], axis=1), 2
    return codes.astype("<u4").tobytes().decode("utf-32-le"), width


def _phrases(found: Batch, first: np.ndarray, ids: np.ndarray) -> tuple[ahocorasick.Automaton, np.ndarray, list[str], int]:
    """Automaton of the confirmed phrases, first document of each, the documents as strings, and the characters of a word.

    A passage (a run of windows to remove) is compiled as phrases of 13 words side by side and one at its end, which cover it.
    """
    number = np.unique(found.words.hashes, return_inverse=True)[1] + 1
    text, width = _characters(number)
    chosen = np.flatnonzero(first < ids[found.rows])
    b = _bounds(found.at[chosen] - np.arange(len(chosen)), found.rows[chosen])
    inside = np.arange(len(chosen)) - np.repeat(b, np.diff(np.append(b, len(chosen))))
    last = np.zeros(len(chosen), bool)
    last[np.append(b[1:], len(chosen))[: len(b)] - 1] = True
    chosen = chosen[(inside % WINDOW == 0) | last]
    automaton = ahocorasick.Automaton()
    for k, at in enumerate(found.at[chosen].tolist()):
        automaton.add_word(text[at * width:(at + WINDOW) * width], k)
    if len(chosen):
        automaton.make_automaton()
    o = found.words.offsets
    return automaton, first[chosen], [text[i * width:j * width] for i, j in zip(o, o[1:])], width


def _remove(columns: list[str]):
    def run(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack([p for p in told["pack"] if p is not None], 2)]
        single = told[told["h"].notna()]  # as text: a column of integers and nulls would come as floats
        parts.append(np.array([list(map(int, single["h"])), list(map(int, single["first"]))], np.int64).reshape(2, -1))
        h, first_of = np.concatenate(parts, axis=1)
        order = np.argsort(h.view(np.uint64))
        h, first_of = h[order].view(np.uint64), first_of[order]
        texts, none, ids = docs["text"].tolist(), docs["none"].to_numpy(bool), docs["doc_id"].to_numpy(np.int64)
        n_words, n_removed, kept = [], [], []
        for part in slices(texts):
            found, own = Batch(texts[part]), ids[part]
            first = np.full(len(found.at), np.iinfo(np.int64).max)
            if len(h):
                mine = found.hashes()
                place = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                first = np.where((h[place] == mine) & ~none[part][found.rows], first_of[place], first)
            automaton, firsts, streams, width = _phrases(found, first, own)
            for i, stream in enumerate(streams):
                length = len(stream) // width
                gone = np.zeros(length, bool)
                if len(firsts) and not none[part][i]:
                    hits = np.array([(end, k) for end, k in automaton.iter(stream)], np.int64).reshape(-1, 2)
                    hits = hits[firsts[hits[:, 1]] < own[i]]
                    gone = covered(hits[:, 0] // width - WINDOW + 1, WINDOW, length)
                a = found.words.offsets[i]
                rest = np.flatnonzero(~gone) + a
                n_words.append(length)
                n_removed.append(int(gone.sum()))
                buffer = found.words.buffer
                kept.append(b" ".join([buffer[s:e] for s, e in zip(found.words.starts[rest].tolist(), found.words.ends[rest].tolist())]))
        made = {"doc_id": docs["doc_id"], "none": none, "n_words": n_words, "n_removed": n_removed,
                "kept": [k.decode("utf-8", "surrogatepass") for k in kept] if "kept" in columns else None,
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        return pd.DataFrame({c: made[c] for c in columns})

    return run


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "n_words", "n_removed", "kept", "kept_sha256"),
                   bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Remove each word inside a window of 13 words that also occurs in a document with a smaller doc_id.

    ``columns`` chooses among ``doc_id, n_words, n_removed, kept`` (the words left, joined by one space) and
    ``kept_sha256``. Windows are judged on the input. Null and empty texts have no words; rows with equal doc_id do not
    remove each other's words; a row without a doc_id removes and loses none. Repeated rows give repeated results.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = -(-total // bucket_bytes) or 1, -(-total // shard_bytes) or 1
    bits = min(SHARD_BITS, 1 << max(3, (FILTER_BITS // shards).bit_length() - 1))
    keyed = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    named = keyed.filter(F.col("doc_id").isNotNull())
    marks = (named.select("doc_id", "text").mapInPandas(_anchor_map(shards), "shard int, pack binary").groupBy("shard")
             .applyInPandas(_anchor_reduce(bits, hot_docs), "shard int, marks binary, hot array<bigint>"))
    keep = Filter(marks.collect(), shards, bits)  # at most FILTER_BITS, and one hot anchor for each hot_docs documents
    shared = docs.sparkSession.sparkContext.broadcast(keep)
    told = (named.mapInPandas(_window_map(shared, False), "shard int, pack binary").groupBy("shard")
            .applyInPandas(_window_reduce, "bucket int, pack binary")
            .select("bucket", "pack", F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("first")))
    if len(keep.hot):
        rows = named.mapInPandas(_window_map(shared, True), "h bigint, bucket int, low bigint, high bigint")
        by_bucket = rows.groupBy("h", "bucket").agg(F.max("high").alias("high"))
        first = rows.groupBy("h").agg(F.min("low").alias("first"))
        late = by_bucket.join(first, "h").filter("high > first")
        told = told.union(late.select("bucket", F.lit(None).cast("binary"), F.col("h").cast("string"), F.col("first").cast("string")))
    types = {"none": "boolean", "doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept": "string", "kept_sha256": "string"}
    made = ["none", *columns]
    filled = keyed.select("bucket", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    out = (filled.groupBy("bucket").cogroup(told.groupBy("bucket"))
           .applyInPandas(_remove(made), ", ".join(f"{c} {types[c]}" for c in made)))
    return out.select(*[F.when(~F.col("none"), F.col(c)).alias(c) if c == "doc_id" else c for c in columns])
