"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.common import fresh
from daystrata.llm.words import ALPHANUMERIC, covered, slices, words

WINDOW = 13
#: Most bytes of benchmark text that are broadcast at once; a larger benchmark is searched in several passes.
BLOCK_BYTES = 32 << 20
MATCHES = "array<struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>>"
FOUND = f"struct<n_words:bigint,hits:array<bigint>,matches:{MATCHES}>"


class Patterns:
    """The suffixes of all benchmark items, as word numbers of the benchmark's own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        by_text: dict[bytes, list[str]] = {}
        texts: dict[bytes, np.ndarray] = {}
        found = words([text for _, text in items], ALPHANUMERIC, lower=True)
        for i, (item, _) in enumerate(items):
            h = found.hashes[found.offsets[i]:found.offsets[i + 1]]
            if len(h):
                by_text.setdefault(h.tobytes(), []).append(item)
                texts[h.tobytes()] = h
        self.ids = [sorted(set(names)) for names in by_text.values()]
        rows = [texts[k] for k in by_text]
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sequences = [np.searchsorted(self.vocabulary, r) for r in rows]
        # one pattern for each suffix that holds a whole window; an item of fewer words is one window
        self.item = np.array([i for i, s in enumerate(sequences) for _ in range(max(1, len(s) - window + 1))], np.int64)
        self.start = np.array([o for s in sequences for o in range(max(1, len(s) - window + 1))], np.int64)
        self.length = np.array([min(window, len(sequences[i])) for i in self.item], np.int64)
        self.words = np.full((len(self.item), window), -1, np.int64)
        for row, (i, o, n) in enumerate(zip(self.item, self.start, self.length)):
            self.words[row, :n] = sequences[i][o:o + n]
        self.window = window
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for the others."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[place] == hashes[at]
        out[at[same]] = place[same]
        return out


def suffix_array(numbers: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` numbers that start there, by prefix doubling."""
    rank, step = numbers - numbers.min() if len(numbers) else numbers, 1
    while step < depth:
        following = np.zeros(len(rank), np.int64)
        following[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + int(rank.max()) + 2) + following, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def search(numbers: np.ndarray, order: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, position) of every occurrence: the interval of each pattern is narrowed by binary search, word by word."""
    padded = np.append(numbers, np.full(patterns.window, -1, np.int64))
    live = np.arange(len(patterns.item))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(order), np.int64)
    for d in range(patterns.window):
        live = live[(patterns.length[live] > d) & (low[live] < high[live])]
        word = patterns.words[live, d]
        ends = []
        for right in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (busy := np.flatnonzero(a < b)).size:
                middle = (a[busy] + b[busy]) >> 1
                there = padded[order[middle] + d]
                below = (there <= word[busy]) if right else (there < word[busy])
                a[busy[below]] = middle[below] + 1
                b[busy[~below]] = middle[~below]
            ends.append(a)
        low[live], high[live] = ends
    n = high - low
    first = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.arange(len(n)), n), order[np.repeat(low, n) + np.arange(n.sum()) - first]


def shard_matches(texts: list[str | None], patterns: Patterns) -> Iterator[tuple[int, np.ndarray, list]]:
    """For each text of one shard: number of words, its hit ranges (start and end in turn), its longest matches."""
    found = words(texts, ALPHANUMERIC, lower=True)
    sizes = np.diff(found.offsets)
    numbers = patterns.numbers(found.hashes) if patterns.shortest else np.empty(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    if len(numbers):  # a match lies in a run of known words of one text; only such runs of enough words are indexed
        known = numbers >= 0
        border = np.r_[True, (known[1:] != known[:-1]) | (text_of[1:] != text_of[:-1])]
        run = np.cumsum(border) - 1
        kept = np.flatnonzero(known & (np.bincount(run)[run] >= patterns.shortest))
    else:
        kept = np.empty(0, np.int64)
    gap = np.flatnonzero(np.diff(run[kept]) != 0) + 1 if len(kept) else kept
    series = np.insert(numbers[kept], gap, -1) if len(kept) else kept
    origin = np.insert(kept, gap, -1) if len(kept) else kept
    which, at = search(series, suffix_array(series, patterns.window), patterns) if len(series) else (kept, kept)
    at = origin[at] if len(at) else at
    # windows that follow each other on one diagonal of (item, text) are one longer match
    item, start, length = patterns.item[which], patterns.start[which], patterns.length[which]
    text = text_of[at] if len(at) else at
    order = np.lexsort((at, at - start, item, text))
    item, start, at, length, text = (x[order] for x in (item, start, at, length, text))
    new = np.ones(len(at), bool)
    new[1:] = ((np.diff(at) != 1) | (np.diff(start) != 1) | (np.diff(item) != 0) | (np.diff(text) != 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    span = at[last] - at[first] + length[last] if len(at) else first
    for i in range(len(texts)):
        mine = slice(*np.searchsorted(text[first], [i, i + 1])) if len(first) else slice(0, 0)
        begin, n = at[first[mine]] - found.offsets[i], span[mine]
        hit = np.flatnonzero(np.diff(covered(begin, n, int(sizes[i])).astype(np.int8), prepend=0, append=0)) if len(n) else begin
        rows = [{"item_id": name, "item_word": int(s), "doc_word": int(b), "n_words": int(k)}
                for j, s, b, k in zip(item[first[mine]], start[first[mine]], begin, n) for name in patterns.ids[j]]
        yield int(sizes[i]), hit, rows


def _joined(old: list[int], new: np.ndarray) -> list[int]:
    ranges = sorted([*zip(old[::2], old[1::2]), *zip(new[::2].tolist(), new[1::2].tolist())])
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [x for r in out for x in r]


def _locator(shared: Broadcast):
    @F.pandas_udf(FOUND)
    def locate(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        rows, values = [], texts.tolist()
        for part in slices(values):
            rows += shard_matches(values[part], shared.value)
        old = list(zip(before["hits"], before["matches"]))
        return pd.DataFrame({
            "n_words": [n for n, _, _ in rows],
            "hits": [_joined([] if o[0] is None else list(o[0]), h) for o, (_, h, _) in zip(old, rows)],
            "matches": [([] if o[1] is None else list(o[1])) + m for o, (_, _, m) in zip(old, rows)]})

    return locate


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
            block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Column]:
    """Longest verbatim matches of every benchmark item in every document.

    Each batch of documents is a shard with a suffix array of its own (words numbered, sorted by the ``window`` words that
    start at each position); all suffixes of the benchmark are searched in it by bisection. Nothing is shuffled: a shard
    is a pure function of its rows. Returns the documents with one more column and that column, a struct: ``n_words``,
    ``hits`` (word ranges inside an occurring window: start, end, start, ...), ``matches`` (item, first word in item and
    document, number of words; neighbouring windows are merged).

    Benchmark rows without an id or without words take no part; repeated items count once. Null or empty texts have no
    words. The benchmark is broadcast in blocks of about ``block_bytes``, each one more pass over the text.
    """
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    name = fresh(docs, "_found")
    out = docs.withColumn(name, F.lit(None).cast(FOUND))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Patterns([tuple(r) for r in part], window))

        out = out.withColumn(name, _locator(shared)(F.col(text), F.col(name)))
    return out, F.col(name)


def n_hit(found: Column) -> Column:
    """Words of the text inside any occurrence of a window."""
    return F.aggregate(found["hits"], F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("sign")),
                       lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")),
                       lambda s: s["n"])


def contaminated(found: Column) -> Column:
    """At least one word in twenty lies in an occurring window."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; columns as before."""
    out, found = matches(docs, benchmark)
    return out.filter(~contaminated(found)).select(*[F.col(f"`{c}`") for c in docs.columns])
