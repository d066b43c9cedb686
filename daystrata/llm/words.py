"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Both word patterns of this package are defined by single bytes: ASCII white space ends a word, or everything but ASCII
letters, digits and bytes of longer code points does. So words can be found without decoding, and a 64-bit hash of each
comes from running sums over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

_BYTE = np.arange(256)
#: [^\x20\x09-\x0D]+
SOLID = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


class Words(NamedTuple):
    """``hashes[i]`` is word i of all texts in order; text t has the words ``offsets[t]`` to ``offsets[t + 1]``."""

    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers (two multiplications with shifts)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(int(RADIX)), powers(pow(int(RADIX), -1, 1 << 64))


def slices(texts: Sequence[str | None], limit: int = 1 << 21) -> Iterator[slice]:
    """Cut the texts into runs of about ``limit`` characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def words(texts: Sequence[str | None], inside: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts (None has none); ``lower`` lower-cases A-Z only."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buffer = b"\n".join(parts) + b"\n"
    if lower:
        buffer = buffer.lower()  # of bytes: ASCII letters only
    data = np.frombuffer(buffer, np.uint8)
    edge = np.diff(inside[data].view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(max(12, int(len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    return Words(buffer, starts, ends, hashes, np.searchsorted(starts, borders))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (of all texts; the caller leaves out those across a border)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size, have = 1, hashes
    out, done = None, 0
    rest = n
    while rest:  # blocks of 1, 2, 4 ... words are put together as the bits of n say
        if rest & 1:
            block = have[done:]
            out = block if out is None else out[: len(block)] * np.uint64(pow(int(RADIX), size, 1 << 64)) + block[: len(out)]
            done += size
        rest >>= 1
        if rest:
            have = have[:-size] * np.uint64(pow(int(RADIX), size, 1 << 64)) + have[size:]
            size *= 2
    return mixed(out[: len(hashes) - n + 1])


def whole(offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive words of one text start."""
    total = int(offsets[-1])
    if total < n:
        return np.empty(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)  # words from here to the end of its text
    return np.flatnonzero(left >= n)


def covered(starts: np.ndarray, n: np.ndarray | int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in one of the runs of n words from ``starts``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + n, total), -1)
    return np.cumsum(change[:-1]) > 0
