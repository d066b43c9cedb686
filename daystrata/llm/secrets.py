"""Secret scan: fixed patterns, and an assignment-aware lexer that knows what a literal is assigned to."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.common import fresh

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
KINDS = ("assign", "access", "hex", "literal")
PLACEHOLDER = "[SECRET]"
#: A literal is reported from this score on.
LEAST_SCORE = 0.5

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LIKELY = ("password", "passwd", "secret", "token", "api")

# name, operator, value: a chain of quoted strings and names joined by +, or a bare word as in configuration files
_NAME = r"(?<![A-Za-z0-9_.$-])[A-Za-z_$][A-Za-z0-9_.$-]*+"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_PAIR = re.compile(rf"""({_NAME})["']?[ \t]*(?::=|=>|=(?!=)|:(?!//))[ \t]*(?=[\w"'$+/-])""", re.A)
_STRING, _BARE = re.compile(_QUOTED), re.compile(r"[A-Za-z0-9+/_.=$-]+")
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'A-Za-z_$])", re.A)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# How much a word of the target's name says that its value is secret (alone, or as the last of a pair).
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9,
             "credential": 0.8, "credentials": 0.8, "bearer": 0.7, "api key": 0.9, "private key": 0.9, "access key": 0.9,
             "secret key": 1.0, "encryption key": 0.9, "signing key": 0.9, "client secret": 1.0, "auth key": 0.8}
_DUMMY = re.compile(r"(?i)^(?:changeme|example\w*|placeholder|password|secret|token|none|null|true|false|undefined|todo|x+|\*+|\.+|-+)$")


def name_score(name: str) -> float:
    """Of ``db_password``, ``clientSecret``, ``api-key``: the most that a word or a pair of words says."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])], default=0.0)


_KINDS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]")]
#: Characters up to which a joined value is kept as it is; of a longer one only what the score needs is kept.
_SHORT = 64


@dataclass(frozen=True)
class Value:
    """What the score has to know of a value: names that double in every line would make it longer than any memory."""

    length: int = 0
    kinds: int = 0
    short: str | None = ""
    head: str = ""
    last: str = ""
    same: str = ""
    space: bool = False
    reference: bool = False
    wordy: bool = True

    @classmethod
    def of(cls, text: str) -> Value:
        kinds = sum(bool(p.search(text)) << i for i, p in enumerate(_KINDS))
        one = text[:1].lower()
        return cls(len(text), kinds, text if len(text) <= _SHORT else None, text[:7], text[-1:], one if one * len(text) == text.lower() else "",
                   " " in text, "${" in text or "{{" in text, re.fullmatch(r"\w*", text) is not None)

    def __add__(self, other: Value) -> Value:
        if not self.length or not other.length:
            return self if self.length else other
        n = self.length + other.length
        return Value(min(n, 1 << 60), self.kinds | other.kinds, self.short + other.short if n <= _SHORT else None,
                     (self.head + other.head)[:7], other.last, self.same if self.same == other.same else "", self.space or other.space,
                     self.reference or other.reference or self.last + other.head[:1] in ("${", "{{"), self.wordy and other.wordy)

    def dummy(self) -> bool:
        if self.short is not None:
            return bool(_DUMMY.match(self.short))
        return (self.wordy and self.head.lower() == "example") or self.same in ("x", "*", ".", "-")


def literal_score(value: Value) -> float:
    """Lower for short values, plain words and sentences; 0 for placeholders and references."""
    if value.length < 6 or value.dummy() or value.reference or value.head[:1] == "<":
        return 0.0
    return (0.6 + 0.2 * (value.kinds.bit_count() - 1)) * (0.5 if value.space else 1.0)


def assignments(text: str) -> Iterator[tuple[str, Value, list]]:
    """(name, value, literals that make it) in text order; names that were assigned before are replaced.

    The literals are a tree of (start, end) pairs and lists of two trees; an assignment shares those of the names it uses.
    """
    known: dict[str, tuple[Value, list]] = {}
    run, longest = Run(text, 0, 0), 0
    for pair in _PAIR.finditer(text):
        at, value, spans = pair.end(), None, []
        while True:
            if part := _STRING.match(text, at):
                more, where, end = Value.of(part[0][1:-1]), (part.start() + 1, part.end() - 1), part.end()
            else:
                if not run.start <= at < run.end:
                    word = _BARE.match(text, at)
                    if not word:
                        break
                    run = Run(text, at, word.end())
                end = run.end
                if end - at <= longest and text[at:end] in known:
                    more, where = known[text[at:end]]
                elif value is None:
                    more, where = run.value(at), (at, end)
                else:
                    break  # an unknown name in a chain
            value, spans = (more, where) if value is None else (value + more, [spans, where])
            plus = _PLUS.match(text, end)
            if not plus:
                break
            at = plus.end()
        if value is not None:
            known[pair[1]] = (value, spans)
            longest = max(longest, len(pair[1]))
            yield pair[1], value, spans


class Run:
    """A bare word. ``a=b=c`` gives ``a`` the word ``b=c`` and ``b`` the word ``c``: all of them end together, so the marks that
    tell their values are looked for once."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end, self.marks = text, start, end, None

    def value(self, at: int) -> Value:
        if self.end - at <= 4 * _SHORT:
            return Value.of(self.text[at:self.end])
        if self.marks is None:
            word = self.text[self.start:self.end]
            last = [max((m.start() for m in p.finditer(word)), default=-1) for p in (*_KINDS, re.compile(r"\W"))]
            alike = len(word.lower()) - len(word.lower().rstrip(word[-1:].lower()))
            self.marks = [self.start + x if x >= 0 else -1 for x in last], self.end - alike
        last, alike = self.marks
        kinds = sum((x >= at) << i for i, x in enumerate(last[:4]))
        return Value(self.end - at, kinds, None, self.text[at:at + 7], self.text[self.end - 1], self.text[at].lower() if at >= alike else "",
                     False, False, last[4] < at)


def _leaves(tree, seen: set[int]) -> Iterator[tuple[int, int]]:
    """The pairs of a tree; parts in ``seen`` were told before."""
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            yield node
        elif id(node) not in seen:
            seen.add(id(node))
            todo += node


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start and then kind; code points, end exclusive."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _LIKELY):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if ":" in text or "=" in text:
        told, literals, trees = set(), set(), []
        for name, value, spans in assignments(text):
            if (s := name_score(name)) and s * literal_score(value) >= LEAST_SCORE:
                trees.append(spans)  # so that no id is used twice
                literals.update(x for x in _leaves(spans, told) if x[0] < x[1])
        base = sorted(found)
        starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
        for a, b in literals:
            before = bisect_right(starts, a)  # base spans that start no later; is one of them as long?
            if not before or reach[before - 1] < b:
                found.append((a, b, "literal"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str) -> str:
    out, at = [], 0
    for a, b, _ in find(text):
        if a >= at:
            out += [text[at:a], PLACEHOLDER]
        at = max(at, b)
    return "".join(out) + text[at:]


def spans(text: Column) -> Column:
    """All secrets of a text (null or empty: none) as an array of kind, start and end."""

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in find(t)] for t in texts])

    return of(text)


def scan(docs: DataFrame) -> tuple[DataFrame, Column]:
    """The documents with one more column of spans, and that column. Rows are judged one by one, so repeats repeat."""
    name = fresh(docs, "_spans")
    return docs.withColumn(name, spans(F.col("text"))), F.col(name)


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every secret replaced by a placeholder and ``n_chars`` counted anew; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t) for t in texts], dtype=object)

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
