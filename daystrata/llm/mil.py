"""Document quality by attention-based multiple-instance learning: a document is a bag of passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daystrata.llm.words import SOLID, grams, mixed, slices, whole, words

#: Words of a passage.
PASSAGE = 64
#: Most labelled documents that a model is fitted on (chosen by a hash of doc_id), and most passages drawn from one of them.
TRAIN_DOCS, TRAIN_PASSAGES = 5000, 400
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
_REPEAT = 3


def _byte_classes() -> np.ndarray:
    """Upper and lower case, digits, spaces, lines, other bytes, and each ASCII punctuation mark by itself."""
    kind = np.full(256, 5)
    kind[ord("A"):ord("Z") + 1], kind[ord("a"):ord("z") + 1], kind[ord("0"):ord("9") + 1] = 0, 1, 2
    kind[[9, 11, 12, 13, 32]], kind[10] = 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kind[marks] = 6 + np.arange(len(marks))
    return kind


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
FEATURES = _CLASSES + 9


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the offsets of each text's passages. A text without words is one empty passage."""
    found = words(texts, SOLID)
    sizes = np.diff(found.offsets)
    passages = np.maximum(1, -(-sizes // PASSAGE))
    start = np.concatenate([[0], np.cumsum(passages)])
    n, total = int(start[-1]), len(found.starts)
    out = np.zeros((n, FEATURES), np.float32)
    if not total:
        return out, start
    text_of = np.repeat(np.arange(len(texts)), sizes)
    passage = start[text_of] + (np.arange(total) - found.offsets[text_of]) // PASSAGE
    count = np.bincount(passage, minlength=n)
    data = np.frombuffer(found.buffer, np.uint8)
    # every byte from one word's start to the next one's belongs to that word
    owner = np.repeat(passage, np.diff(np.append(found.starts, len(data))))
    body = _CLASS[data[found.starts[0]:]]
    out[:, :_CLASSES] = np.bincount(owner * _CLASSES + body, minlength=n * _CLASSES).reshape(n, _CLASSES)
    size = np.maximum(out[:, :_CLASSES].sum(1, keepdims=True), 1)
    out[:, :_CLASSES] = np.sqrt(out[:, :_CLASSES] / size)  # rare marks count too
    length = (found.ends - found.starts).astype(np.float64)
    per = np.maximum(count, 1)
    mean = np.bincount(passage, length, n) / per
    extra = out[:, _CLASSES:]
    extra[:, 0] = mean / 10
    extra[:, 1] = np.sqrt(np.maximum(np.bincount(passage, length**2, n) / per - mean**2, 0)) / 5
    extra[:, 2] = np.log1p(count) / 4

    def repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether the key occurs more than once in its group (whichever comes first, so batches make no difference)."""
        h = mixed(keys + mixed(group.astype(np.uint64)))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        return again

    extra[:, 3] = np.bincount(passage, repeated(found.hashes, passage), n) / per
    extra[:, 4] = np.bincount(passage, repeated(found.hashes, text_of), n) / per
    at = whole(found.offsets, _REPEAT)
    if len(at):
        extra[:, 5] = np.bincount(passage[at], repeated(grams(found.hashes, _REPEAT)[at], text_of[at]), n) / per
    first = data[found.starts]
    extra[:, 6] = np.bincount(passage, (first >= 65) & (first <= 90), n) / per
    # capitals of two bytes (U+00C0 to U+00DE), which the byte classes cannot tell from small letters
    wide = np.flatnonzero(data[:-1] == 0xC3)
    wide = wide[(data[wide + 1] <= 0x9E) & (wide >= found.starts[0])]
    extra[:, 7] = np.bincount(owner[wide - found.starts[0]], minlength=n) / per
    extra[:, 8] = np.repeat(np.log1p(sizes) / 8, passages)
    return out, start


@dataclass
class Model:
    """tanh encoder, gated attention (tanh times sigmoid), logistic score of the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["w1"] + w["b1"])
        a, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (a * g) @ w["w"]
        bag = np.repeat(np.arange(len(start) - 1), np.diff(start))
        e = np.exp(s - np.maximum.reduceat(s, start[:-1])[bag])
        attention = e / np.add.reduceat(e, start[:-1])[bag]
        z = np.add.reduceat(attention[:, None] * h, start[:-1])
        return {"h": h, "a": a, "g": g, "attention": attention, "z": z, "bag": bag,
                "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.forward(self.standard(x), start)["p"]

    def gradient(self, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, start)
        h, a, g, attention, bag = f["h"], f["a"], f["g"], f["attention"], f["bag"]
        error = (f["p"] - y) / len(y)
        dz = (error[:, None] * w["c"])[bag]
        da = (dz * h).sum(1)
        ds = attention * (da - np.add.reduceat(attention * da, start[:-1])[bag])
        gate = ds[:, None] * w["w"]
        dv, du = gate * g * (1 - a**2), gate * a * g * (1 - g)
        dh = (attention[:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - h**2)
        return {"w1": x.T @ dh, "b1": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "w": (a * g).T @ ds, "c": f["z"].T @ error,
                "d": error.sum(keepdims=True)}


def train(xs: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4,
          seed: int = 7) -> Model:
    """Adam on the log loss of the bags; without bags, the model scores 0.5."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(xs) if xs else np.zeros((1, FEATURES), np.float32)
    shapes = {"w1": (FEATURES, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b1", "c", "d") else np.zeros(s) for k, s in shapes.items()}
    model = Model(every.mean(0), np.maximum(every.std(0), 0.02), weights)
    xs = [model.standard(x).astype(np.float64) for x in xs]
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for i in range(0, len(order), batch):
            part = order[i:i + batch]
            start = np.concatenate([[0], np.cumsum([len(xs[j]) for j in part])])
            step += 1
            for k, g in model.gradient(np.concatenate([xs[j] for j in part]), start, y[part]).items():
                g = g + decay * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC-32 of its id as text (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold, chosen by a hash of their id.

    Rows without id or label are left out; repeated label rows count once; of different labels the smaller one holds.
    A very long document trains with ``TRAIN_PASSAGES`` passages drawn from all over it (it is scored by all).
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min(target).cast("double").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        rows, values = [], texts.tolist()
        for part in slices(values):
            x, start = bags(values[part])
            for i, j in zip(start, start[1:]):
                own = x[i:j]
                if len(own) > TRAIN_PASSAGES:
                    own = own[np.sort(np.random.default_rng(len(own)).choice(len(own), TRAIN_PASSAGES, replace=False))]
                rows.append(own.tobytes())
        return pd.Series(rows, dtype=object)

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # ``most`` rows of two numbers
            .select("doc_id", "label", encoded(F.col("text")).alias("bag")).collect())
    rows.sort(key=lambda r: r["doc_id"])
    return train([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows]))


def scored(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """Score of every text, from 0 to 1 (null and empty texts too), by all of its passages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        rows, values = [], texts.tolist()
        for part in slices(values):
            rows.append(shared.value.score(*bags(values[part])))
        return pd.Series(np.concatenate(rows) if rows else [], dtype="float64")

    return score(F.col(text))
