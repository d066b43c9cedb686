"""Temperature mixing of sources, realised as block permutations within a token budget.

Built-in functions only; what reaches the driver is a few sums for each tried exponent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.llm.common import fresh, written
from daystrata.operators.prefix import running_sums

#: Bits of the exponent that one pass over the sources settles, and passes.
BITS, PASSES = 6, 6
#: Copies of one source that are ordered together at most, about.
BUCKET_ROWS = 2_000


def tokens(text: Column) -> Column:
    """Words of a text (null: none): they end at ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, entropy: float | None, repetition: float | None, budget: int) -> float:
    """The largest exponent (at most 1) at which the weights p^t / sum(p^t) have the entropy, and then no more repetition.

    ``sources`` has ``n``, the tokens of each source (above 0); ``entropy`` is a share of the greatest one, ln(sources).
    Entropy falls and, above the uniform weights, repetition falls as t grows; so the exponent for the entropy is an upper
    bound, and is raised again where a source would be read more than ``repetition`` times. Each pass tries the 63 exponents
    that six steps of bisection could ask for, so 36 steps take six small jobs; the result is rounded to 6 digits.
    """
    total, size = sources.agg(F.sum("n"), F.count("*")).first()
    if not size:
        return 1.0
    logs = sources.select(F.log(F.col("n") / F.lit(float(total))).alias("l"))
    several = (1 << BITS) - 1

    def bisect(low: float, high: float, wanted) -> float:
        for _ in range(PASSES):
            width = (high - low) / (1 << BITS)
            tried = [low + width * (k + 1) for k in range(several)]
            t = F.array(*[F.lit(x) for x in tried])
            sums = (logs.select("l", F.posexplode(t).alias("k", "t")).groupBy("k").agg(
                F.sum(F.exp(F.col("t") * F.col("l"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("l")) * F.col("l")).alias("zl"),
                F.max((F.col("t") - 1) * F.col("l")).alias("most")))
            by = {r["k"]: r for r in sums.collect()}  # 63 rows
            a, b = 0, several + 1
            while b - a > 1:  # the bisection itself
                k = (a + b) // 2
                a, b = (k, b) if wanted(tried[k - 1], by[k - 1]) else (a, k)
            low, high = low + width * a, low + width * b
        return low

    def spread(t: float, r) -> bool:
        return math.log(r["z"]) - t * r["zl"] / r["z"] >= entropy * math.log(size) - 1e-12

    def repeats(t: float, r) -> bool:
        return math.exp(r["most"]) / r["z"] * (budget / total) > repetition

    t = 1.0
    if entropy is not None:
        t = round(bisect(0.0, 1.0, spread), 6)
    if repetition is not None and _repeats_at(logs, t, budget / total, repetition):
        t = round(bisect(t, 1.0, repeats), 6)
    return t


def _repeats_at(logs: DataFrame, t: float, ratio: float, repetition: float) -> bool:
    z, most = logs.agg(F.sum(F.exp(F.lit(t) * F.col("l"))), F.max((F.lit(t) - 1) * F.col("l"))).first()
    return math.exp(most) / z * ratio > repetition


def weights(sources: DataFrame, t: float, budget: int) -> DataFrame:
    """Sources with ``weight`` and ``quota``, the tokens of the budget that they get."""
    total = sources.agg(F.sum("n")).first()[0] or 1
    powers = sources.withColumn("p", F.exp(F.lit(t) * F.log(F.col("n") / F.lit(float(total)))))
    z = powers.agg(F.sum("p")).first()[0] or 1.0
    weight = F.col("p") / F.lit(z)
    return powers.select("source", "n", F.round(weight, 9).alias("weight"),
                         F.floor(F.round(weight, 9) * F.lit(float(budget))).cast("bigint").alias("quota"))


def listing(docs: DataFrame, budget: int | None = None, entropy: float | None = 0.95, repetition: float | None = 4.0,
            block_tokens: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """One row for each copy of a document in the mixture: ``doc_id, source, text_hash, n_tokens, epoch, block, place``.

    A source is read in epochs, each a permutation of its documents by a hash, until the next document would exceed its
    quota. Its tokens are spread evenly over the blocks, so every block of about ``block_tokens`` has all sources in the
    wanted shares; ``place`` (a hash) orders the rows of a block. Without a ``budget`` the mixture is as large as the input.

    Repeated rows are one document; null sources are a source; null texts have no tokens; a source without tokens has no
    weight and gives no rows. Running sums are taken in buckets of a permutation, so no source meets in one task.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("n_tokens"))
    rows = written(rows.distinct())
    sources = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).filter("n > 0"))
    count, total = rows.agg(F.count("*"), F.sum("n_tokens")).first()
    budget = int(total or 0) if budget is None else budget
    t = exponent(sources, entropy, repetition, budget)
    given = weights(sources, t, budget)
    blocks = max(1, -(-budget // block_tokens))
    digits = max(1, math.ceil(math.log(max(count, 1) / BUCKET_ROWS + 1, 16)))
    copies = (rows.alias("r").join(given.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
              .select("r.*", "n", "quota")
              .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("quota") / F.col("n"))))))
    copies = copies.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
                                              .cast("binary")))
    copies = copies.withColumn("bucket", F.substring("place", 1, digits)).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    order = [F.col("place"), F.col("n_tokens"), F.col("text_hash")]
    summed = running_sums(copies, order, {"until": F.col("n_tokens")}, ["source_key", "epoch"], bucket="bucket")
    taken = summed.filter(F.col("epoch") * F.col("n") + F.col("until") <= F.col("quota"))
    before = (F.col("epoch") * F.col("n") + F.col("until") - F.col("n_tokens")).cast("decimal(38,0)")
    return taken.select("doc_id", "source", "text_hash", "n_tokens", "epoch",
                        F.least(F.call_function("div", before * F.lit(blocks), F.col("quota").cast("decimal(38,0)")), F.lit(blocks - 1)).cast("bigint").alias("block"), "place")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mixture: their columns, and ``epoch, block, place`` (with an underscore where a name is taken)."""
    made = [fresh(docs, c) for c in ("epoch", "block", "place")]
    listed = listing(docs, **settings).withColumnsRenamed(dict(zip(("epoch", "block", "place"), made)))
    same = [F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("d.source").eqNullSafe(F.col("m.source")),
            F.xxhash64("d.text") == F.col("m.text_hash")]
    # no broadcast: Spark takes a text for 20 bytes
    return docs.alias("d").join(listed.hint("merge").alias("m"), same).select(*[F.col(f"d.`{c}`") for c in docs.columns], *made)
