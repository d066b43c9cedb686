"""Chronological splits, class resampling and time-ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.functions.scalar import mix
from daystrata.operators.neighbours import nearest_rows
from daystrata.operators.prefix import BUCKET_ROWS, row_index, running_sums
from daystrata.sources.files import materialise
from daystrata.spec import PanelSpec


def by_year(df: DataFrame, spec: PanelSpec, train_until: int = 2019, val_until: int = 2022) -> DataFrame:
    y = F.year(spec.date)
    return df.withColumn("split", F.when(y <= train_until, "train").when(y <= val_until, "val").otherwise("test"))


def roles(df: DataFrame, spec: PanelSpec, features: list[str], split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(X, y, meta) of one split. All three keep the key, so they can be joined again."""
    banned = {spec.target, spec.entity, spec.date} & set(features)
    if banned:
        raise ValueError(f"not a feature: {sorted(banned)}")
    part, key = df.filter(F.col("split") == split), [spec.entity, spec.date]
    extra = [c for c in ("name", "state", "region_type") if c in df.columns]
    return part.select(*key, *features), part.select(*key, spec.target), part.select(*key, *extra)


def reassemble(x: DataFrame, y: DataFrame, meta: DataFrame, spec: PanelSpec) -> DataFrame:
    key = [spec.entity, spec.date]
    return meta.join(x, key).join(y, key)


def development(df: DataFrame) -> DataFrame:
    """Train and validation rows together."""
    return df.filter(F.col("split").isin("train", "val"))


def hash_cut(df: DataFrame, want: int) -> Column:
    """A filter that keeps the ``want`` rows with the smallest (``_hash``, ``_key``); no row is sorted.

    The 32 bits of the hash are settled twelve at a time: the rows of at most 4096 buckets are counted, the bucket with
    the last wanted row is looked into. What remains are the rows of one hash value.
    """
    prefix, bits = 0, 32
    while bits:
        shift = max(0, bits - 12)
        inside = df.filter(F.shiftright("_hash", bits) == prefix)
        counts = sorted(inside.groupBy(F.shiftright("_hash", shift).alias("b")).count().collect())
        for bucket, n in counts:
            if want <= n:
                break
            want -= n
        prefix, bits = bucket, shift
    keys = df.filter(F.col("_hash") == prefix).orderBy("_key").limit(want).agg(F.max("_key")).first()[0]
    return (F.col("_hash") < prefix) | ((F.col("_hash") == prefix) & (F.col("_key") <= keys))


def undersample(df: DataFrame, label: str, key: Column, ratio: int = 10, seed: int = 42) -> DataFrame:
    """All positives and exactly min(ratio * positives, negatives) negatives, chosen by the hash of their (unique) key."""
    pos, neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if neg <= ratio * pos:
        return df.filter(F.col(label).isin(0, 1))
    hashed = df.withColumn("_key", key.cast("bigint")).withColumn("_hash", mix(F.col("_key"), seed))
    negatives = hashed.filter(F.col(label) == 0)
    chosen = hash_cut(negatives, ratio * pos) if pos else F.lit(False)
    return hashed.filter((F.col(label) == 1) | ((F.col(label) == 0) & chosen)).drop("_hash", "_key")


def hash_index(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """0-based positions of the rows in (hash, key) order, ranked inside even hash buckets of about ``BUCKET_ROWS``."""
    x = df.withColumn("_hash", mix(F.col(key), seed))
    bits = min(32, max(1, (df.count() // BUCKET_ROWS).bit_length()))
    x = x.withColumn("_bucket", F.shiftright("_hash", 32 - bits))
    ranked = running_sums(x, [F.col("_hash"), F.col(key)], {out: F.lit(1)})
    return ranked.withColumn(out, F.col(out) - 1).drop("_hash", "_bucket")


def oversample(df: DataFrame, label: str, key: Column, seed: int = 42) -> DataFrame:
    """All negatives and as many positives, drawn with replacement.

    Every negative row is one draw: its hash modulo the number of positives picks
    the position of a positive. The copies carry ``draw`` (NULL for negatives).
    """
    keyed = df.withColumn("_key", key.cast("bigint"))
    pos, neg = keyed.filter(F.col(label) == 1), keyed.filter(F.col(label) == 0)
    n_pos = pos.agg(F.count(F.lit(1))).scalar()
    slots = neg.select(F.col("_key").alias("draw"), F.pmod(mix(F.col("_key"), seed), n_pos).alias("_pos"))
    drawn = slots.join(hash_index(pos, "_key", seed, "_pos"), "_pos").drop("_pos")
    return neg.withColumn("draw", F.lit(None).cast("bigint")).unionByName(drawn).drop("_key")


def smote(df: DataFrame, label: str, key: Column, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """All rows (label, features) and as many interpolated positives as it takes to have as many as negatives.

    Synthetic row t starts at the positive on position hash(t) modulo their number (in hash order of their unique key) and goes
    a hashed share of the way to one of its k nearest positives. ``draw`` is t, ``base`` and ``neighbour`` are keys (all NULL for
    given rows), ``gap`` the share. Rows whose label is null count on neither side; positives with a null or non-finite feature
    are kept but neither start nor end a line. With fewer than two such positives there is nothing to interpolate.
    Use it on training rows only.
    """
    keyed = df.select(key.cast("bigint").alias("_key"), F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features])
    given = keyed.drop("_key").withColumns({"draw": F.lit(None).cast("bigint"), "base": F.lit(None).cast("bigint"),
                                            "neighbour": F.lit(None).cast("bigint"), "gap": F.lit(None).cast("double")})
    positives = keyed.filter(F.col(label) == 1)
    n_pos, n_neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    lines = materialise(nearest_rows(positives, "_key", features, k).filter(F.size("neighbours") > 0), "lines")
    usable = lines.count()
    if not usable or n_neg <= n_pos:
        return given
    t = F.col("draw")
    draws = df.sparkSession.range(n_neg - n_pos).select(F.col("id").alias("draw")).select(
        "draw", F.pmod(mix(t, seed), F.lit(usable)).alias("_pos"), mix(t, seed + 1).alias("_pick"), (mix(t, seed + 2) / float(1 << 32)).alias("gap"))
    x = draws.join(hash_index(lines, "key", seed, "_pos"), "_pos")
    other = F.element_at("neighbours", (F.pmod(F.col("_pick"), F.size("neighbours")) + 1).cast("int"))
    x = x.withColumn("_to", other)
    made = [(F.col("x")[i] + F.col("gap") * (F.col("_to.x")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)]
    return given.unionByName(x.select(F.lit(1).alias(label), *made, "draw", F.col("key").alias("base"), F.col("_to.key").alias("neighbour"), "gap"))


def class_weights(df: DataFrame, label: str, cap: float = 50.0) -> DataFrame:
    """Balanced class weights, the plain and doubled imbalance ratio, and its capped form."""
    n, pos = F.count(label), F.sum(label)
    neg = n - pos
    return df.agg(n.alias("n"), pos.alias("positives"),
                  (n / (2.0 * neg)).alias("weight_0"), (n / (2.0 * pos)).alias("weight_1"),
                  (neg / pos).alias("ratio"), (2.0 * neg / pos).alias("double_ratio"),
                  F.least(neg / pos, F.lit(cap)).alias("capped_ratio"))


def add_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    n, pos = F.count(label), F.sum(label)
    w = df.agg(F.struct((n / (2.0 * (n - pos))).alias("w0"), (n / (2.0 * pos)).alias("w1"))).scalar()
    x = df.withColumn("_w", w)
    return x.withColumn(out, F.when(F.col(label) == 1, F.col("_w.w1")).otherwise(F.col("_w.w0"))).drop("_w")


def time_folds(df: DataFrame, spec: PanelSpec, folds: int = 3, whole_days: bool = False) -> DataFrame:
    """Expanding-window folds as ``fold`` 1..k (the test block a row belongs to; 0 = only ever train).

    A row trains every fold above its own. Test blocks hold n // (folds + 1) rows
    in (date, entity) order; ``whole_days`` moves the cuts to day boundaries and
    then needs only the daily counts.
    """
    if whole_days:
        days = df.groupBy(spec.date).agg(F.count(F.lit(1)).alias("n"))
        # one row per calendar day
        w = Window.orderBy(spec.date).rowsBetween(Window.unboundedPreceding, -1)
        start = days.select(spec.date, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_at"))
        placed = df.join(F.broadcast(start), spec.date)
    else:
        placed = row_index(df, [spec.date, spec.entity], "_at")
    total = df.agg(F.count(F.lit(1))).scalar()
    x = placed.withColumn("_n", total).withColumn("_size", F.expr(f"_n div {folds + 1}"))
    first = F.col("_n") - folds * F.col("_size")
    fold = F.when(F.col("_at") < first, 0).otherwise(F.floor((F.col("_at") - first) / F.col("_size")) + 1)
    return x.withColumn("fold", F.least(fold, F.lit(folds)).cast("int")).drop("_at", "_n", "_size")
