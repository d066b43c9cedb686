"""Order-dependent work without a single-task sort.

A window with no (or a hot) partition key sends all its rows to one task. Here
the ordered axis is cut into buckets first: totals per bucket form a small table
whose running sum gives every bucket its offset, and the row-level window only
spans (group, bucket). The result does not depend on where the cuts are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a bucket may hold before it is cut further (a single value cannot be cut). No effect on a result.
BUCKET_ROWS = 250_000
#: Bits that a radix pass settles.
DIGIT = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the cluster's ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def order_key(value: Column) -> Column:
    """A long that orders like the double: its IEEE bits, negated for negative values. Zeros are one, NaN comes last.

    Scaling by a power of two is exact, and so is 2^n for whole n; the guess by the logarithm is put right by comparison.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    guess = guess + (size >= F.pow(F.lit(2.0), guess + 1)).cast("long") - (size < F.pow(F.lit(2.0), guess)).cast("long")
    power = F.greatest(F.least(guess, F.lit(1023)), F.lit(-1022))
    # two factors, as 2^1023 times the mantissa's scale is no double
    bits = (power + 1022) * F.lit(2**52) + (size / F.pow(F.lit(2.0), power) * F.lit(2.0**52)).cast("long")
    bits = F.when(size == 0, 0).when(size == float("inf"), 2047 * 2**52).otherwise(bits)
    return F.when(F.isnan(value), 2**63 - 1).when(value < 0, -bits).otherwise(bits).cast("long")


def with_bucket(df: DataFrame, column: str, raw: DataFrame | None = None, out: str = "_bucket",
                buckets: int | None = None) -> DataFrame:
    """A bucket that is monotone in a numeric column, of about ``BUCKET_ROWS`` rows at most.

    Radix cells: the leading ``DIGIT`` bits of the value's order key are counted, and only the cells that hold too many rows
    go on to the next digit. The names of those that went on are a joined table, however many there are; where there are
    none (any small table) nothing is joined. Cells are counted on ``raw`` (the rows before ties were collapsed) where given.
    A null comes last. With ``buckets``, the column is cut at that many approximate quantiles instead.
    """
    if buckets is not None:
        return _cut(df, column, df if raw is None else raw, out, buckets)
    source = (df if raw is None else raw).select(order_key(F.col(column).cast("double")).alias("_key")).filter("_key IS NOT NULL")
    made = df.withColumn("_key", F.coalesce(order_key(F.col(column).cast("double")), F.lit(2**63 - 1)))
    cell = lambda bits: F.shiftleft(F.shiftright("_key", bits), bits)
    bucket, inside = cell(64 - DIGIT), None
    for bits in range(64 - DIGIT, 0, -DIGIT):
        rows = source if inside is None else source.withColumn("_cell", cell(bits + DIGIT)).join(inside, "_cell", "left_semi").drop("_cell")
        heavy = rows.groupBy(cell(bits).alias("_cell")).count().filter(F.col("count") > BUCKET_ROWS).select("_cell")
        heavy = stored(heavy)
        if heavy.isEmpty():
            break
        mark = f"_in{bits}"
        made = made.withColumn("_cell", cell(bits)).join(heavy.withColumn(mark, F.lit(True)), "_cell", "left").drop("_cell")
        bucket, inside = F.when(F.col(mark), cell(bits - DIGIT)).otherwise(bucket), heavy
    marks = [c for c in made.columns if c.startswith("_in") and c[3:].isdigit()]
    return made.withColumn(out, bucket).drop("_key", *marks)


def stored(df: DataFrame) -> DataFrame:
    """Written once and read back: a small table that several jobs use."""
    path = f"{shared_folder(df.sparkSession)}/cells-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cut(df: DataFrame, column: str, raw: DataFrame, out: str, buckets: int) -> DataFrame:
    """Cut at approximate quantiles. The cuts are literals of the plan: a recomputed task cannot see different ones."""
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(raw.approxQuantile(column, probabilities, 1 / (2 * buckets))))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = (),
                 bucket: str = "_bucket", descending: bool = False) -> DataFrame:
    """Inclusive running sums in ``order`` (which must be total within a bucket).

    ``bucket`` has to be monotone in the first order column. Output columns are
    named by the keys of ``sums``.
    """
    by = list(by)
    inputs = {f"_in_{k}": c for k, c in sums.items()}
    df = df.withColumns(inputs)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(f"_in_{k}").alias(f"_t_{k}") for k in sums])
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, bucket, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}")
                                           for k in sums])
    local = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, [*by, bucket])
    keep = [c for c in df.columns if c not in inputs]
    return joined.select(*keep, *[(F.sum(f"_in_{k}").over(local) + F.col(f"_o_{k}")).alias(k) for k in sums])


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), **extra: Column) -> DataFrame:
    """Collapse ties before anything is ordered (partial aggregation happens map-side)."""
    aggs = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()]]
    return df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(*aggs)


def exact_quantiles(df: DataFrame, column: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles of arbitrarily large groups, by radix selection.

    The order keys of the values are settled ``DIGIT`` bits a pass: rows are counted by (group, digit), and only the cells
    with a wanted position go on, until each holds at most ``BUCKET_ROWS`` distinct values or is a single one; these are sorted. The collapsed values are stored once, so the passes read a narrow table; what a pass leaves
    is a row for each group and position. Any number of rows may lie between two neighbouring doubles.
    """
    by = list(by)
    counts = value_counts(df.withColumn(column, F.col(column).cast("double")), column, by)
    values = stored(counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col(column).alias("_value"),
                                   order_key(F.col(column)).alias("_key"), F.col("n").alias("_n")))
    keys = [f"_by{i}" for i in range(len(by))]
    same = lambda a, b, names: reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names], F.lit(True))
    rank = lambda p: (F.col("_size") - 1) * F.lit(float(p))
    sides = [F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), f(rank(p)).alias("at"), (rank(p) - F.floor(rank(p))).alias("part"))
             for name, p in probs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    sizes = values.groupBy(*keys).agg(F.sum("_n").alias("_size")).filter(F.col("_size") > 0)
    wanted = sizes.select(*keys, F.inline(F.array(*sides)), F.lit(0).cast("long").alias("_in"))

    def within(names: list[str], bits: int) -> DataFrame:
        """The stored values in the wanted cells."""
        if bits >= 64:
            return values.withColumn("_in", F.lit(0).cast("long"))  # one cell holds all at first
        rows = values.withColumn("_in", F.shiftright("_key", bits))
        return rows.alias("r").join(wanted.select(*names).distinct().alias("c"), same("r", "c", names), "left_semi")

    cells, bits = [*keys, "_in"], 64
    while bits:
        # at most 2^DIGIT cells meet in a window
        found = within(cells, bits).groupBy(*cells, F.shiftright("_key", bits - DIGIT).alias("_cell")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_rows"))
        upto = Window.partitionBy(*cells).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        holds = same("w", "f", cells) & (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_n"))
        wanted = stored(wanted.alias("w").join(found.alias("f"), holds).select(
            *[F.col(f"w.{c}") for c in keys], "q", "side", (F.col("at") - F.col("_before")).alias("at"), "part", F.col("_cell").alias("_in"), F.col("f._rows").alias("_rows")))
        bits -= DIGIT
        if (wanted.agg(F.max("_rows")).first()[0] or 0) <= BUCKET_ROWS:
            break  # small cells are put in order as they are (a cell of all bits is one value)
    upto = Window.partitionBy(*cells).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    found = within(cells, bits).withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    holds = same("w", "f", cells) & (F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_n"))
    wanted = wanted.alias("w").join(found.alias("f"), holds).select(*[F.col(f"w.{c}") for c in keys], "q", "side", "part", "_value")
    value = lambda name, side: F.max(F.when((F.col("q") == name) & (F.col("side") == side), F.col("_value")))
    out = wanted.groupBy(*keys).agg(*[
        (value(q, "lo") + (value(q, "hi") - value(q, "lo")) * F.max(F.when(F.col("q") == q, F.col("part")))).alias(q) for q in probs])
    return out.select(*[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)], *probs)


def average_ranks(df: DataFrame, column: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank and multiplicity ``n``."""
    counts = with_bucket(stored(value_counts(df, column, by)), column)
    cum = running_sums(counts, [F.col(column)], {"_cum": F.col("n")}, by)
    return cum.select(*by, column, "n", (F.col("_cum") - (F.col("n") - 1) / 2).alias(out))


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Consecutive 0-based positions in a total order over all rows.

    Range partitioning puts the order across tasks; the checkpoint pins rows to
    partitions, so position = offset of the partition + position inside it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    pinned = ranged.checkpoint(eager=True).withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", 33)
    sizes = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (pinned.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit(2**33 - 1)))
            .drop("_part", "_mid", "_offset"))
