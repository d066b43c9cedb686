"""Reply trees as training conversations: paths by self-joins, branches ranked by score, a reversible template.

Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daystrata.llm.common import written

# Strings that chat tokenizers treat as control tokens, and what stands for them inside a text. A backslash is
# escaped first, so every backslash of an escaped text is followed by one of these letters.
CONTROL = (("<s>", "\\1"), ("</s>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4"))
OPEN, CLOSE = "<s>", "</s>"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    out = _replace(text, "\\", "\\b")
    for raw, safe in CONTROL:
        out = _replace(out, raw, safe)
    return out


def unescape(text: Column) -> Column:
    out = text
    for raw, safe in CONTROL:
        out = _replace(out, safe, raw)
    return _replace(out, "\\b", "\\")


def replies(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as a tree of messages: each answers the one before it.

    Rows of one turn follow by role and text; null roles and texts are empty; a null conv_id is a conversation too. The
    score of a message is its length if an assistant wrote it.
    """
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node_id", F.row_number().over(own).cast("bigint"))
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text",
                       F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("double").alias("score"))


def _on(a: str, b: str, *pairs: tuple[str, str]) -> list[Column]:
    return [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}")) for x, y in (("conv_id", "conv_id"), *pairs)]


def paths(messages: DataFrame) -> DataFrame:
    """``conv_id, leaf, node_id, up`` for every message on the way from a leaf (``up`` 0) to its root.

    Each round joins the ways found so far with the jumps to the 2^k-th ancestor and doubles the jumps by joining them with
    themselves, so a conversation of a thousand turns takes ten rounds. Only ids are joined. A message whose parent is
    missing is a root; leaves below a circle of replies have no root and are left out.
    """
    nodes = written(messages.select("conv_id", "node_id", "parent_id"))
    known = nodes.alias("n").join(nodes.alias("p"), _on("n", "p", ("parent_id", "node_id")), "left_semi")
    jumps = written(known.select("conv_id", "node_id", F.col("parent_id").alias("to")))
    ways = nodes.alias("n").join(jumps.alias("j"), _on("n", "j", ("node_id", "to")), "left_anti").select(
        "conv_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("bigint").alias("up"))
    step, most = 1, nodes.count()
    first = jumps
    while step <= most and not jumps.isEmpty():
        further = ways.alias("w").join(jumps.alias("j"), _on("w", "j", ("node_id", "node_id"))).select(
            "w.conv_id", "leaf", F.col("j.to").alias("node_id"), (F.col("up") + step).alias("up"))
        ways = written(ways.union(further))
        jumps = written(jumps.alias("a").join(jumps.alias("b"), _on("a", "b", ("to", "node_id"))).select(
            "a.conv_id", "a.node_id", F.col("b.to").alias("to")))
        step *= 2
    rooted = ways.alias("n").join(first.alias("j"), _on("n", "j", ("node_id", "node_id")), "left_anti").select("conv_id", "leaf")
    return ways.alias("w").join(rooted.alias("r"), _on("w", "r", ("leaf", "leaf")), "left_semi")


def format_branches(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of every conversation, each as one text: ``conv_id, leaf, rank, score, formatted, loss_mask``.

    ``messages`` has ``conv_id, node_id, parent_id, role, text, score``; of rows with equal ids the smallest counts. A
    branch scores the mean of its messages, ties go to the smaller leaf. A turn is ``<s>role``, a line end, its text,
    ``</s>``; ``loss_mask`` holds the code points (start, end) of the assistants' texts in ``formatted``.
    """
    columns = ["conv_id", "node_id", "parent_id", "role", "text", "score"]
    messages = messages.select(*columns).groupBy("conv_id", "node_id").agg(F.min(F.struct(*columns[2:])).alias("m")).select(
        "conv_id", "node_id", "m.*")
    messages = written(messages)
    ways = written(paths(messages))
    scores = ways.alias("w").join(messages.alias("m"), _on("w", "m", ("node_id", "node_id"))).groupBy("w.conv_id", "leaf").agg(
        F.avg("score").alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.col("score").desc_nulls_last(), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    turn = F.concat(F.lit(OPEN), _replace(escape(F.col("role")), "\n", "\\n"), F.lit("\n"), F.col("body"), F.lit(CLOSE))
    turns = (ways.alias("w").join(chosen.alias("c"), _on("w", "c", ("leaf", "leaf")))
             .select("w.conv_id", "w.leaf", "w.node_id", "w.up", "c.rank", "c.score").alias("w")
             .join(messages.alias("m"), _on("w", "m", ("node_id", "node_id")))
             .select("w.conv_id", "w.leaf", "w.up", "w.rank", "w.score", "m.role", escape(F.col("m.text")).alias("body")))
    turns = turns.select("conv_id", "leaf", "rank", "score", (-F.col("up")).alias("at"), "role", turn.alias("turn"),
                         F.length("body").alias("n"))
    until = Window.partitionBy("conv_id", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("turn")).over(until) - len(CLOSE)
    turns = turns.withColumn("span", F.when(F.col("role") == "assistant", F.struct((end - F.col("n")).alias("start"), end.alias("end"))))
    parts = turns.groupBy("conv_id", "leaf", "rank", "score").agg(
        F.array_sort(F.collect_list(F.struct("at", "turn", "span"))).alias("parts"))
    return parts.select("conv_id", "leaf", "rank", "score", F.array_join(F.col("parts.turn"), "").alias("formatted"),
                        F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role and text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
        cut = F.instr(body, "\n")
        return F.struct(unescape(_replace(F.substring(body, F.lit(1), cut - 1), "\\n", "\n")).alias("role"),
                        unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
