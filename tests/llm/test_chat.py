import hashlib

from pyspark.sql import functions as F

from daystrata.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "\\1 \\b <s>", "a\nb\\n", "<</s>>", "é<s", "", "\\", "[/INST][INST]</s><s>"]
TREE = "conv_id long, node_id long, parent_id long, role string, text string, score double"


def read(frame):
    rows = frame.select("conv_id", "leaf", "rank", "formatted", chat.read_turns(F.col("formatted")).alias("t"),
                        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    return {(r.conv_id, r["rank"]): ([(t.role, t.text) for t in r.t], r.loss, r.leaf) for r in rows}


def test_round_trip_of_conversations(spark):
    rows = [(1, i, ["user", "assistant", "sys\ntem"][i % 3], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 1, "assistant", None), (None, 3, "assistant", "x"), (None, 1, "user", "y"),
             (3, 0, "assistant", "z" * 300_000)] + [(4, i, "assistant" if i % 2 else "user", f"m{i}") for i in range(200)]
    rows += [(5, 0, "user", "same"), (5, 0, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = read(chat.format_branches(chat.replies(frame)))
    want = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault((r[0], 1), []).append((r[2] or "", r[3] or ""))
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == {k: "".join(t for role, t in v if role == "assistant") for k, v in want.items()}


def test_branches_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 5.0), (1, 3, 1, "assistant", "b", 9.0), (1, 4, 2, "user", "c", 0.0),
            (1, 5, 3, "user", "d", 0.0), (1, 6, 3, "user", "e", 0.0), (2, 1, 99, "user", "orphan", 1.0), (3, 1, 2, "user", "loop", 1.0),
            (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "below", 1.0), (1, 6, 3, "user", "e", 0.0), (4, 1, 1, "user", "self", 0.0)]
    frame = spark.createDataFrame(rows, TREE)
    got = read(chat.format_branches(frame, best=2))
    texts = {k: ([t for _, t in v[0]], v[2]) for k, v in got.items()}
    assert texts == {(1, 1): (["q", "b", "d"], 5), (1, 2): (["q", "b", "e"], 6), (2, 1): (["orphan"], 1)}
    ways = {(r.conv_id, r.leaf, r.node_id, r.up) for r in chat.paths(frame).collect()}
    assert {(1, 4, 4, 0), (1, 4, 2, 1), (1, 4, 1, 2), (1, 6, 3, 1)} <= ways and not any(w[0] in (3, 4) for w in ways)


def test_empty(spark):
    assert chat.format_branches(spark.createDataFrame([], TREE)).count() == 0


def test_query_digests(spark):
    from daystrata.llm.catalog import QUERIES
    row = [r for r in QUERIES["op9_reply_trees"](spark, "/root/testdata/sf0.001").collect() if r.conv_id == -1][0]
    t = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(t) and row.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
