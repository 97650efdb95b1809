import hashlib

from pyspark.sql import functions as F

from barloom.llm import chat
from barloom.llm.shared import table

NODES = "tree string, conv_id long, node long, parent long, score double, role string, text string"


def read_back(made):
    rows = made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    return {(r.tree, r.leaf): (r.branch_rank, [(t.role, t.text) for t in r.turns], r.loss) for r in rows}


def test_branches_are_ranked_and_round_trip(spark):
    odd = "\\### Assistant: </turn> ok\\\\#"
    nodes = [
        ("t", 1, 1, None, 0.0, "user", odd),
        ("t", 1, 2, 1, 0.5, "assistant", "</turn>\n### user: x</turn>\n"),
        ("t", 1, 3, 1, 2.0, "assistant", ""),
        ("t", 1, 4, 2, 1.5, "a: b\\", "é🙂\\"),
        ("t", 1, 5, 4, None, "assistant", "\\/turn"),
        ("t", 1, 6, 99, 0.0, "system", "its parent is unknown"),
        ("loop", 2, 1, 2, 9.0, "user", "on a cycle"),
        ("loop", 2, 2, 1, 9.0, "assistant", "on a cycle"),
        ("loop", 2, 3, 2, 9.0, "user", "hangs on a cycle"),
        *[("deep", 3, i, i - 1 if i else None, 1.0, "user" if i % 2 else "assistant", f"turn {i}") for i in range(37)],
    ]
    frame = spark.createDataFrame(nodes, NODES).withColumn("leaf", F.lit("x")).withColumn("formatted", F.lit(1))
    by = {(t, n): (role, text) for t, _, n, _, _, role, text in nodes}
    wanted = {
        ("t", 3): (1, [1, 3]),
        ("t", 5): (2, [1, 2, 4, 5]),  # 2.0 each: the smaller leaf goes first
        ("t", 6): (3, [6]),
        ("deep", 36): (1, list(range(37))),
    }
    found = read_back(chat.format_trees(frame))
    assert found.keys() == wanted.keys()
    for (tree, leaf), (rank, path) in wanted.items():
        turns = [by[tree, n] for n in path]
        assert found[tree, leaf] == (rank, turns, "".join(text for role, text in turns if role == "assistant"))
    assert read_back(chat.format_trees(frame, branches=1)).keys() == {("t", 3), ("deep", 36)}
    assert chat.format_trees(frame.limit(0)).count() == 0


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "user", None), (1, 0, "assistant", "tie"), (None, 5, "user", "no id"), (None, 4, "assistant", "x" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit("n"))
    found = read_back(chat.format_trees(chat.turns_as_tree(frame)))
    assert {k[0]: v[1] for k, v in found.items()} == {
        "=1": [("", "first"), ("assistant", "tie"), ("user", ""), ("user", "")],
        "null": [("assistant", "x" * 200_000), ("user", "no id")],
    }


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    talks = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = {(c, len(t), sha("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant"))) for c, t in talks.items()}
    assert {tuple(r)[:5] for r in chat.op1_chat_formatting(spark, sf).collect()} == wanted
