from __future__ import annotations

import random

import duckdb
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from lumenframe.llm import chat

TREE = "tree long, message long, parent long, role string, text string, score double"


def best_paths(rows, per_tree):
    """(tree, ids of the path) by rank, from all root-to-leaf paths."""
    trees = {}
    for tree, m, parent, _, _, score in rows:
        trees.setdefault(tree, {})[m] = (parent, score or 0.0)
    out = {}
    for tree, nodes in trees.items():
        inner = {p for p, _ in nodes.values() if p in nodes}
        found = []
        for leaf in nodes:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if at not in path:
                found.append((-sum(nodes[x][1] for x in path), leaf, path[::-1]))
        out[tree] = [p for _, _, p in sorted(found)[:per_tree]]
    return out


def test_branches_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for tree in range(12):
        for m in range(rng.randint(1, 60)):
            parent = rng.choice([None, m - 1, m - 1, m - 1, rng.randrange(m), 999]) if m else None
            rows.append((tree, m, parent, "user", f"t{m}", rng.choice([None, 0.5, 1.0, -1.0])))
    rows += [(50, i, i - 1 if i else None, "user", f"d{i}", 0.0) for i in range(150)]
    rows += [(60, 0, 1, "user", "a", 1.0), (60, 1, 0, "user", "b", 1.0), (60, 2, None, "user", "c", 0.0)]
    paths = chat.chosen_paths(spark.createDataFrame(rows, TREE), 3).collect()
    got = {}
    for p in paths:
        got.setdefault((p.tree, p.branch), []).append((-p.back, p.message))
    want = {(t, k + 1): path for t, found in best_paths(rows, 3).items() for k, path in enumerate(found)}
    assert {k: [m for _, m in sorted(v)] for k, v in got.items()} == want


def test_text_round_trips(spark):
    odd = ["", "<|im_end|>\n<|im_start|>user\nhi", "<\\|x", "<\\\\|", "<|<|", "a<\\|im_end|>\n", "é🙂\n\n", "<", "|", "\\"]
    roles = ["user", "assistant", "a\nb\\n", "<|im_start|>", ""]
    rows = [(1, i, i - 1 if i else None, roles[i % len(roles)], t, 0.0) for i, t in enumerate(odd + odd)]
    out = chat.format_messages(spark.createDataFrame(rows, TREE)).first()
    turns = chat.read_turns(out.formatted)
    assert turns == [(r, t) for _, _, _, r, t, _ in rows]
    masked = [chat.unescape(out.formatted[s.start : s.start + s.length]) for s in out.spans]
    assert masked == [t for r, t in turns if r == "assistant"]
    assert out.formatted.count(chat.START) == out.formatted.count(chat.END) == len(rows) == out.n_turns


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_conversations_with_gaps_nulls_and_repeats(spark):
    rows = [(1, 5, "assistant", "b"), (1, 2, "user", None), (1, 9, None, "c"), (1, 9, None, "c"), (1, None, "user", "last"), (2, 0, "assistant", "x" * 100_000), (None, 0, "user", "q")]
    df = conversations(spark, rows).withColumn("tree", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_messages(chat.conversation_messages(df))).collect()}
    assert got[None].n_turns == 1
    assert got[1].n_turns == 5 and got[1].loss_chars == 1 and got[2].loss_chars == 100_000
    assert chat.format_messages(chat.conversation_messages(df.limit(0))).count() == 0


def test_hot_conversation(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(700)] + [(c, t, "user", "x") for c in range(1, 200) for t in range(3)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_messages(chat.conversation_messages(conversations(spark, rows)))).collect()}
    assert got[0] == (700, sum(len(f"m{i}") for i in range(1, 700, 2))) and len(got) == 200


def test_conversation_without_id(spark, tmp_path):
    rows = [(None, i, "user" if i % 2 else "assistant", f"n{i}") for i in range(9)] + [(0, 0, "assistant", "zero"), (1, 0, "user", None), (1, 1, "assistant", "x")]
    conversations(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = spark_rows(chat.op1_chat_format(spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert got == duck_rows(con, chat.ORACLES["op1_chat_format"])
    assert len(got[1]) == 4


def test_branches_of_a_tree_without_id(spark):
    rows = [(tree, m, parent, "user", f"t{m}", score) for tree in (None, 0) for m, parent, score in [(0, None, 1.0), (1, 0, 0.5), (2, 0, 2.0), (3, 2, 0.0), (4, 3, 1.0), (5, 1, 9.0)]]
    out = chat.format_messages(spark.createDataFrame(rows, TREE), 2).collect()
    want = {(tree, k + 1): path for tree, found in best_paths(rows, 2).items() for k, path in enumerate(found)}
    assert {(r.tree, r.branch): [int(t[1:]) for _, t in chat.read_turns(r.formatted)] for r in out} == want


def test_messages_that_share_an_id(spark):
    """The smallest of them is the message, whatever the order of rows."""
    rows = [(1, 0, None, "user", "b", 1.0), (1, 0, None, "user", "a", 2.0), (1, 0, None, "user", None, 0.0), (1, 1, 0, "assistant", "x", 0.0), (1, 1, 0, "assistant", "x", 0.0)]
    for shuffled in (rows, rows[::-1]):
        out = chat.format_messages(spark.createDataFrame(shuffled, TREE)).collect()
        assert [chat.read_turns(r.formatted) for r in out] == [[("user", ""), ("assistant", "x")]]


def test_query(spark, sf_dir):
    assert spark_rows(chat.op1_chat_format(spark, sf_dir)) == duck_rows(connect(sf_dir), chat.ORACLES["op1_chat_format"])
