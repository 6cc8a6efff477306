from __future__ import annotations

import random
import re

import duckdb
import pytest
from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from lumenframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(40))


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        runs.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_features_match_brute_force(docs):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "one", "# $ %", LONG, LONG + "\n" + LONG, "a " * 30, "x\ny\nx\n\n \nx ", "é ü\u00a0ß " * 12, "a b c d e f g h " * 2, "\x0b\x0c a\x1fb"]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += ["long " * 20_000 + LONG]
    got = {r.doc_id: tuple(r)[2:] for r in quality.features(docs(list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rejected_host_takes_its_documents_along(docs):
    bad = [(i, "too short", "bad") for i in range(60)] + [(60, LONG, "bad")]
    good = [(100 + i, LONG + f" {i}", "good") for i in range(60)] + [(160, "short", "good")] + [(200 + i, LONG, None) for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.judge(docs(bad + good)).collect()}
    assert not any(kept[i] for i in range(61))
    assert all(kept[100 + i] for i in range(60)) and not kept[160]
    assert all(kept[200 + i] for i in range(5))


@pytest.mark.parametrize("rule, text", [("symbols", LONG + " # # # # # #"), ("lines", "\n".join([LONG, "x y", "x y", "x y"]))])
def test_rules_beyond_the_base_reject_hosts(docs, rule, text):
    """A host none of whose documents fails alone goes for what they have in common."""
    rows = [(i, text if i % 2 else LONG, "odd") for i in range(80)] + [(100 + i, LONG if i % 23 else text, f"h{i % 10}") for i in range(900)]
    got = quality.judge(docs(rows)).collect()
    assert not any(r.base_failed for r in got)
    assert {r.host for r in got if not r.kept} == {"odd"}
    assert {tuple(r.host_failures) for r in got if r.host == "odd"} == {(rule,)}


def test_bound_follows_what_hosts_do(docs):
    """A host with a third of failures goes where others have few, and stays where others are alike."""
    some = lambda h, n, every, at: [(at + i, LONG if i % every else "short", h) for i in range(n)]
    clean = some("x", 300, 3, 0) + [r for k in range(40) for r in some(f"h{k}", 100, 50, 1000 * (k + 1))]
    mixed = some("x", 300, 3, 0) + [r for k in range(40) for r in some(f"h{k}", 100, 2 if k % 2 else 9, 1000 * (k + 1))]
    kept = lambda rows: {r.host: r.kept for r in quality.judge(docs(rows)).where("not base_failed").collect()}
    first, second = kept(clean), kept(mixed)
    assert not first["x"] and all(first[f"h{k}"] for k in range(40))
    assert second["x"]


def test_small_hosts_are_shrunk_towards_the_mean(docs):
    rows = [(i, LONG, f"h{i % 10}") for i in range(200)] + [(900, "short", "single"), (901, LONG, "single")]
    got = {r.host: r for r in quality.judge(docs(rows)).collect()}
    assert got["single"].host_rates["words"] < 0.5 and got["h0"].host_rates["words"] < 0.05
    assert got["single"].host_failures == []  # two documents are too few for a verdict


def test_query_where_a_host_is_bad(spark, tmp_path):
    """The driver's documents, one source of which gets its texts cut: query and SQL agree that it goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = F.when(F.col("source") == "src3", F.expr("if((doc_id div 20) % 5 < 4, substr(text, 1, 40), text)")).otherwise(F.col("text"))
    docs.withColumn("text", cut).write.parquet(str(tmp_path / "documents.parquet"))
    got = spark_rows(quality.op5_quality_rules(spark, str(tmp_path)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == duck_rows(con, quality.ORACLES["op5_quality_rules"])
    out = quality.op5_quality_rules(spark, str(tmp_path)).where("not base_failed").collect()
    assert {r.source for r in out if not r.kept} == {"src3"} and not any(r.kept for r in out if r.source == "src3")


def test_keep_good_keeps_columns_rows_and_repeats(docs, spark):
    df = docs([(1, LONG), (1, LONG), (2, None), (3, LONG, None)]).withColumn("host", F.lit("x")).withColumn("kept", F.lit(7))
    got = quality.keep_good(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 1, 3]
    assert quality.keep_good(df.limit(0)).count() == 0
    assert quality.judge(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = spark_rows(quality.op5_quality_rules(spark, sf_dir))
    assert got == duck_rows(connect(sf_dir), quality.ORACLES["op5_quality_rules"])


@pytest.mark.parametrize("n", [7, 8, 9, 15, 16])
def test_window_edges(docs, n):
    text = " ".join(["a"] * n)
    assert quality.features(docs([(1, text)])).first()["n_repeat_words"] == brute(text)[5]
