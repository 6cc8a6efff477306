from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= cap * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_targets_match_water_filling(docs):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", "d", None, "tiny"][min(5, i % 11)] if i % 50 else "tiny") for i in range(600)] + [(999, "x", "ü"), (998, None, "zero")]
    out = mixing.mix_sizes(docs(rows)).toPandas()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    sizes = {None if k != k else k: int(v) for k, v in sizes.items()}
    want = fill(sizes)
    for r in out.itertuples():
        key = None if r.source != r.source else r.source
        assert r.target == pytest.approx(want[key]) and r.source_size == sizes[key]
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    taken = out.groupby("source", dropna=False)["taken"].sum()
    for k, v in taken.items():
        k = None if k != k else k
        assert abs(v - want[k]) <= max(7, 0.02 * want[k])


def test_hot_source_meets_its_target(docs):
    rows = [(i, "w " * (1 + i % 13), "hot" if i % 3 else f"s{i % 30}") for i in range(3000)]
    out = mixing.mix_sizes(docs(rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"))
    assert all(abs(r.t - r.g) <= 13 for r in out.collect())


def test_reruns_agree_and_rows_stay_whole(docs):
    df = docs([(i, "a b c " * (i % 5), f"s{i % 4}") for i in range(300)]).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1))
    a, b = mixing.mix(df), mixing.mix(df.repartition(7))
    assert a.columns == df.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = {r.doc_id: r.copies for r in mixing.mix_sizes(df.drop("size", "copies")).collect()}
    got = {r.doc_id: r["count"] for r in a.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_edge_tables(docs):
    assert mixing.mix_sizes(docs([]).limit(0)).count() == 0
    assert mixing.mix(docs([]).limit(0)).count() == 0
    nothing = mixing.mix_sizes(docs([(1, None), (2, ""), (None, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 3
    one = mixing.mix_sizes(docs([(1, "a b c", "x")])).first()
    assert (one.target, one.taken) == (3.0, 3)
    twice = mixing.mix_sizes(docs([(1, "a b", "x"), (1, "a b", "x")])).collect()
    assert [r.taken for r in twice] == [2, 2]


def python_sample(units, rest):
    """Pareto sample of words in plain Python. ``units``: (size, u); gives the set of indices taken,
    and the inclusion probabilities."""
    low, high = 0.0, float(sum(s for s, _ in units))
    for _ in range(200):  # bisection for the scale
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, mid * s) * s for s, _ in units) < rest else (low, mid)
    p = [min(1.0, high * s) for s, _ in units]
    q = [0.0 if x >= 1 else u / (1 - u) * (1 - x) / x for (_, u), x in zip(units, p)]
    order = sorted(range(len(units)), key=q.__getitem__)
    taken, gap = set(), rest
    for i in order:
        if units[i][0] <= gap:
            taken.add(i)
            gap -= units[i][0]
    taken.update([i for i in order if i not in taken and units[i][0] < 2 * gap][:1])
    return taken, p


@pytest.mark.parametrize("share, seed", [(0.5, 1), (0.13, 2), (1.0, 3), (2.3, 4)])
def test_selection_matches_plain_python(docs, share, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 2, 3, 5, 8, 40, rng.randint(1, 400)]), rng.choice(["a", "a", "b", None])) for i in range(500)]
    df = docs(rows)
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(seed, F.col("doc_id"), F.col("source"), F.col("text")).alias("u")).collect()}
    got = {}
    for r in mixing.mix_sizes(df, share=share, seed=seed).collect():
        got.setdefault(r.source, []).append(r)
    for held in got.values():
        certain = int(held[0].target / held[0].source_size + 1e-12)
        taken, _ = python_sample([(r.size, u[r.doc_id]) for r in held], held[0].target - certain * held[0].source_size)
        assert [r.copies for r in held] == [certain + (i in taken) for i in range(len(held))]


def test_inclusion_follows_size(docs):
    """Over 300 sources with documents of the same sizes, each document is taken about as often as its
    inclusion probability says: in proportion to its words, and always where that reaches 1."""
    sizes = [20 + i // 3 for i in range(180)] + [1500, 4000]
    trials, share = 300, 0.75
    rows = [(t * 1000 + i, "w " * s, f"s{t}") for t in range(trials) for i, s in enumerate(sizes)]
    hits = {r.i: r.n for r in mixing.mix_sizes(docs(rows), weights=(1,), share=share).groupBy((F.col("doc_id") % 1000).alias("i")).agg(F.sum("copies").alias("n")).collect()}
    _, p = python_sample([(s, 0.5) for s in sizes], share * sum(sizes))
    assert p[-1] == p[-2] == 1.0 and hits[180] == hits[181] == trials
    for i in range(180):
        # four standard deviations, and what filling the last gap shifts
        assert abs(hits[i] / trials - p[i]) < 4 * (p[i] * (1 - p[i]) / trials) ** 0.5 + 0.04
    assert sum(hits[i] for i in range(150, 180)) > 2.5 * sum(hits[i] for i in range(30))


def test_inclusion_of_equal_documents_is_even(docs):
    """A source's documents of one size are taken about equally often over seeds."""
    df = docs([(i, "w w", "a" if i < 40 else "b") for i in range(80)]).cache()
    hits = {}
    for seed in range(12):
        for r in mixing.mix_sizes(df, weights=(1, 3), seed=seed).where("source = 'a' and copies > 0").collect():
            hits[r.doc_id] = hits.get(r.doc_id, 0) + 1
    assert sum(hits.values()) == 12 * 20 and len(hits) >= 38 and max(hits.values()) <= 11


def test_long_text_and_equal_sizes(docs):
    rows = [(0, "w " * 30_000, "a"), *((i, "w " * 300, "a") for i in range(1, 201)), *((i, "w " * 3, "a") for i in range(201, 400)), *((i, "w w", "b") for i in range(400, 800))]
    for r in mixing.mix_sizes(docs(rows), share=0.7).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 3


def mixed_by_hand(docs):
    """Copies of each document that is taken, by plain Python but for the random numbers."""
    rows = docs.select("doc_id", "source", "text", mixing.uniform(17, F.col("doc_id"), F.col("source"), F.col("text")).alias("u")).collect()
    by, out = {}, {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.u))
    targets = fill({s: sum(n for _, n, _ in held) for s, held in by.items()})
    for source, held in by.items():
        total = sum(n for _, n, _ in held)
        certain = int(targets[source] / total + 1e-12)
        taken, _ = python_sample([(n, u) for _, n, u in held], targets[source] - certain * total)
        out |= {doc: certain + (i in taken) for i, (doc, _, _) in enumerate(held)}
    return {doc: n for doc, n in out.items() if n}


def test_query_matches_plain_python(spark, sf_dir):
    """The whole query against word counts, water filling and sampling in plain Python."""
    want = mixed_by_hand(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = mixing.op10_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r.taken for r in rows if r.size} == {r.doc_id: r.size * want.get(r.doc_id, 0) for r in rows if r.size}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for held in by.values():
        assert abs(sum(r.taken for r in held) - held[0].target) <= 0.05 * held[0].target  # ten documents each
        assert all(r.taken <= 3 * r.size for r in held)
