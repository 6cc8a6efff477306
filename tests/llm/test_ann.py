from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=5):
    out = {}
    for q in queries:
        a = np.asarray(rows[q], dtype=np.float64)
        found = []
        for i, v in rows.items():
            if i != q:
                b = np.asarray(v, dtype=np.float64)
                found.append((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("dim, n, seed", [(64, 900, 1), (7, 400, 2), (130, 300, 3), (1, 40, 4)])
def test_recall_and_scores(spark, dim, n, seed):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, dim))
    rows = {i: np.float32(centre[i % 6] * 0.7 + rng.standard_normal(dim)).tolist() for i in range(n)}
    got = ann.nearest(frame(spark, rows.items()), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows, [i for i in rows if i % 50 == 0])
    hits = 0
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hits += len({i for i, _ in best} & {m[1] for m in mine})
        exact = dict(brute(rows, [q], n)[q])
        assert all(m[2] == pytest.approx(exact[m[1]], abs=1e-12) for m in mine)
    assert hits >= 0.95 * 5 * len(want)


def test_copies_and_ties_go_to_smaller_ids(spark):
    same = [1.0, 2.0, 3.0]
    rows = {i: same if i % 3 else [float(i + 1), -1.0, 0.5] for i in range(600)}
    got = ann.nearest(frame(spark, rows.items()), F.col("vec_id").isin(1, 50, 599)).collect()
    for q in (1, 50, 599):
        assert sorted((r.rank, r.vec_id) for r in got if r.query_id == q) == list(enumerate([i for i in (1, 2, 4, 5, 7, 8) if i != q][:5], 1))


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0])]
    df = frame(spark, rows + [(None, [1.0, 1.0])]).withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]


def test_edge_tables(spark):
    df = frame(spark, [(0, [1.0, 2.0])])
    assert ann.nearest(df, F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(frame(spark, [(0, None), (1, [])]), F.col("vec_id") == 0).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [9.0, 1.0])]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 2), (2, 1)]


def test_exact_mode_and_small_blocks(spark):
    """Vectors without structure, in blocks of 16 rows: the exact mode finds all, in order."""
    rng = np.random.default_rng(12)
    rows = {i: np.float32(rng.standard_normal(24)).tolist() for i in range(700)}
    want = brute(rows, [i for i in rows if i % 50 == 0])
    got = ann.nearest(frame(spark, rows.items()), F.col("vec_id") % 50 == 0, exact=True, block_bytes=16 * 24 * 8).collect()
    assert {q: [i for i, _ in best] for q, best in want.items()} == {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}


def test_clusters_need_few_lists():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((64, 32)) * 3
    tight = centre[np.arange(4000) % 64] + rng.standard_normal((4000, 32)) * 0.1
    ids = np.arange(4000)
    assert ann.Fit(ids, tight, 1 << 20, 5).visits <= 2
    loose = rng.standard_normal((4000, 32))
    assert ann.Fit(ids, loose, 1 << 20, 5).visits > 20
    assert ann.Fit(ids, tight, 1 << 20, 5, exact=True).visits == len(ann.Fit(ids, tight, 1 << 20, 5).c)


@pytest.mark.parametrize("dim", [64, 100, 3])
def test_estimates_and_bounds(dim):
    """Estimates from packed bits are those of the sign codes; few are off by more than the bound."""
    rng = np.random.default_rng(9)
    x, uq, turn = ann.unit(rng.standard_normal((3000, dim))), ann.unit(rng.standard_normal((5, dim))), ann.rotation(dim)
    centre = x[:50].mean(axis=0)
    codes = ann.Codes(x, centre, turn)
    guess, error = codes.estimate(uq, centre, turn, ann.EPSILON)
    o = (x - centre) @ turn.T
    sign = np.where(o > 0, 1, -1) / np.sqrt(dim)
    dense = (uq @ centre)[:, None] + codes.with_centre + ((uq - centre) @ turn.T) @ sign.T * (codes.length / codes.cosine)
    assert np.abs(guess - dense).max() < 0.2 and np.abs(guess - dense).mean() < 0.02
    if dim > 3:
        assert (np.abs(guess - uq @ x.T) > error).mean() < 0.08
        assert abs((guess - uq @ x.T).mean()) < 0.01


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """The registered query against brute force, where the driver measures and above."""
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 50 == 0])
    got = ann.op8_nearest(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == 5 * len(want)
    hits = sum(len({i for i, _ in best} & {r.vec_id for r in got if r.query_id == q}) for q, best in want.items())
    assert hits >= 0.95 * 5 * len(want)
