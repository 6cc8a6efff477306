from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import jaccard
from lumenframe.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def least_labels(nodes, pairs):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        top[q] = p
    return {x: find(x) for x in nodes}


def brute(texts, width, percent):
    sets = {k: shingles(t, width) for k, t in texts.items()}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in least_labels(ids, pairs).items()}


def corpus(seed, n=260):
    """Random texts, groups of exact and near copies, chains, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    texts, base, passage = {}, make(80), make(30)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            t = passage + make(rng.randint(0, 6))
        elif kind == 2:
            t = base[: rng.randint(60, 80)] + [f"y{i}"] * (i % 2)
        elif kind == 3:
            t = make(rng.randint(0, 4))
        else:
            t = make(rng.randint(5, 60))
        text = " ".join(t)
        texts[i] = text.upper() if i % 17 == 0 else text
    return texts | {1000: None, 1001: "", 1002: " \n", 1003: "A", 1004: "a"}


@pytest.mark.parametrize("width, percent, seed", [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_groups_match_brute_force(docs, width, percent, seed):
    texts = corpus(seed)
    got = jaccard.jaccard_groups(docs(list(texts.items())), width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(texts, width, percent)


def test_long_chain_is_one_group(docs):
    words = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(words[5 * i : 5 * i + 100]) for i in range(50)}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs(list(texts.items())), 3, 80).collect()}
    assert got == {k: c for k, (_, c) in brute(texts, 3, 80).items()} and set(got.values()) == {0}


def test_edge_tables(docs):
    assert jaccard.jaccard_groups(docs([]).limit(0)).count() == 0
    got = jaccard.jaccard_groups(docs([(7, "a b c d e f"), (7, "a b c d e f"), (3, None), (None, "a b"), (9, "a b")]), 3, 90).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("3", "3"), ("7", "7"), ("7", "7"), ("9", "9"), ("None", "9")]


def test_texts_that_share_an_id(docs):
    """An id with two texts is one node: it ties the groups of both."""
    a, b = "a b c d e f g h", "k l m n o p q r"
    rows = [(2, a), (5, a), (5, b), (9, b), (7, None), (11, b + " s t u v w x y z"), (7, a), (None, a), (None, "x y z")]
    got = jaccard.jaccard_groups(docs(rows), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("11", 14, "11"), ("2", 6, "2"), ("5", 6, "2"), ("5", 6, "2"), ("7", 0, "2"), ("7", 6, "2"), ("9", 6, "2"), ("None", 1, "None"), ("None", 6, "2")]
    kept = jaccard.drop_near_copies(docs(rows), 3, 90).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["11", "2", "None", "None"]


def test_hot_shingles_of_unlinked_documents(docs, monkeypatch):
    """Each document is made of a few of the same sentences, so prefixes share shingles with hundreds or
    thousands of documents, few of which are linked."""
    monkeypatch.setattr(jaccard, "SALTED", 300)
    rng = random.Random(4)
    pool = [" ".join(f"s{k}w{i}" for i in range(7)) for k in range(30)]
    texts = {i: " ".join(rng.sample(pool, rng.randint(5, 9))) for i in range(2200)}
    texts |= {3000 + i: texts[i] + f" tail{i}" for i in range(60)}
    got = jaccard.jaccard_groups(docs(list(texts.items())), 3, 75)
    want = brute(texts, 3, 75)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) > 1500


def test_long_texts(docs):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    other = list(words)
    for i in range(0, 30_000, 400):
        other[i] = f"x{i}"
    texts = {4: " ".join(words), 6: " ".join(other), 8: " ".join(words[:20_000]), 9: "w " * 30_000, 10: "w " * 4}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs(list(texts.items())), 5, 80).collect()}
    assert got == brute(texts, 5, 80) and got[6][1] == 4 and got[8][1] == 8


def test_order_of_counters_does_not_matter(docs, monkeypatch):
    """More counters, or fewer than shingles, give other prefixes and the same groups."""
    texts = corpus(7, 200)
    want = brute(texts, 3, 80)
    for bits in (12, 22):
        monkeypatch.setattr(jaccard, "counter_bits", lambda _, bits=bits: bits)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs(list(texts.items())), 3, 80).collect()}
        assert got == want


def test_suffix_parts_bound_the_difference():
    rng = random.Random(2)
    make = lambda n: np.unique(np.array([rng.randrange(1 << 64) for _ in range(n)], np.uint64))
    common = make(50)
    for extra in (0, 3, 30, 600):
        a, b = np.unique(np.concatenate([common, make(extra)])), np.unique(np.concatenate([common, make(extra)]))
        pa_, pb_ = (jaccard.suffix_parts(s, 5).view(np.uint8).reshape(5, 8).astype(int) for s in (a, b))
        for i in range(5):
            for j in range(5):
                assert abs(pa_[i] - pb_[j]).sum() <= len(set(a[i + 1 :]) ^ set(b[j + 1 :]))
            if extra < 30:
                assert pa_[i].sum() == len(a) - i - 1


def test_one_of_each_group_stays(docs):
    texts = corpus(5, 120)
    df = docs(list(texts.items())).withColumn("component_id", F.lit("clash")).withColumn("n", F.lit(1))
    got = jaccard.drop_near_copies(df, 5, 80)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(k for k, (_, c) in brute(texts, 5, 80).items() if k == c)
    assert jaccard.drop_near_copies(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(120)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert got == least_labels({x for p in real for x in p}, real)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op3_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(texts, 3, 90)
