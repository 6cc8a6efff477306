from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import langid

EN = "the quick brown fox and the lazy dog went to the river with a house of stone".split()
DE = "der schnelle braune Fuchs und die faulen Hunde gingen zum Fluss über eine Straße".split()
FI = "nopea ruskea kettu hyppäsi laiskan koiran yli ja meni joelle yöllä".split()


def text(words, i, n=30):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(words, n))


def training(docs):
    return docs([(i, text(w, i), "s", lang) for i, (lang, w) in enumerate([("en", EN), ("de", DE), ("fi", FI)] * 60)])


def test_learns_three_languages(docs):
    model = langid.fit(training(docs), F.lit(True))
    fresh = docs([(1, text(EN, 1000), "s", "fi"), (2, text(DE, 1001), "s", None), (3, text(FI, 1002, 400)), (4, None), (5, "12 !? \n"), (6, ""), (7, text(EN, 1) + " " + text(DE, 2)), (1, text(EN, 1000), "s", "fi")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(fresh, model).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert [by[i][0] for i in (1, 2, 3)] == ["en", "de", "fi"]
    assert [by[i] for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, _, s in got) and len(got) == 8


def test_label_source_and_id_are_no_inputs(docs):
    model = langid.fit(training(docs), F.lit(True))
    a = langid.predict(docs([(1, "the river and the fox", "x", "de")]), model).first()
    b = langid.predict(docs([(99, "the river and the fox", "y", None)]), model).first()
    assert tuple(a)[1:] == tuple(b)[1:]


def test_edge_tables(docs):
    none = langid.fit(docs([(1, "x", "s", None), (2, None, "s", "en")]), F.lit(True))
    assert none is None
    assert langid.predict(docs([(1, "abc")]), none).first()["lang_pred"] == "und"
    one = langid.fit(docs([(1, "hello there", "s", "en")]), F.lit(True))
    assert tuple(langid.predict(docs([(1, "bonjour")]), one).first())[1:] == ("en", 1.0, False)
    assert langid.predict(docs([(1, "x")]).limit(0), one).count() == 0
    clash = docs([(1, "hello")]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("y"))
    assert langid.predict(clash, one).first()["lang_pred"] == "en"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n
    if n > 1:
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 3 else code.shape[1] // 4)
        assert all(len(set(column)) == 2 for column in code.T)


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    b = code.shape[1]
    model = langid.Model(list("abcde"), code, np.zeros((1, b)), np.ones(b), np.zeros(b), np.ones(b))
    for i in range(5):
        for wrong in range(b):
            m = code[i : i + 1] * 2.0
            m[0, wrong] *= -1
            assert model.decode(m)[0][0] == i


def test_margins_do_not_cross_documents(docs):
    model = langid.fit(training(docs), F.lit(True))
    texts = ["ab", "x", "", text(EN, 5), "über", text(FI, 6)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = model.margins(data, offsets)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(whole[i], model.margins(raw, np.array([0, len(raw)]))[0], atol=1e-6)


def by_hand(model, text):
    """(language, score) of one text, gram by gram, without arrays of texts."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    total, count = [0.0] * model.code.shape[1], 0
    for o, order in enumerate((2, 3, 4)):
        for i in range(len(raw) - order + 1):
            code = int.from_bytes(bytes(raw[i : i + order]), "big") & 0xFFFFFFFF
            at = code if order == 2 else (code * 2654435761 & 0xFFFFFFFF) >> 16
            count += 1
            for b in range(len(total)):
                total[b] += float(model.weights[(o << 16) + at, b])
    f = [t / max(count, 1) * model.scale[b] + model.shift[b] for b, t in enumerate(total)]
    loss = [sum(model.trust[b] * math.log1p(math.exp(-f[b] * word[b])) for b in range(len(f))) for word in model.code]
    share = [math.exp(-x) for x in loss]
    best = min(range(len(loss)), key=loss.__getitem__)
    return model.languages[best], share[best] / sum(share)


def test_predictions_match_plain_python(docs):
    model = langid.fit(training(docs), F.lit(True))
    texts = [None, "", "12", "a", "x y", "über", text(EN, 3), text(DE, 4), text(FI, 5, 3), text(EN, 6, 8) + " " + text(FI, 7, 9), "É!", "w " * 30_000 + text(DE, 9, 2000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, score = by_hand(model, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-6)


def test_weights_match_counts_by_hand(docs):
    """The classifiers' tables from counts of grams in plain Python."""
    rows = [(i, text(w, i, 12), "s", lang) for i, (lang, w) in enumerate([("en", EN), ("de", DE), ("fi", FI)] * 20)]
    model = langid.fit(docs(rows), F.lit(True))
    assert model.languages == ["de", "en", "fi"]
    counts = np.full((3, 3 << 16), 0.5)
    for _, t, _, lang in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
        for o, order in enumerate((2, 3, 4)):
            for i in range(len(raw) - order + 1):
                code = int.from_bytes(raw[i : i + order], "big")
                counts[model.languages.index(lang), (o << 16) + (code if order == 2 else (code * 2654435761 & 0xFFFFFFFF) >> 16)] += 1
    for o in range(3):
        counts[:, o << 16 : (o + 1) << 16] /= counts[:, o << 16 : (o + 1) << 16].sum(axis=1, keepdims=True)
    for b in range(model.code.shape[1]):
        want = np.log(counts[model.code[:, b] > 0].mean(axis=0)) - np.log(counts[model.code[:, b] < 0].mean(axis=0))
        assert np.allclose(model.weights[:, b], want, atol=1e-5)


def test_many_values_of_lang(docs):
    """Labels of which there are dozens are languages all the same."""
    rows = [(i, text(EN, i), "s", f"l{i % 40}") for i in range(200)]
    assert len(langid.fit(docs(rows), F.lit(True)).languages) == 40


def test_held_out_accuracy(spark):
    """On the driver's documents, of texts with three words or more."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    out = langid.op9_language_id(spark, sf_dir).toPandas().merge(docs, on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    test = out[out.held_out & (out.text.str.split().str.len() > 2)]
    assert len(test) > 150 and (test.lang == test.lang_pred).mean() > 0.98
