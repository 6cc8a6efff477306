"""The pipeline against its stages' brute-force forms."""

from __future__ import annotations

from collections import Counter

import pytest
from tokenizers import Tokenizer

from lumenframe.llm import bpe, pseudonyms
from test_jaccard import brute as groups
from test_mixing import mixed_by_hand
from test_pseudonyms import by_hand_text
from test_quality import brute as measures

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, kept, sf_dir)
        df.write.parquet(str(tmp_path / name))
        out[name] = kept = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert sorted(kept.columns) == sorted(COLUMNS)
    good = {r.doc_id for r in out["quality"].collect()}
    assert good == {k for k, t in texts.items() if not measures(t)[6]}
    single = {r.doc_id for r in out["near_copies"].collect()}
    assert single == {k for k, (_, c) in groups({k: texts[k] for k in good}, 5, 80).items() if k == c}
    masked = {r.doc_id: r.text for r in out["pseudonyms"].collect()}
    assert set(masked) == single
    assert masked == {k: by_hand_text(texts[k], pseudonyms.DEFAULT_KEY) for k in single}
    copies = mixed_by_hand(out["pseudonyms"])
    assert Counter(r.doc_id for r in out["mixing"].collect()) == Counter(copies)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    rows = out["tokens"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(copies)
    for r in rows:
        assert list(r.ids) == library.encode(masked[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect())) == sorted(str(r) for r in out["tokens"].select("doc_id", "ids_sha256").collect())


def test_empty_and_odd_documents(spark, sf_dir):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "w " * 40, None, "s", 80)], empty.schema)
    for start in (empty, odd):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
