from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.default_vocabulary())


def samples():
    rng = random.Random(4)
    out = ["", " ", "  a", "\n\n", "it's I'LL we've", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|><|endoftext|>c", "<|endoftext|", "é🙂\u200d\ufeff", "\x00\x1f\x85\xa0", "1234567890 ²½Ⅷ", "a" * 3000, "ab" * 400 + "!" * 600]
    out += ["".join(chr(c) for c in range(a, a + 97) if not 0xD800 <= c <= 0xDFFF) for a in range(0, 0x3000, 97)]
    out += ["".join(rng.choice("abcdeé <|\n'12.") for _ in range(rng.randint(1, 700))) for _ in range(60)]
    return out


def test_ids_and_text_match_the_library(library, vocab):
    for text in samples():
        want = library.encode(text, add_special_tokens=False).ids
        got = vocab.encode(text)
        assert got.tolist() == want
        assert vocab.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_both_merge_forms_agree(vocab):
    rng = random.Random(5)
    for _ in range(200):
        parts = [vocab.first[b] for b in bytes(rng.choice(b"abcdeths in") for _ in range(rng.randint(1, 300)))]
        assert vocab.merge(list(parts)) == vocab.merge_long(list(parts))


def test_ids_that_are_no_text(library, vocab):
    import numpy as np

    broken = np.array([vocab.first[0xC3], vocab.first[0x41], vocab.first[0xFF]])
    assert vocab.decode(broken) == library.decode(broken.tolist(), skip_special_tokens=False)


def test_table_of_words_is_emptied(vocab, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    fresh = bpe.Vocabulary(bpe.default_vocabulary())
    for text in ("a b c d e f", "g h i", "a b c"):
        assert fresh.encode(text).tolist() == vocab.encode(text).tolist()
    assert len(fresh.words) <= 9


def test_documents(docs, library):
    df = docs([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (5, "word " * 30_000)]).withColumn("ids", F.lit("clash"))
    out = bpe.encode_documents(df, decoded=True)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "decoded"]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()}
    assert got[1] == ([], "") and got[2] == ([], "") and got[None][1] == "x"
    assert got[3] == (library.encode("hello world").ids, "hello world") and len(got[5][0]) > 30_000
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.op7_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
