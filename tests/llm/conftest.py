from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (id, text[, source[, lang]]); n_chars is filled in."""

    def make(rows):
        full = []
        for r in rows:
            i, text, source, lang = (*r, *["s", "en"][len(r) - 2 :]) if len(r) < 4 else r
            full.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make
