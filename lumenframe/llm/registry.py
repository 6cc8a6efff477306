"""All queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from lumenframe.llm import ann, bpe, chat, jaccard, langid, mixing, pseudonyms, quality, sharding, urlfilter

MODULES = [chat, pseudonyms, jaccard, urlfilter, quality, sharding, bpe, ann, langid, mixing]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
