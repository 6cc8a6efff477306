"""Byte-level BPE encoding and decoding with a public vocabulary file.

A text is split at special tokens, then into words by the usual byte-level pattern. A word's bytes
become parts in a contiguous array with the merge rank of each adjacent pair beside it; the least
rank is found by scanning, its boundary deleted, and the two neighbouring ranks refreshed, until
no pair has a rank. Words longer than ``LONG`` bytes use the same merges from a heap over a linked
list, as scans would take quadratic time. Words are encoded once per worker and then looked up; the
table of known words is emptied when it holds ``KNOWN`` of them.

Defined cases: a null or empty text has no tokens and decodes to ""; special tokens inside a text
become their ids and decode to themselves; ids whose bytes are not UTF-8 decode to U+FFFD;
repeated rows are encoded alike; empty tables give empty results. Extra columns are kept, but for
those named ids or decoded, which the results replace.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.arrowtext import bounded_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 256
KNOWN = 100_000
#: Bytes of text for which one output batch is built.
OUT_BYTES = 1 << 22
NO_RANK = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable bytes stand for themselves,
    the others for the letters from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in keep else next(other)) for b in range(256)]


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.first = [ids[c] for c in letters]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a], ids[b]] = rank
            self.merged.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        token_bytes = [b""] * size
        for token, i in ids.items():
            token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        lengths = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merges the parts of one short word in place."""
        get, merged = self.pairs.get, self.merged
        ranks = [get(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges by a heap of (rank, place) over a linked list."""
        get, merged, n = self.pairs.get, self.merged, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := get(pair, NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or get((parts[i], parts[j]), NO_RANK) != rank:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := get((parts[i], parts[after[i]]), NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((parts[h], parts[i]), NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """The word's ids as packed 32-bit integers."""
        parts = [self.first[b] for b in word.encode("utf-8")]
        parts = self.merge(parts) if len(parts) <= LONG else self.merge_long(parts)
        return np.array(parts, dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        known, out, at = self.words, [], 0
        cuts = list(self.at_special.finditer(text)) if self.at_special and any(s in text for s in self.special) else []
        for cut in [*cuts, None]:
            found = self.split(text[at : cut.start()] if cut else text[at:] if at else text)
            try:
                out.append(b"".join(map(known.__getitem__, found)))
            except KeyError:
                if len(known) > KNOWN:
                    known.clear()
                for w in found:
                    if w not in known:
                        known[w] = self.word(w)
                out.append(b"".join(map(known.__getitem__, found)))
            if cut:
                out.append(np.int32(self.special[cut.group()]).tobytes())
                at = cut.end()
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids."""
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        place = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return self.flat[place].tobytes().decode("utf-8", errors="replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` without its text, plus ids (array of int) and, if asked for, decoded (string), which
    is read back from the ids. ``path`` names the vocabulary file, present on every executor."""
    bounded_batches(docs.sparkSession)
    path = path or default_vocabulary()
    keep = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
    fields = [docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)

        def batch_of(rows: pa.RecordBatch, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            columns = [rows.column(k) for k in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(ends), flat)]
            columns += [pa.array(texts, pa.string())] if decoded else []
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        for batch in batches:
            lo, held, ids, texts = 0, 0, [], []
            column = batch.column(len(keep))
            for i in range(batch.num_rows):
                text = column[i].as_py() or ""
                ids.append(vocab.encode(text))
                if decoded:
                    texts.append(vocab.decode(ids[-1]))
                held += len(text)
                if held >= OUT_BYTES:
                    yield batch_of(batch.slice(lo, i + 1 - lo), ids, texts)
                    lo, held, ids, texts = i + 1, 0, [], []
            if ids:
                yield batch_of(batch.slice(lo), ids, texts)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType(fields))


def with_digests(encoded: DataFrame) -> DataFrame:
    """``encode_documents(..., decoded=True)`` with n_tokens, ids_sha256 and decoded_sha256."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed, 256), "decoded_sha256": F.sha2("decoded", 256),
    })


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_digests(encode_documents(docs, decoded=True)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
