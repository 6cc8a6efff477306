"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword; one binary n-gram classifier per bit tells the languages whose bit
is set from the others. A classifier is a table of log ratios by hashed n-gram; a text's margin is
their mean over its n-grams. A logistic fit on the sample turns margins into loss inputs and gives
each bit a weight from its error rate. Decoding sums the weighted losses against every codeword
and takes the least; a text whose best two codewords are close is flagged as ambiguous.

Training reads a bounded sample: about ``SAMPLE`` whole documents of each language, chosen by a
hash of id and text. A value of lang is a language; they are taken to be few, as each has a column of
the tables. Counting and predicting take whole texts. The language table and the weights
have sizes set by parameters and the number of languages, not by the documents.

Defined cases: a text that is null or has no letter gets "und" with score 0; with no labelled
document all texts get "und"; with one language all others get it with score 1; repeated rows are
predicted alike; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.arrowtext import pieces
from lumenframe.llm.scratch import materialize

ORDERS = (2, 3, 4)
BITS = 16
SAMPLE = 2000
SMOOTH = 0.5
AMBIGUOUS = 0.7
UNKNOWN = "und"

#: Bytes as the classifiers see them: A-Z lower-cased, other ASCII than letters a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; the last ``order - 1`` are left out."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    code = data[:n].copy()
    for k in range(1, order):
        code = (code << np.uint32(8)) | data[k : n + k]
    if order > 2:  # multiplicative hash of up to 32 bits
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return code


def inside(offsets: np.ndarray, order: int, n: int) -> np.ndarray:
    """Which n-gram starts do not cross the end of a document."""
    ok = np.ones(n, dtype=bool)
    for back in range(1, order):
        at = offsets[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # orders * 2**BITS x bits
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents x bits."""
        data, docs = FOLD[data], len(offsets) - 1
        total, count = np.zeros((docs, self.code.shape[1])), np.zeros(docs)
        for o, order in enumerate(ORDERS):
            code = grams(data, order)
            if not len(code):
                continue
            ok = inside(offsets, order, len(code))
            starts = np.minimum(offsets[:-1], len(code) - 1)
            held = np.add.reduceat(ok.astype(np.int64), starts)
            held[offsets[1:] - offsets[:-1] < order] = 0
            count += held
            table = self.weights[o << BITS : (o + 1) << BITS]
            for b in range(self.code.shape[1]):
                value = table[:, b][code]
                value[~ok] = 0
                sums = np.add.reduceat(value, starts, dtype=np.float64)
                sums[held == 0] = 0
                total[:, b] += sums
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and its share of exp(-loss) over all languages."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        f = margins * self.scale + self.shift
        loss = np.stack([(self.trust * np.logaddexp(0, -f * row)).sum(axis=1) for row in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, share[np.arange(len(best)), best]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All distinct splits for up to 7 languages, else the best of some dense random codes by the
    least distance between rows."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[-1 if i and split >> (i - 1) & 1 else 1 for split in splits] for i in range(n)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = []
    for _ in range(50):
        code = rng.choice([-1, 1], size=(n, bits))
        gram = code @ code.T - 2 * bits * np.eye(n)
        if (np.abs(code.sum(axis=0)) < n).all():
            tries.append((gram.max(), len(tries), code))
    return min(tries)[2]


def labelled(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """lang and text of about ``sample`` documents of each language."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    # written, so that the planner sees how small it is and the texts are not exchanged
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-counts")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(23), "id", "text"), 11) / float(1 << 53)
    return rows.join(counts, "lang").where(draw * F.col("n") < sample).select("lang", "text")


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language met: the buckets' counts, those above 0 only."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, offsets in pieces(batch, 1):
            data = FOLD[data]
            for i in range(lo, hi):
                text = data[offsets[i - lo] : offsets[i - lo + 1]]
                table = seen.setdefault(langs[i], np.zeros(len(ORDERS) << BITS, np.int64))
                for o, order in enumerate(ORDERS):
                    table[o << BITS : (o + 1) << BITS] += np.bincount(grams(text, order), minlength=1 << BITS)
    if seen:
        at = {lang: np.flatnonzero(t).astype(np.int32) for lang, t in seen.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), pa.array([a.tobytes() for a in at.values()], pa.binary()), pa.array([seen[lang][a].tobytes() for lang, a in at.items()], pa.binary())],
            names=["lang", "at", "n"],
        )


def fit(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learns from the rows for which the condition ``train`` holds; None if none is labelled."""
    rows = labelled(docs, train, id_col, text_col, lang_col, sample)
    tables: dict[str, np.ndarray] = {}
    for r in rows.repartition(8).mapInArrow(count_grams, "lang string, at binary, n binary").collect():
        table = tables.setdefault(r["lang"], np.zeros(len(ORDERS) << BITS))
        table[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int64)
    if not tables:
        return None
    languages = sorted(tables)
    code = codewords(len(languages))
    share = np.stack([tables[x] for x in languages]) + SMOOTH
    for o in range(len(ORDERS)):
        part = slice(o << BITS, (o + 1) << BITS)
        share[:, part] /= share[:, part].sum(axis=1, keepdims=True)
    weights = np.zeros((share.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    bits = code.shape[1]
    model = Model(languages, code, weights, np.ones(bits), np.zeros(bits), np.ones(bits))
    if bits:
        calibrate(model, rows)
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fits each bit's scale, shift and trust to the margins of the sample."""
    sc = rows.sparkSession.sparkContext
    shared, bits = sc.broadcast(model), model.code.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, 1):
                m = shared.value.margins(data, offsets)
                full = offsets[1:] > offsets[:-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(full)), pa.array([x.tobytes() for x in m[full]], pa.binary())], names=["lang", "m"])

    got = rows.mapInArrow(run, "lang string, m binary").collect()
    if not got:
        return
    at = {lang: i for i, lang in enumerate(model.languages)}
    who = np.array([at[r["lang"]] for r in got])
    m = np.stack([np.frombuffer(r["m"]) for r in got])
    even = 1 / np.bincount(who, minlength=len(at))[who]  # languages count alike
    even /= even.sum()
    for b in range(bits):
        y, x = (model.code[who, b] > 0).astype(float), m[:, b]
        spread = max(x.std(), 1e-9)
        a, c, z = 1.0, 0.0, x / spread
        for _ in range(50):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            w = even * np.maximum(p * (1 - p), 1e-6)
            g = np.array([(even * (p - y) * z).sum() + 1e-3 * a, (even * (p - y)).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
        wrong = float((even * ((a * z + c > 0) != (y > 0))).sum())
        model.scale[b], model.shift[b] = a / spread, c
        model.trust[b] = np.clip(0.5 * np.log((1 - wrong + 1e-3) / (wrong + 1e-3)), 0.05, 3)
    shared.unpersist()


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """doc_id, the ``extra`` columns, lang_pred, score, ambiguous."""
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), *extra, letter.alias("_letter"), F.when(letter, F.col(text_col)).alias("_text"))
    fields = rows.drop("_letter", "_text")
    if model is None:
        return fields.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared, width = rows.sparkSession.sparkContext.broadcast(model), len(fields.columns)
    schema = T.StructType(list(fields.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            letter = batch.column(width).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch, width + 1):
                best, score = model.decode(model.margins(data, offsets))
                known = letter[lo:hi]
                best, score = np.where(known, best, len(model.languages)), np.where(known, score, 0.0)
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(width)]
                columns += [pa.array(names[best], pa.string()), pa.array(score), pa.array(known & (score < AMBIGUOUS))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = fit(docs, ~held)
    return predict(docs, model, extra=(held.alias("held_out"),))


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
