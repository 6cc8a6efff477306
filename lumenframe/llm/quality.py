"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured once by array functions inside its own row (no row per word). Failures of
each rule (few words, repeated windows, symbols, repeated lines) are then counted by host. A rule has
a Beta prior, fitted to all hosts' rates by moments, that shrinks each host's rate: the posterior of
few documents stays near the mean of all, that of many follows their own rate. A host is rejected, and
loses all documents, if for some rule its posterior rate less ``SURE`` standard deviations is over the
rule's bound: the prior's mean and ``FAR`` of its standard deviations, so a rate that hosts of this
corpus do not have, but at least ``LEAST`` (a host of mostly good documents is kept even if others
are better) and at most ``MOST`` (a host of which most documents fail goes whatever others do).

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated
rows count as often as they occur; a very long text is measured whole; an empty table gives an empty
result. A word is a run of
characters other than space and U+0009 to U+000D. Extra columns are ignored by ``judge`` and kept
by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Each rule's condition on a document's measures. The first two are the base rules.
RULES = {
    "words": f"n_words < {MIN_WORDS}",
    "repeats": f"n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}",
    "symbols": "n_symbols * 10 > n_words",
    "lines": "n_dup_lines * 100 > n_lines * 30",
}
SURE, FAR, LEAST, MOST = 2.0, 2.0, 0.2, 0.5


def pair_up(column: str, step: int) -> Column:
    """Hashes of each value with the one ``step`` places on, so runs of twice the length."""
    head = f"slice({column}, 1, size({column}) - {step})"
    return F.expr(f"zip_with({head}, slice({column}, {step + 1}, size({column}) - {step}), (a, b) -> xxhash64(a, b))")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed; with
    ``carry`` also _row, the whole row of a document that did not fail."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["doc_id", "host", "_row"] if carry else ["doc_id", "host"]
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), row.alias("_row"), text.alias("text"))
    step = step.select(
        *keys,
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    step = step.select(
        *keys, "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    none = F.array().cast("array<bigint>")
    for width in (1, 2, 4):  # one hash for each run of 2, 4, then 8 words
        step = step.withColumn("h", F.when(F.size("h") > width, pair_up("h", width)).otherwise(none))
    pairs = F.expr("array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))")
    again = F.size(F.array_distinct("h")) < F.size("h")
    step = step.withColumn("s", F.when(again, pairs))
    # positions of hashes that equal a neighbour's in hash order, back in text order
    found = "array_sort(transform(filter(s, (e, j) -> get(s, j - 1).x = e.x or get(s, j + 1).x = e.x), e -> e.i))"
    covered = F.expr(
        f"aggregate({found}, named_struct('n', 0L, 'end', 0L), (a, p) -> named_struct("
        f"'n', a.n + {WINDOW} - greatest(a.end - p, 0L), 'end', p + {WINDOW}L), a -> a.n)"
    )
    step = step.select(*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    step = step.withColumn("base_failed", F.expr(f"({RULES['words']}) or ({RULES['repeats']})"))
    return step.withColumn("_row", F.when(~F.col("base_failed"), F.col("_row"))) if carry else step


def host_rates(measured: DataFrame) -> DataFrame:
    """host, rule, host_docs, host_failed, host_rate (shrunken), bound, bad: a row for each rule."""
    counts = [F.sum(F.expr(f"cast({rule} as bigint)")).alias(name) for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *counts)
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("host_failed")) for name in RULES]))
    hosts = materialize(hosts.select("host", "host_docs", each), "quality-counts")
    rate = posterior("host_failed", "host_docs")
    sure = rate - SURE * F.sqrt(rate * (1 - rate) / (F.col("strength") + F.col("host_docs") + 1))
    joined = hosts.join(F.broadcast(priors(hosts)), "rule")  # one row for each rule
    return joined.select("host", "rule", "host_docs", "host_failed", rate.alias("host_rate"), "bound", (sure > F.col("bound")).alias("bad"))


def posterior(failed: str, docs: str) -> Column:
    """Mean of the Beta posterior of ``failed`` out of ``docs``."""
    return (F.col("mean") * F.col("strength") + F.col(failed)) / (F.col("strength") + F.col(docs))


def priors(hosts: DataFrame) -> DataFrame:
    """rule, mean, strength, bound: the Beta priors, one row for each rule.

    A prior's mean is the mean of the hosts' rates weighted by their documents; its strength
    follows from how much more the rates vary than counts of such size would by chance.
    """
    total = hosts.groupBy("rule").agg(
        F.count(F.lit(1)).alias("k"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"),
        F.sum(F.col("host_docs").cast("double") * F.col("host_docs")).alias("nn"),
        F.sum(F.col("host_failed").cast("double") * F.col("host_failed") / F.col("host_docs")).alias("ff"),
    )
    m = F.col("f") / F.col("n")
    between = (F.col("ff") - F.col("n") * m * m) - (F.col("k") - 1) * m * (1 - m)
    spread = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    # share of the variance m (1 - m) that lies between hosts, in (0, 1)
    rho = F.when((spread > 0) & (m > 0) & (m < 1), between / (spread * m * (1 - m)))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-3)), F.lit(0.999))
    fitted = total.select("rule", m.alias("mean"), rho.alias("rho"))
    usual = F.col("mean") + FAR * F.sqrt(F.col("mean") * (1 - F.col("mean")) * F.col("rho"))
    bound = F.least(F.greatest(usual, F.lit(LEAST)), F.lit(MOST))
    return fitted.select("rule", "mean", (1 / F.col("rho") - 1).alias("strength"), bound.alias("bound"))


def with_hosts(measured: DataFrame) -> DataFrame:
    """Joins the hosts' verdicts back and adds kept."""
    verdicts = host_rates(measured).groupBy(F.col("host").alias("_host")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "host_rate"))).alias("host_rates"),  # one entry for each rule
        F.array_sort(F.collect_list(F.when(F.col("bad"), F.col("rule")))).alias("host_failures"),
    )
    hosts = materialize(verdicts, "quality-hosts")
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["_host"])).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("host_failures") == 0))


def judge(docs: DataFrame, **columns) -> DataFrame:
    """One row per document: the measures, base_failed, kept, and its host's shrunken rates by rule and
    the rules for which the host is rejected."""
    return with_hosts(materialize(features(docs, **columns), "quality-features"))


def keep_good(docs: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that neither fail the base rules nor come from a rejected host."""
    measured = materialize(features(docs, carry=True, **columns), "quality-rows")
    return with_hosts(measured).where("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host").alias("source"))


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^ 	-
]+') AS words FROM d),
win AS (SELECT doc_id, i, hash(list_slice(words, i, i + 7)) AS h, list_slice(words, i, i + 7) AS run
        FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h, run) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(words) AS n_words,
             length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, r.rule, (count(*) FILTER (WHERE CASE r.rule
        WHEN 1 THEN n_words < 20 WHEN 2 THEN n_repeat_words * 100 > n_words * 30
        WHEN 3 THEN n_symbols * 10 > n_words ELSE n_dup_lines * 100 > n_lines * 30 END))::DOUBLE AS f
      FROM b, range(1, 5) AS r(rule) GROUP BY source, r.rule),
t AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h GROUP BY rule),
r AS (SELECT *, CASE WHEN n - nn / n - (k - 1) <= 0 OR m <= 0 OR m >= 1 THEN 0.0
             ELSE ((ff - n * m * m) - (k - 1) * m * (1 - m)) / ((n - nn / n - (k - 1)) * m * (1 - m)) END AS raw FROM t),
p AS (SELECT rule, m, least(greatest(raw, 1e-3), 0.999) AS rho, 1 / least(greatest(raw, 1e-3), 0.999) - 1 AS s FROM r),
g AS (SELECT source, h.n, h.f, p.s, least(greatest(m + 2 * sqrt(m * (1 - m) * rho), 0.2), 0.5) AS bound, (m * s + f) / (s + h.n) AS rate FROM h JOIN p USING (rule)),
v AS (SELECT source, NOT bool_or(rate - 2 * sqrt(rate * (1 - rate) / (s + n + 1)) > bound) AS good FROM g GROUP BY source)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND v.good AS kept, b.source
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
}
