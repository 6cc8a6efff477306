"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join, in
DataFrame functions only.

Two listings are looked up. Rules hold a verdict, a host and a path; a rule fits a URL whose host is
the rule's or a subdomain of it and whose path starts with the rule's, and the longest that fits
decides. A URL's host suffixes meet the rules' hosts first, so that only the path lengths which the
rules of these hosts have are tried, as keys host-suffix + path-prefix. URLs that no rule fits are
judged by the second listing, of canonical URLs to block. Each lookup first passes a Bloom filter; keys
that it lets through meet the listing in an exact hash join, which removes the false positives. In
the joins of rules, a key that many URLs have (such as "com") is dealt over several partitions.

The canonical form drops the scheme, user, default port, leading "www.", trailing dot and fragment;
lower-cases A-Z of the host; decodes percent escapes of unreserved characters and writes others in
capitals; folds repeated slashes and drops a trailing one; drops parameters that only track (``utm_*``
and ``TRACKING``) and sorts the others.

The Bloom filter has 256-bit blocks, about ``BITS`` bits a key and at most ``MOST_BLOCKS`` blocks, so
its table of blocks, which is broadcast, has a size bound that no listing exceeds; a key sets one bit
in each of its block's four words. A larger listing lets more keys through to the exact join, nothing
else.

Defined cases: null and text without "://" have an empty host and path, no canonical form, and fit
nothing; repeated URLs are judged alike; rules listed twice with both verdicts block; very long URLs
are judged whole; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.bloom import MOST_BLOCKS, build_bloom, pass_bloom
from lumenframe.llm.scratch import materialize
from lumenframe.operators.joins import salted

#: (verdict, host, path) of the registered query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LISTING = "verdict string, host string, path string"
#: Labels of hosts whose pages the registered query lists.
CONDEMNED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: Parameters of a query string, beside utm_*, that do not tell pages apart.
TRACKING = ["fbclid", "gclid", "ref", "sid"]
BITS = 8
#: Partitions over which a key of the rules is dealt.
SALTS = 8


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host, path and telling parameters in the form in which URLs are listed; null without a host."""
    host = F.regexp_replace(url_host(url), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^(?:www\.)+(?=.)|\.+$", "")
    path = F.regexp_replace(F.regexp_replace(escapes(url_path(url)), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    telling = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^(?:utm_[^=]*|{'|'.join(TRACKING)})(?:=|$)"))
    asked = F.when(F.size(telling) > 0, F.concat(F.lit("?"), escapes(F.array_join(F.array_sort(telling), "&")))).otherwise("")
    return F.when(host != "", F.concat(host, path, asked))


def escapes(text: Column) -> Column:
    """Percent escapes of letters, digits, "-", ".", "_" and "~" decoded, others in capitals."""
    code = lambda x: F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
    one = lambda x: (
        F.when(~x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), x))
        .when(F.chr(code(x)).rlike(r"^[A-Za-z0-9._~-]$"), F.concat(F.chr(code(x)), x.substr(3, 1 << 30)))
        .otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), x.substr(3, 1 << 30))))
    parts = F.split(text, "%")
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def rule_keys(rules: DataFrame) -> DataFrame:
    """key, host, rule, verdict, length, labels, path_length: one row per rule; block wins over allow."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    keyed = rules.select("verdict", host.alias("host"), path.alias("path"))
    return keyed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat_ws("\n", "host", "path").alias("key"), "host",
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length(F.concat("host", "path")).alias("length"),
        n_labels("host").alias("labels"),
        F.length("path").alias("path_length"),
    )


def n_labels(host: str) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def bloom_blocks(keys: DataFrame) -> int:
    """Blocks for ``BITS`` bits a key, up to the bound. ``keys``: a table already written."""
    return min(MOST_BLOCKS, 1 << max(0, keys.count() * BITS // 256).bit_length())


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row, best (length, rule, verdict): the longest rule that fits each URL that any fits. ``urls``:
    row, host, path."""
    rules = materialize(rule_keys(rules), "url-rules")
    hosts = materialize(rules.groupBy("host").agg(F.collect_set("path_length").alias("lengths")), "url-rule-hosts")
    deepest = rules.agg(F.max("labels")).first()[0] or 0
    labels = f"least(length(host) - length(translate(host, '.', '')) + 1, {max(1, deepest)})"
    tails = F.expr(f"transform(sequence(1, {labels}), k -> substring_index(host, '.', -k))")
    tails = urls.where("host <> ''").select("row", "path", F.explode(tails).alias("host"))
    near = salted(pass_bloom(tails, "host", build_bloom(hosts, "host", bloom_blocks(hosts)), bloom_blocks(hosts)), hosts, ["host"], SALTS)
    tries = near.select("row", "host", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    tries = tries.select("row", F.concat_ws("\n", "host", F.expr("substring(path, 1, n)")).alias("key"))
    possible = pass_bloom(tries, "key", build_bloom(rules, "key", bloom_blocks(rules)), bloom_blocks(rules))
    exact = salted(possible, rules.select("key", "rule", "verdict", "length"), ["key"], SALTS)
    return exact.groupBy("row").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, passed (whether the filter of listed URLs let it through),
    listed (whether the exact join found it).

    ``rules``: verdict, host, path; ``listed``: column url, URLs to block in any form.
    """
    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("key"))
    urls = materialize(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    best = fitting_rules(urls.select("row", "host", "path"), rules)
    keys = materialize(listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct(), "url-list")
    blocks = blocks or bloom_blocks(keys)
    passed = pass_bloom(urls.where("key is not null").select("row", "key"), "key", build_bloom(keys, "key", blocks), blocks)
    hits = passed.join(keys.withColumn("listed", F.lit(True)), "key", "left").select("row", F.lit(True).alias("passed"), F.coalesce("listed", F.lit(False)).alias("listed"))
    out = urls.join(best, "row", "left").join(hits, "row", "left")
    seen = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("best.verdict"), F.when(seen, "block").otherwise("allow"))
    return out.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("passed", F.lit(False)).alias("passed"), seen.alias("listed"))


def condemned(pages: DataFrame, url_col: str = "url", labels: list[str] = CONDEMNED) -> DataFrame:
    """url: the URLs of ``pages`` on hosts that have one of ``labels``."""
    url = F.col(url_col)
    return pages.where(F.arrays_overlap(F.split(F.regexp_extract(canonical_url(url), r"^[^/?:]*", 0), r"\."), F.array(*map(F.lit, labels)))).select(url.alias("url"))


def literal_rows(spark: SparkSession, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A few rows of strings as literals of the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = literal_rows(spark, RULES, ["verdict", "host", "path"])
    return judge_urls(pages, rules, condemned(pages)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLES = {
    "op4_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""
}
