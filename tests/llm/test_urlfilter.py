from __future__ import annotations

import random
import re

from compare import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from lumenframe.llm import bloom, urlfilter

PAGES = "page_id long, url string, html string"


def fits(host, path, rule):
    _, h, p = rule
    return bool(host) and (host == h or host.endswith("." + h)) and path.startswith(p)


def canonical(url):
    """The form in which URLs are listed, in plain Python."""
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if c.isascii() else c for c in host).rsplit("@", 1)[-1]
    host = re.sub(r"^(www\.)+(?=.)", "", re.sub(r":(80|443)?$", "", host)).rstrip(".")
    if not host:
        return None

    def decode(text):
        fix = lambda m: chr(int(m[1], 16)) if re.fullmatch(r"[A-Za-z0-9._~-]", chr(int(m[1], 16))) else m[0].upper()
        return re.sub("%([0-9A-Fa-f]{2})", fix, text)

    path = re.sub("/$", "", re.sub("/{2,}", "/", decode(slash + path)))
    telling = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|fbclid|gclid|ref|sid)(=|$)", x))
    return host + path + ("?" + decode("&".join(telling)) if telling else "")


def brute(url, rules, listed=()):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = max((r for r in rules if fits(host, path, r)), key=lambda r: len(r[1] + r[2]), default=None)
    if best:
        return host, path, best[1] + best[2], best[0]
    return host, path, None, "block" if canonical(url) in listed and canonical(url) else "allow"


URLS = [
    None, "", "x", "://", "http://", "http://./", "http://www./a", "HTTP://Www.A.b:80/x/#f", "https://u:p@a.b:443//x//y/?b=2&a=1&utm_source=q&ref=z", "http://a.b/x?ref=1", "http://a.b./x",
    "http://a.b/%7Ex%2fy%zz%", "http://a.b/%41%e4?q=%3d&&q=%2D", "http://www.www.a.b", "http://a.b:8080/x", "http://ä.b/é?", "http://a.b/" + "x/" * 20_000, "http://" + "s." * 5_000 + "a.b/x", "http://a.b/x\ny?c\nd",
]


def test_canonical_form_matches_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "i int, url string").select("i", urlfilter.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: canonical(u) for i, u in enumerate(URLS)}
    assert canonical(URLS[8]) == "a.b/x/y?a=1&b=2" and canonical(URLS[11]) == "a.b/~x%2Fy%zz%"


def test_rules_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["com", "a.com", "example.com", "www.example.com", "x.www.example.com", "notexample.com", "net", "b.net", "knet", "EXAMPLE.com", "example.org", "", "ä.net", "a..net"]
    tails = ["", "/", "/en", "/en/", "/en/x", "/es/1", "/fr/?q", "?en/", "#a", "/EN/", "//en/", "/en/\nx", "?a://b.net/es/"]
    urls = [None, "", "nothing", "://", "http://", "mailto:x", "a://b://net/es/"] + [f"{s}://{h}{t}" for s in ("http", "", "x y") for h in hosts for t in tails]
    rng.shuffle(urls)
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES).withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(urlfilter.RULES, urlfilter.LISTING)
    listed = spark.createDataFrame([("http://www.example.org/en/?utm_source=x",), (None,)], "url string")
    out = urlfilter.judge_urls(pages, rules, listed)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {i: brute(u, urlfilter.RULES, {"example.org/en"}) for i, u in enumerate(urls)}
    assert sum(v[3] == "block" and v[2] is None for v in got.values()) >= 3


def test_exact_join_removes_false_positives(spark):
    """A filter too small for its listing lets URLs through that are not listed; none is blocked."""
    pages = spark.range(2000).selectExpr("id AS page_id", "concat('http://h', id % 40, '.org/p/', id, '/?utm_x=1') AS url", "'' AS html")
    listed = spark.range(0, 2000, 4).selectExpr("concat('https://WWW.h', id % 40, '.org/p/', id) AS url")
    none = spark.createDataFrame([], urlfilter.LISTING)
    for blocks in (None, 4):
        got = urlfilter.judge_urls(pages, none, listed, blocks=blocks).collect()
        assert all((r.verdict == "block") == r.listed == (r.page_id % 4 == 0) for r in got)
        assert all(r.passed for r in got if r.listed)
        assert 0 < sum(r.passed and not r.listed for r in got)


def test_many_rules_with_hot_hosts(spark):
    """Rules of thousands of path lengths cost a URL only those of its own host's rules."""
    rules = [("block", "com", "/" + "x" * k) for k in range(40)] + [("allow", f"h{k}.net", "/" + "y" * (k % 900)) for k in range(3000)]
    urls = [f"http://a{k}.com/{'x' * (k % 50)}" for k in range(300)] + [f"http://h{k}.net/{'y' * 899}" for k in range(0, 3000, 10)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, spark.createDataFrame(rules, urlfilter.LISTING), spark.createDataFrame([], "url string")).collect()}
    assert got == {i: brute(u, rules[:40] if ".com" in u else [r for r in rules if r[1] == u.split("/")[2]]) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], urlfilter.LISTING)
    listed = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame([(1, "http://a.b/", None)], PAGES)
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none, listed).collect()] == [(1, "a.b", "/", None, "allow", False, False)]
    assert urlfilter.judge_urls(pages.limit(0), none, listed).count() == 0


def test_both_verdicts_block(spark):
    rules = spark.createDataFrame([("allow", "a.b", "/"), ("block", "A.b", "/")], urlfilter.LISTING)
    pages = spark.createDataFrame([(1, "http://a.b/", None)], PAGES)
    assert urlfilter.judge_urls(pages, rules, spark.createDataFrame([], "url string")).first()["verdict"] == "block"


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    table = bloom.build_bloom(keys, "key", 1 << 10)
    assert table.count() <= 1 << 10
    passed = {r.key for r in bloom.pass_bloom(rows, "key", table, 1 << 10).collect()}
    assert {f"k{i}" for i in range(3000)} <= passed and len(passed) < 3300


def test_joins_behind_a_full_filter_stay_exact(spark):
    rows, ids = spark.range(500).withColumnRenamed("id", "doc"), spark.range(0, 500, 3).withColumnRenamed("id", "doc")
    for blocks in (1, 1 << 10):
        assert {r.doc for r in bloom.only(rows, "doc", ids, blocks).collect()} == set(range(0, 500, 3))
        assert {r.doc for r in bloom.without(rows, "doc", ids, blocks).collect()} == set(range(500)) - set(range(0, 500, 3))


def test_query(spark, sf_dir):
    assert spark_rows(urlfilter.op4_url_filters(spark, sf_dir)) == duck_rows(connect(sf_dir), urlfilter.ORACLES["op4_url_filters"])
