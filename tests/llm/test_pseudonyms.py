from __future__ import annotations

import datetime as dt
import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from lumenframe.llm import pseudonyms


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape(s):
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", s)))


def changed(docs, texts, **how):
    rows = pseudonyms.pseudonymize(docs(list(enumerate(texts))), count_col="n", **how).orderBy("doc_id").collect()
    return [(r.text, r.n) for r in rows]


VALID = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005", "6304000000000000"],
    "phone": ["+1 (559) 555-3817", "+15595553817", "(559) 555-3817", "559-555-3817", "559.555.3817", "+44 20 7946 0958"],
    "ssn": ["123-45-6789"],
    "ip": ["192.168.10.254", "8.8.8.8"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["1984-02-29", "12/31/1999", "1/2/2003", "31.12.1999", "25/12/2001"],
    "email": ["jo.doe-7@mail.example.com"],
}
INVALID = ["4111111111111112", "1234", "123456789012", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "256.1.1.1", "1.2.3", "1.2.3.4.5", "DE88370400440532013000", "2023-02-29", "13/32/2020", "0.4111111111111111", "x@y", "@a.com", "v1.2", "+1 2", "page 12 of 300", "token", "a = 5", "key: short", "9999-12-31"]


@pytest.mark.parametrize("kind", list(VALID))
def test_valid_values_change_within_their_format(docs, kind):
    for value, (text, n) in zip(VALID[kind], changed(docs, [f"see {v}, ok" for v in VALID[kind]])):
        new = text[4:-4]
        assert n == 1 and new != value and text.startswith("see ") and text.endswith(", ok")
        if kind in ("card", "phone", "ssn", "email"):
            assert shape(new) == shape(value)
        if kind == "card":
            assert luhn(new) and new[0] == value[0]
        if kind == "iban":
            assert iban_ok(new) and shape(new)[4:] == shape(value)[4:] and new[:2] == value[:2]
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in new.split(".")) and new.count(".") == 3
        if kind == "date":
            form = "%Y-%m-%d" if "-" in new else "%d.%m.%Y" if "." in new else "%d/%m/%Y" if value.startswith("25/") else "%m/%d/%Y"
            assert dt.datetime.strptime(new, form)
        if kind == "ssn":
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new)


def test_invalid_values_stay(docs):
    texts = [f"see {v}, ok" for v in INVALID]
    assert changed(docs, texts) == [(t, 0) for t in texts]


def test_equal_values_stay_linked_across_punctuation(docs):
    got = [t for t, _ in changed(docs, ["4111111111111111", "4111 1111 1111 1111", "+1 (559) 555-3817", "+15595553817", "(559) 555-3817", "1999-12-31", "31.12.1999", "12/31/1999", "4111111111111111 4111111111111111"])]
    digits = [re.sub(r"\D", "", t) for t in got]
    assert digits[0] == digits[1] and digits[8] == digits[0] * 2
    assert digits[2] == digits[3] and digits[2][1:] == digits[4]
    d = [dt.datetime.strptime(got[i], f) for i, f in ((5, "%Y-%m-%d"), (6, "%d.%m.%Y"), (7, "%m/%d/%Y"))]
    assert d[0] == d[1] == d[2]


def test_keys_matter_and_reruns_agree(docs):
    text = ["4111111111111111 and jo@a.example.com"]
    assert changed(docs, text) == changed(docs, text) != changed(docs, text, key="other")


def test_permutations_have_no_collisions(spark):
    """The Feistel networks as such: all of a small domain."""
    pairs = pseudonyms.feistel("k", "t", "id div 7", "id % 7", "6", "7", "s.l * 7 + s.r")
    assert sorted(r[0] for r in spark.range(42).selectExpr(pairs).collect()) == list(range(42))
    strings = pseudonyms.permute_digits("k", "t", "d")
    got = [r[0] for r in spark.range(1000).selectExpr("lpad(id, 3, '0') AS d").selectExpr(strings).collect()]
    assert sorted(got) == [f"{i:03d}" for i in range(1000)]
    names = pseudonyms.permute_text("k", "t", "d")
    pool = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in pool], "d string").selectExpr(names).collect()]
    assert sorted(got) == sorted(pool)


def test_no_two_days_get_one_string(spark):
    """All 146,097 days in all shapes that are read as them."""
    days = spark.range(146097).selectExpr("date_add(date'1800-01-01', cast(id AS int)) AS day")
    forms = ["yyyy-MM-dd", "M/d/yyyy", "MM/dd/yyyy", "d.M.yyyy", "dd.MM.yyyy", "d/M/yyyy", "dd/MM/yyyy"]
    rows = days.selectExpr("day", "explode(array(" + ", ".join(f"named_struct('form', '{f}', 'm', date_format(day, '{f}'))" for f in forms) + ")) AS x").select("day", "x.*")
    rows = rows.where("form not like 'd%/%' or day(day) > 12").withColumn("new", F.expr(pseudonyms.date("k"))).cache()
    assert rows.where("new rlike '[^0-9./-]' or new is null").count() == 0
    same = rows.groupBy("new").agg(F.count_distinct("day").alias("n"))
    assert same.where("n <> 1").count() == 0
    # one day has one pseudonym day, whatever the shape, and days of the month up to 12 stay so
    parsed = F.coalesce(F.try_to_timestamp("new", F.lit("yyyy-MM-dd")), F.try_to_timestamp("new", F.lit("d.M.yyyy")), F.try_to_timestamp("new", F.lit("M/d/yyyy")), F.try_to_timestamp("new", F.lit("d/M/yyyy"))).cast("date")
    by = rows.withColumn("p", parsed).groupBy("day").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    assert by.where("a is null or a <> b or (day(a) <= 12) <> (day(day) <= 12)").count() == 0
    assert by.select("a").distinct().count() == 146097 == by.where("year(a) between 1800 and 2199").count()
    rows.unpersist()


def keyed(kind, turn, x, key):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{x}".encode()).hexdigest()[:15], 16)


def pair(kind, left, right, a, b, key):
    for k in range(1, 11):
        if k % 2:
            left = (left + keyed(kind, k, right, key)) % a
        else:
            right = (right + keyed(kind, k, left, key)) % b
    return left, right


def digits(kind, d, key):
    u = len(d) // 2
    left, right = pair(kind, int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u), key)
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


def letters(kind, x, key, hexed=False):
    half, alphabets = len(x) // 2, ["0123456789abcdef", "0123456789ABCDEF"] if hexed else ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    if hexed:
        alphabets = alphabets[1:] if x == x.upper() else alphabets[:1]
    parts = [x[:half], x[half:]]
    for k in range(1, 11):
        other = parts[k % 2]
        h = hashlib.sha256(f"{key}|{kind}|{k}|{other.lower() if hexed else other}".encode()).digest()
        out = ""
        for i, c in enumerate(parts[1 - k % 2]):
            alphabet = next((al for al in alphabets if c in al), None)
            out += c if alphabet is None else alphabet[(alphabet.index(c) + h[i % 32]) % len(alphabet)]
        parts[1 - k % 2] = out
    return parts[0] + parts[1]


def laid_out(m, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in m)


def by_hand(kind, m, key):
    """The pseudonym of a valid value, computed without Spark."""
    d = re.sub(r"\D", "", m)
    if kind == "card":
        q = d[0] + digits("card", d[1:-1], key)
        return laid_out(m, next(q + c for c in "0123456789" if luhn(q + c)))
    if kind == "phone":
        c = 0 if m[0] != "+" else 1 if d[0] in "17" else 2
        return laid_out(m, d[:c] + digits("phone", d[c:], key))
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        left, right = pair("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 989901, key)
        return f"{left + 1 + (left >= 665):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"
    if kind == "ip":
        a, b, c, e = map(int, m.split("."))
        left, right = pair("ipv4", a * 256 + b, c * 256 + e, 65536, 65536, key)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "iban":
        w = m.replace(" ", "")
        body = letters("iban", w[4:], key)
        check = 98 - int("".join(str(int(c, 36)) for c in body + w[:2] + "00")) % 97
        it = iter(f"{w[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in m)
    if kind == "email":
        name, _, domain = m.partition("@")
        return letters("email", name.lower(), key) + "@" + domain
    form = {"-": "%Y-%m-%d", ".": "%d.%m.%Y"}.get(re.search(r"\D", m)[0]) or ("%m/%d/%Y" if int(m.split("/")[1]) > 12 or int(m.split("/")[0]) <= 12 else "%d/%m/%Y")
    t = dt.datetime.strptime(m, form)
    month = (t.year - 1800) * 12 + t.month - 1
    first = [dt.date(1800 + i // 12, i % 12 + 1, 1) for i in range(4800)]
    if t.day <= 12:
        x = month * 12 + t.day - 1
        left, right = pair("date", x // 240, x % 240, 240, 240, key)
        new = first[(left * 240 + right) // 12] + dt.timedelta((left * 240 + right) % 12)
    else:
        late = [x for f in first for x in (f + dt.timedelta(k) for k in range(12, 31)) if x.month == f.month]
        y = late.index(t.date())
        while True:
            left, right = pair("date-late", y // 298, y % 298, 297, 298, key)
            y = left * 298 + right
            if y < len(late):
                break
        new = late[y]
    text = new.strftime(form)
    return text if re.match(r"\d\d[./]\d\d[./]|\d{4}-", m) else re.sub(r"\b0", "", text)


def valid_kind(m):
    """The kind of a match that is valid, without Spark; None for others."""
    d = re.sub(r"\D", "", m)
    if re.search("[:=]", m):
        return "secret"
    if "@" in m:
        return "email"
    if m[0].isalpha():
        return "iban" if iban_ok(m) and 2 <= int(m[2:4]) <= 98 else None
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return "ip"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d?([/.])\d\d?\1\d{4}", m):
        forms = ["%Y-%m-%d"] if "-" in m else ["%d.%m.%Y"] if "." in m else ["%m/%d/%Y", "%d/%m/%Y"]
        for form in forms:
            try:
                return "date" if 1800 <= dt.datetime.strptime(m, form).year < 2200 else None
            except ValueError:
                pass
        return None
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        return "ssn" if d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" else None
    if m[0] in "+(" or re.fullmatch(r"\d{3}([-.])\d{3}\1\d{4}", m):
        return "phone" if 8 <= len(d) <= 15 else None
    return "card" if luhn(d) else None


def by_hand_text(text, key):
    """A whole text with its values replaced, computed without Spark; matches are found by the same
    pattern, in another engine."""

    def new(found):
        m = found[0]
        kind = valid_kind(m)
        if kind != "secret":
            return m if kind is None else by_hand(kind, m, key)
        value = re.search(r"[A-Za-z0-9+/_-]+$", m)[0]
        hexed = re.compile("[0-9a-f]+|[0-9A-F]+")
        if hexed.fullmatch(value):
            out = letters("hex", value, key, True)
        else:
            out = letters("secret", value, key)
            while hexed.fullmatch(out):
                out = letters("secret", out, key)
        return m[: len(m) - len(value)] + out

    return None if text is None else regex.sub(re.sub(r"\\k<(\w+)>", r"(?P=\1)", pseudonyms.ANY), new, text)


def test_query_matches_plain_python(spark, sf_dir):
    got = {r.doc_id: r.text for r in pseudonyms.op2_pseudonyms(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {r.doc_id: by_hand_text(r.text, pseudonyms.DEFAULT_KEY) for r in docs}
    assert sum(got[r.doc_id] != r.text for r in docs) > 5


@pytest.mark.parametrize("kind", list(VALID))
def test_pseudonyms_match_an_independent_feistel(docs, kind):
    key = "some key"
    values = [v for v in VALID[kind] if kind != "phone" or v[0] != "+" or v[1] in "17" or v[1:3] == "44"]
    got = [t for t, _ in changed(docs, values, key=key)]
    assert got == [by_hand(kind, v, key) for v in values]


def test_secrets_match_an_independent_feistel(docs):
    key, hexed, other = "k2", "0123456789abcdef0123456789ABCDEF".lower(), "12345678901234567890g"
    got = [t for t, _ in changed(docs, [f"token={hexed}", f"token={hexed.upper()}", f"secret: {other}", "password=zzZZ-99_aa+bb/0123456789"], key=key)]
    assert got[0] == "token=" + letters("hex", hexed, key, True) and got[1] == "token=" + letters("hex", hexed.upper(), key, True)
    new = letters("secret", other, key)
    while re.fullmatch("[0-9a-f]+|[0-9A-F]+", new):
        new = letters("secret", new, key)
    assert got[2] == f"secret: {new}" and got[3] == "password=" + letters("secret", "zzZZ-99_aa+bb/0123456789", key)


def test_secrets_keep_to_their_kind(spark):
    """No secret with one other letter becomes one of hexadecimal digits, which another secret may become."""
    rows = spark.range(400).selectExpr("concat('token=', lpad(id, 20, '0'), 'g') AS m").selectExpr(pseudonyms.secret("k") + " AS new")
    assert rows.where("new rlike '=[0-9a-f]+$'").count() == 0 and rows.distinct().count() == 400


def test_secrets(docs):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    (a, n), (b, _), (c, _) = changed(docs, [f'token = "{key}" x', f'TOKEN = "{key.upper()}"', "api_key: AbC123xyz-AbC123xyz-AbC1"])
    assert n == 1 and re.fullmatch(r'token = "[0-9a-f]{40}" x', a) and key not in a
    assert re.fullmatch(r'TOKEN = "[0-9A-F]{40}"', b) and b[9:49].lower() == a[9:49]
    assert shape(c) == shape("api_key: AbC123xyz-AbC123xyz-AbC1") and "123xyz" not in c


def test_rows_columns_and_edges(docs):
    df = docs([(1, None), (2, ""), (3, "word " * 30_000 + "8.8.8.8"), (3, "8.8.8.8"), (3, "8.8.8.8"), (None, "é 🙂 8.8.8.8 ß")]).withColumn("_m", F.lit("clash")).withColumn("n", F.lit(5))
    out = pseudonyms.pseudonymize(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows[0].text is None and rows[1].text == "" and rows[3] == rows[4]
    assert rows[2].text == "word " * 30_000 + rows[3].text and rows[5].text == f"é 🙂 {rows[3].text} ß"
    assert pseudonyms.pseudonymize(df.limit(0)).count() == 0


def test_query_changes_only_what_it_should(spark, sf_dir):
    before = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pseudonyms.op2_pseudonyms(spark, sf_dir).collect():
        old = before[r.doc_id].text
        assert (r.text != old) == (r.n_pseudonyms > 0)
        assert len(r.text) == len(old) or re.search(r"\d+\.\d+\.\d+\.\d+", old)
        for pattern in (r"[\w.]+@[\w.]+\.com", r"\+1 \(\d{3}\) \d{3}-\d{4}", r'(?i)token = "[0-9a-f]{40}"'):
            assert not set(re.findall(pattern, old)) & set(re.findall(pattern, r.text))
