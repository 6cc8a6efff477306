"""Format-preserving pseudonyms for personal numbers and dates, in SQL expressions only.

One pattern finds candidates; each is validated by its kind's own rule and, if valid, replaced by
a keyed Feistel permutation of its kind's values, laid out as the original was. The permutations
depend on the key and kind alone, so equal values get equal pseudonyms in all documents, whatever
their punctuation, and different values get different ones. What fails validation stays.

kind    | valid if                                   | permuted
card    | 13 to 19 digits that pass the Luhn check   | all but first and last digit; last is recomputed
phone   | +country number of 8 to 15 digits, or       | the national digits
        | 10 digits punctuated as a US number        |
ssn     | ddd-dd-dddd, assignable                    | within the assignable numbers
ipv4    | four octets up to 255                      | the 32 bits
iban    | remainder 1 by 97, check digits 02 to 98   | account digits and letters; check digits recomputed
date    | a day from 1800 to 2199 as y-m-d, m/d/y,   | the 57,600 days up to a month's 12th among themselves,
        | d/m/y or d.m.y                             | and the 88,497 later ones
email   | name@domain                                | letters and digits of the name, without regard to case
secret  | 20 or more characters after token, secret, | hexadecimal digits, or letters and digits
        | password or key and a sign                 |

Ten bare digits are no phone number, as any count may look like that. A date with slashes whose first
two numbers are both 12 at most is read as m/d/y.

Defined cases: a null text stays null, with no pseudonyms; an empty text stays empty; repeated
rows change alike; very long texts are treated whole; empty tables give empty results. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
DEFAULT_KEY = "replace-this-key"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
SECRET = r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?[A-Za-z0-9+/_-]{20,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])"
SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])\+(?:[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{8,15}|[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}(?<dot>[-.])[0-9]{3}\k<dot>[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
)
CARD = (
    r"(?<![0-9A-Za-z]|[0-9][.,-])(?:[0-9]{13,19}(?![0-9A-Za-z]|[.,-][0-9])"
    r"|[0-9]{4}(?<gap>[ -])(?:[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{4}(?:\k<gap>[0-9]{3})?|[0-9]{6}\k<gap>[0-9]{5})(?![0-9A-Za-z]))"
)
ANY = "|".join([SECRET, EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD])


def quoted(pattern: str) -> str:
    """A SQL literal of the string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def prf(key: str, kind: str, turn: str, x: str) -> str:
    """60 keyed bits of (kind, round, value)."""
    return f"cast(conv(substr(sha2(concat_ws('|', {quoted(key)}, '{kind}', {turn}, {x}), 256), 1, 15), 16, 10) as bigint)"


def feistel(key: str, kind: str, left: str, right: str, a: str, b: str, out: str) -> str:
    """Permutes (left, right) of Z_a x Z_b: rounds add keyed values of one to the other in turn.
    ``out`` is an expression of s.l and s.r."""
    f_r, f_l = prf(key, kind, "k", "s.r"), prf(key, kind, "k", "s.l")
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), "
        f"(s, k) -> if(k % 2 = 1, named_struct('l', pmod(s.l + {f_r}, {a}), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r + {f_l}, {b}))), s -> {out})"
    )


def with_let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digits_of(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def permute_digits(key: str, kind: str, d: str) -> str:
    """Of a string of 2 to 18 digits, as a string of as many."""
    u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    power = lambda n: f"cast(power(10, {n}) as bigint)"
    out = f"concat(lpad(cast(s.l as string), cast({u} as int), '0'), lpad(cast(s.r as string), cast({v} as int), '0'))"
    return feistel(key, kind, f"substr({d}, 1, cast({u} as int))", f"substr({d}, cast({u} as int) + 1)", power(u), power(v), out)


def lay_out(m: str, new: str) -> str:
    """``m`` with its digits replaced, in order, by those of ``new``."""
    at = f"length(regexp_replace(substr({m}, 1, i), '[^0-9]', ''))"
    return (
        f"array_join(transform(sequence(1, length({m})), i -> "
        f"if(substr({m}, i, 1) between '0' and '9', substr({new}, {at}, 1), substr({m}, i, 1))), '')"
    )


def luhn_digit(p: str) -> str:
    """The check digit that follows the digits ``p``."""
    d = f"cast(substr({p}, i, 1) as int)"
    total = f"aggregate(sequence(1, length({p})), 0, (a, i) -> a + if((length({p}) - i) % 2 = 0, {d} * 2 - if({d} > 4, 9, 0), {d}))"
    return f"cast(pmod(10 - {total} % 10, 10) as string)"


def shift_text(text: str, hashed: str, hexadecimal: bool) -> str:
    """Each letter or digit moved within its own alphabet by a byte of ``hashed`` (64 hex digits)."""
    c = f"substr({text}, i, 1)"
    step = f"cast(conv(substr({hashed}, 2 * ((i - 1) % 32) + 1, 2), 16, 10) as int)"
    move = lambda base, n: f"chr({base} + pmod(ascii({c}) - {base} + {step}, {n}))"
    if hexadecimal:
        place = lambda letters: f"substr('{letters}', pmod(instr('{letters}', {c}) - 1 + {step}, 16) + 1, 1)"
        one = f"if(p.up, {place('0123456789ABCDEF')}, {place('0123456789abcdef')})"
    else:
        one = (
            f"case when {c} between 'a' and 'z' then {move(97, 26)} when {c} between 'A' and 'Z' then {move(65, 26)} "
            f"when {c} between '0' and '9' then {move(48, 10)} else {c} end"
        )
    return f"if(length({text}) = 0, '', array_join(transform(sequence(1, length({text})), i -> {one}), ''))"


def permute_text(key: str, kind: str, x: str, hexadecimal: bool = False) -> str:
    """A Feistel network on a string's halves: rounds shift one half's characters within their
    alphabets by keyed bytes of the other half. Character classes keep their places."""
    up = f"({x} = upper({x}))"
    same = "lower({})" if hexadecimal else "{}"  # hexadecimal digits are equal in either case
    hashed = lambda half: f"sha2(concat_ws('|', {quoted(key)}, '{kind}', k, {same.format(half)}), 256)"
    left = with_let(hashed("p.r"), "h", shift_text("p.l", "h", hexadecimal))
    right = with_let(hashed("p.l"), "h", shift_text("p.r", "h", hexadecimal))
    half = f"cast(length({x}) div 2 as int)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({x}, 1, {half}), 'r', substr({x}, {half} + 1), 'up', {up}), "
        f"(p, k) -> if(k % 2 = 1, named_struct('l', {left}, 'r', p.r, 'up', p.up), named_struct('l', p.l, 'r', {right}, 'up', p.up)), "
        f"p -> concat(p.l, p.r))"
    )


def card(key: str) -> str:
    d = digits_of("m")
    payload = f"concat(substr(d, 1, 1), {permute_digits(key, 'card', 'substr(d, 2, length(d) - 2)')})"
    checked = with_let(f"concat(q, {luhn_digit('q')})", "w", lay_out("m", "w"))
    return with_let(d, "d", f"if(luhn_check(d), {with_let(payload, 'q', checked)}, m)")


def phone(key: str) -> str:
    country = "if(m not like '+%', 0, if(substr(d, 1, 1) in ('1', '7'), 1, 2))"
    whole = with_let(country, "c", f"concat(substr(d, 1, c), {permute_digits(key, 'phone', 'substr(d, c + 1)')})")
    return with_let(digits_of("m"), "d", f"if(length(d) between 8 and 15, {with_let(whole, 'q', lay_out('m', 'q'))}, m)")


def ssn(key: str) -> str:
    area, group, serial = "cast(substr(d, 1, 3) as int)", "cast(substr(d, 4, 2) as int)", "cast(substr(d, 6) as int)"
    valid = f"{area} not in (0, 666) and {area} < 900 and {group} > 0 and {serial} > 0"
    out = (
        "concat(lpad(cast(s.l + 1 + if(s.l >= 665, 1, 0) as string), 3, '0'), "
        "lpad(cast(s.r div 9999 + 1 as string), 2, '0'), lpad(cast(s.r % 9999 + 1 as string), 4, '0'))"
    )
    new = feistel(key, "ssn", f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", out)
    return with_let(digits_of("m"), "d", f"if({valid}, {with_let(new, 'q', lay_out('m', 'q'))}, m)")


def ipv4(key: str) -> str:
    part = lambda i: f"cast(split_part(m, '.', {i}) as bigint)"
    out = "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)"
    return feistel(key, "ipv4", f"{part(1)} * 256 + {part(2)}", f"{part(3)} * 256 + {part(4)}", "65536", "65536", out)


def iban(key: str) -> str:
    as_digits = lambda x: (
        f"array_join(transform(sequence(1, length({x})), i -> if(substr({x}, i, 1) between 'A' and 'Z', "
        f"cast(ascii(substr({x}, i, 1)) - 55 as string), substr({x}, i, 1))), '')"
    )
    mod = lambda x: with_let(as_digits(x), "z", "aggregate(sequence(1, length(z)), 0, (a, i) -> (a * 10 + cast(substr(z, i, 1) as int)) % 97)")
    body = permute_text(key, "iban", "substr(d, 5)")
    check = mod("concat(q, substr(d, 1, 2), '00')")
    built = with_let(f"lpad(cast(98 - {check} as string), 2, '0')", "y", "concat(substr(d, 1, 2), y, q)")
    spaced = (
        "array_join(transform(sequence(1, length(m)), i -> if(substr(m, i, 1) = ' ', ' ', "
        "substr(w, length(replace(substr(m, 1, i), ' ', '')), 1))), '')"
    )
    whole = with_let(body, "q", with_let(built, "w", spaced))
    return with_let("replace(m, ' ', '')", "d", f"if({mod('concat(substr(d, 5), substr(d, 1, 4))')} = 1 and substr(d, 3, 2) between '02' and '98', {whole}, m)")


def walk(x: str, step, outside: str, most: int) -> str:
    """``step`` of x, and again while the result y is ``outside`` the values that x is one of: a
    permutation of these values if ``step`` is one of more."""
    return f"aggregate(sequence(1, {most}), {x}, (y, w) -> if(w = 1 or {outside}, {step('y')}, y))"


def date(key: str) -> str:
    """Days up to the 12th of a month and later ones are permuted apart, by the same permutations for
    all shapes: what reads as m/d/y or d/m/y stays so, and no two days get one string."""
    day = (
        "case when m like '%-%' then try_to_timestamp(m, 'yyyy-MM-dd') when m like '%.%' then try_to_timestamp(m, 'd.M.yyyy') "
        "else coalesce(try_to_timestamp(m, 'M/d/yyyy'), try_to_timestamp(m, 'd/M/yyyy')) end"
    )
    padded = "(m like '__/__/%' or m like '__.__.%')"
    shape = (
        f"case when m like '%-%' then 'yyyy-MM-dd' when m like '%.%' then if({padded}, 'dd.MM.yyyy', 'd.M.yyyy') "
        f"when try_to_timestamp(m, 'M/d/yyyy') is not null then if({padded}, 'MM/dd/yyyy', 'M/d/yyyy') else if({padded}, 'dd/MM/yyyy', 'd/M/yyyy') end"
    )
    months = "((year(t) - 1800) * 12 + month(t) - 1)"
    begins = lambda k: f"add_months(date'1800-01-01', cast({k} as int))"
    # 57,600 early days, by month and day
    early = feistel(key, "date", f"({months} * 12 + day(t) - 1) div 240", f"({months} * 12 + day(t) - 1) % 240", "240", "240", "s.l * 240 + s.r")
    early = with_let(early, "e", f"date_add({begins('e div 12')}, cast(e % 12 as int))")
    # 88,497 later ones, counted without the early ones; 297 * 298 are nine more
    past = lambda k: f"(datediff({begins(k)}, date'1800-01-01') - 12 * ({k}))"
    late = walk(
        f"cast({past(months)} + day(t) - 13 as bigint)",
        lambda y: feistel(key, "date-late", f"{y} div 298", f"{y} % 298", "297", "298", "s.l * 298 + s.r"), "y >= 88497", 10)
    guess = "cast(floor(e / 18.436875) as int)"  # later days of a month on average; the count is never off by a month's
    found = f"element_at(filter(sequence({guess} - 1, {guess} + 1), k -> {past('k')} <= e), -1)"
    late = with_let(late, "e", with_let(found, "f", f"date_add({begins('f')}, cast(e - {past('f')} + 12 as int))"))
    inside = f"if(year(t) between 1800 and 2199, date_format(if(day(t) <= 12, {early}, {late}), {shape}), m)"
    return f"coalesce({with_let(f'cast({day} as date)', 't', inside)}, m)"


def email(key: str) -> str:
    name = "lower(substring_index(m, '@', 1))"
    return f"concat({permute_text(key, 'email', name)}, substr(m, instr(m, '@')))"


def secret(key: str) -> str:
    value = "regexp_extract(m, '([A-Za-z0-9+/_-]+)$', 1)"
    hexed = "rlike '^([0-9a-f]+|[0-9A-F]+)$'"
    other = walk("v", lambda y: permute_text(key, "secret", y), f"y {hexed}", 64)
    new = f"if(v {hexed}, {permute_text(key, 'hex', 'v', True)}, {other})"
    return with_let(value, "v", f"concat(substr(m, 1, length(m) - length(v)), {new})")


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of the match ``m``; ``m`` itself where it is not valid."""
    whole = lambda p: quoted(f"^(?:{p})$")
    return (
        f"case when m rlike '[:=]' then {secret(key)} when m like '%@%' then {email(key)} "
        f"when m rlike '^[A-Z]' then {iban(key)} when m rlike {whole(IPV4)} then {ipv4(key)} "
        f"when m rlike {whole(DATE)} then {date(key)} when m rlike {whole(SSN)} then {ssn(key)} "
        f"when m rlike {whole(PHONE)} then {phone(key)} else {card(key)} end"
    )


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str = DEFAULT_KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with its text's personal values replaced; ``count_col`` names a column for their number."""
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_t")
    step = docs.select(row, text)
    some = F.col("_t").rlike("[0-9@:=]")
    step = step.withColumn("_m", F.when(some, F.regexp_extract_all("_t", F.lit(ANY), F.lit(0))))
    step = step.withColumn("_n", F.when(F.size("_m") > 0, F.expr(f"transform(_m, m -> {pseudonym(key)})")))
    gaps = F.split("_t", ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, "_n", lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    changed = F.when(F.col("_n").isNull(), F.col("_t")).otherwise(joined)
    new = F.size(F.filter(F.arrays_zip("_m", "_n"), lambda z: z["_m"] != z["_n"]))
    out = [changed.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c != count_col]
    if count_col:
        out.append(F.when(F.col("_n").isNull(), 0).otherwise(new).cast("long").alias(count_col))
    return step.select(*out)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), count_col="n_pseudonyms")


QUERIES = {"op2_pseudonyms": op2_pseudonyms}
ORACLES: dict[str, str] = {}
