"""PII: format-preserving pseudonyms, in DataFrame functions only.

Numbers and dates that pass their validation are permuted within their format by a keyed Feistel
network, so a valid number becomes another valid one and equal values get equal pseudonyms in
every document.  A value in [0, a * b) is split into two digits of radix a and b; eight rounds
add a keyed hash of one to the other.

| kind | found | validated by | permuted |
|-|-|-|-|
| email | local@domain.tld | pattern | keyed hash of the address in the same form, under ``.example`` |
| date | yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy | calendar, years 1800 to 2199 | day number in that 400 year cycle |
| ssn | ddd-dd-dddd | area, group and serial rules | rank among the valid numbers |
| ip | dotted quad | each part below 256 | 32 bits |
| card | 13 to 19 digits, plain or grouped | Luhn sum | all digits but the last, which completes the sum |
| phone | +cc and groups, or (ddd) ddd-dddd | 8 to 15 digits | the last ten digits; without them all but two |
| secret | 32 to 128 hexadecimal digits | pattern | keyed hash, same length and case |

Numbers that fail validation stay as they are.  Null texts stay null, empty ones empty.  Rows are
treated one by one, so repeated rows stay equal; other columns pass through; an existing
column ``pii`` is replaced, or the result can be given another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whence.llm.common import without

ROUNDS = 8
_PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:1[89]|2[01])[0-9]{2}|(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/(?:1[89]|2[01])[0-9]{2})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "ip": rf"(?<![0-9.]){_PART}(?:\.{_PART}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})(?![0-9])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?<![0-9+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: Group numbers of a kind's own pattern begin at 1.
ONE = {k: "^(?:" + p.replace(r"\2", r"\1").replace(r"\3", r"\2") + ")$" for k, p in PATTERNS.items()}
_EPOCH, _DAYS = "1800-01-01", (189, 773)  # 189 * 773 days: the 400 years from then


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _number(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(_hash(key, *parts), 1, 15), 16, 10).cast("bigint")


def feistel(value: Column, a: Column, b: Column, key: str) -> Column:
    """A keyed permutation of the bigints from 0 to a * b - 1."""
    start = F.struct(((value - value % b) / b).cast("bigint").alias("l"), (value % b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = (s["l"] + _number(key, a, b, i, s["r"]) % a) % a
        right = (s["r"] + _number(key, a, b, i, s["l"]) % b) % b
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _permuted(digits: Column, key: str) -> Column:
    """Up to 18 digits, as many as before."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    a, b = F.rpad(F.lit("1"), half + 1, "0").cast("bigint"), F.rpad(F.lit("1"), n - half + 1, "0").cast("bigint")
    return F.lpad(feistel(digits.cast("bigint"), a, b, key).cast("string"), n, "0")


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, the last one counted once."""
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(at, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    body = _permuted(F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 1), key + "card")
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    return _filled(m, F.concat(body, check.cast("string")))


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    n = F.length(d)
    fixed = F.when(~m.startswith("+"), 0).when(n > 10, n - 10).otherwise(2)
    return _filled(m, F.concat(F.substr(d, F.lit(1), fixed), _permuted(F.substr(d, fixed + 1, n - fixed), key + "phone")))


def _ssn(m: Column, key: str) -> Column:
    area = F.substring(m, 1, 3).cast("bigint")
    a = (area - 1 - (area > 666).cast("bigint")) * 99 + F.substring(m, 5, 2).cast("bigint") - 1
    p = feistel(a * 9999 + F.substring(m, 8, 4).cast("bigint") - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), key + "ssn")
    rank = ((p - p % 9999) / 9999).cast("bigint")
    area = ((rank - rank % 99) / 99).cast("bigint") + 1
    return F.format_string("%03d-%02d-%04d", area + (area > 665).cast("bigint"), rank % 99 + 1, p % 9999 + 1)


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.cast("bigint"))
    half = F.lit(1 << 16).cast("bigint")
    p = feistel(value, half, half, key + "ip")
    return F.concat_ws(".", *[F.shiftright(p, k).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for k in (24, 16, 8, 0)])


def _date_parts(m: Column) -> Column:
    """The date of a match, null if the calendar has none."""
    iso = F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2))
    dots = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))
    slashes = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    text = F.when(m.rlike("^[0-9]{4}"), iso).when(m.contains("."), dots).otherwise(slashes)
    return F.try_to_date(text, "yyyy-MM-dd")


def _date(m: Column, key: str) -> Column:
    a, b = (F.lit(x).cast("bigint") for x in _DAYS)
    day = F.date_diff(_date_parts(m), F.lit(_EPOCH).cast("date")).cast("bigint")
    to = F.date_add(F.lit(_EPOCH).cast("date"), feistel(day, a, b, key + "date").cast("int"))
    iso = F.when(m.contains("-"), F.date_format(to, "yyyy-MM-dd")).otherwise(F.date_format(to, "yyyy/MM/dd"))
    return F.when(m.rlike("^[0-9]{4}"), iso).when(m.contains("."), F.date_format(to, "dd.MM.yyyy")).otherwise(F.date_format(to, "MM/dd/yyyy"))


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(F.lower(m), "@", 1), F.substring_index(F.lower(m), "@", -1)
    name = F.concat(F.lit("u"), F.substring(_hash(key + "mail", local, domain), 1, 15))
    return F.concat(name, F.lit("@d"), F.substring(_hash(key + "host", domain), 1, 11), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    token = F.substr(_hash(key + "secret", m), F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]"), F.upper(token)).otherwise(token)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value): kind is null and the value ``m`` itself if validation fails."""
    digits = F.length(_digits(m))
    valid = {
        "email": (m.contains("@"), _email),
        "secret": (m.rlike(ONE["secret"]), _secret),
        "date": (m.rlike(ONE["date"]) & _date_parts(m).isNotNull(), _date),
        "ssn": (m.rlike(ONE["ssn"]), _ssn),
        "ip": (m.rlike(ONE["ip"]), _ip),
        "card": (m.rlike(ONE["card"]) & (_luhn(_digits(m)) % 10 == 0), _card),
        "phone": (m.rlike(ONE["phone"]) & digits.between(8, 15), _phone),
    }
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for kind, (holds, make) in reversed(valid.items()):
        out = F.when(holds, F.struct(F.lit(kind).alias("kind"), make(m, key).alias("value"))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` with pseudonyms in the text, and ``out``: the kinds replaced, in order."""
    docs = without(docs, out)
    holds = F.col(text).rlike("[0-9@]")
    found = F.when(holds, F.regexp_extract_all(F.col(text), F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn(out, F.transform(found, lambda m: pseudonym(m, key)))
    joined = F.concat_ws("", F.flatten(F.zip_with(F.split(F.col(text), ANY, -1), F.col(out), lambda x, y: F.array(x, F.coalesce(y["value"], F.lit(""))))))
    rows = rows.withColumn(text, F.when(F.size(out) > 0, joined).otherwise(F.col(text)))
    return rows.withColumn(out, F.transform(F.filter(out, lambda p: p["kind"].isNotNull()), lambda p: p["kind"])).select(*docs.columns, out)
