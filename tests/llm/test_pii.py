"""Pseudonyms against a plain Python version of the same network."""

import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from llm_docs import awkward, table
from whence.llm import pii

KEY = "k"


def number(key, *parts):
    text = "|".join([key, *map(str, parts)])
    return int(hashlib.sha512(text.encode()).hexdigest()[:15], 16)


def network(value, a, b, key):
    left, right = divmod(value, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + number(key, a, b, i, right)) % a
        else:
            right = (right + number(key, a, b, i, left)) % b
    return left * b + right


def digits(d, key):
    n = len(d)
    return str(network(int(d), 10 ** (n // 2), 10 ** (n - n // 2), key)).zfill(n)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10


def filled(form, d):
    it = iter(d)
    return re.sub("[0-9]", lambda _: next(it), form)


def card(m):
    d = re.sub("[^0-9]", "", m)
    body = digits(d[:-1], KEY + "card")
    return filled(m, body + str((10 - luhn(body + "0")) % 10))


def ip(m):
    value = int.from_bytes(map(int, m.split(".")), "big")
    return ".".join(map(str, network(value, 1 << 16, 1 << 16, KEY + "ip").to_bytes(4, "big")))


def day(m):
    first = date(1800, 1, 1)
    return (first + timedelta(network((date.fromisoformat(m) - first).days, 189, 773, KEY + "date"))).isoformat()


def one(spark, text):
    return pii.pseudonymised(table(spark, [text]), KEY).first()


def test_cards_stay_valid_and_invalid_numbers_stay(spark):
    a, b, bad = "4539 1488 0343 6467", "4539148803436467", "4539148803436468"
    r = one(spark, f"pay {a} or {b}, not {bad} or 123456.")
    assert r.text == f"pay {card(a)} or {card(b)}, not {bad} or 123456." and r.pii == ["card", "card"]
    assert luhn(re.sub("[^0-9]", "", card(a))) == 0 and re.sub(" ", "", card(a)) == card(b)


def test_addresses_dates_phones(spark):
    r = one(spark, "at 10.0.0.255, 300.1.1.1 on 1999-12-31 and 1999-02-30, 31.12.1999, 12/31/1999")
    y, m, d = day("1999-12-31").split("-")
    assert r.text == f"at {ip('10.0.0.255')}, 300.1.1.1 on {y}-{m}-{d} and 1999-02-30, {d}.{m}.{y}, {m}/{d}/{y}"
    r = one(spark, "call +1 (017) 555-7713 or (017) 555-7713")
    first = digits("0175557713", KEY + "phone")
    assert r.text == "call " + filled("+1 (017) 555-7713", "1" + first) + " or " + filled("(017) 555-7713", first) and r.pii == ["phone"] * 2


def test_secrets_mails_and_links_between_documents(spark):
    t = 'token = "' + "0123456789abcdef" * 3 + '" to Ann.B@mail.example.com'
    rows = pii.pseudonymised(table(spark, [t, "again " + t, t.replace("Ann", "ann")]), KEY).orderBy("doc_id").collect()
    assert rows[1].text == "again " + rows[0].text and rows[0].pii == ["secret", "email"]
    assert rows[2].text == rows[0].text  # addresses do not differ by case
    token, mail = re.fullmatch('token = "([0-9a-f]{48})" to (u[0-9a-f]{15}@d[0-9a-f]{11}[.]example)', rows[0].text).groups()
    assert "0123456789abcdef" not in token


def test_the_network_is_a_permutation(spark):
    for a, b in ((3, 7), (10, 10), (1, 1)):
        got = spark.range(a * b).select(pii.feistel(F.col("id"), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), "x").alias("v")).collect()
        assert sorted(r.v for r in got) == list(range(a * b))
        assert [r.v for r in got] == [network(i, a, b, "x") for i in range(a * b)]


def test_numbers_of_persons_stay_valid(spark):
    r = one(spark, "ids 123-45-6789 000-12-3456 665-99-9999 667-01-0001")
    assert r.pii == ["ssn"] * 3
    for x in re.findall(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r.text):
        assert x == "000-12-3456" or re.fullmatch(pii.PATTERNS["ssn"], x)


@pytest.mark.parametrize("text", ["", "no numbers", "in 1999 there were 25 of 300", "v1.2.3 and 3.14159 a@b", "a" * 5000 + "@", "1" * 5000])
def test_clean_texts_stay(spark, text):
    r = one(spark, text)
    assert r.text == text and r.pii == []


def test_awkward_rows(spark):
    docs = awkward(spark, extra=True)
    df = pii.pseudonymised(docs, KEY)
    assert df.columns.count("pii") == 1 and df.count() == docs.count()
    assert df.where("text is null").count() == docs.where("text is null").count()
    assert pii.pseudonymised(docs.limit(0), KEY).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
