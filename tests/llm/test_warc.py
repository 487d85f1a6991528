"""Archives and capture index: round trips against plain hashing, look-ups against a scan."""

import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_docs import prose
from whence.llm import warc
from whence.llm.queries import op11_warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(groups[html or ""], key=lambda p: (p is None, p or 0))
        again = len(raw) >= warc.LEAST and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages():
    rnd = random.Random(5)
    long, tricky = f"<p>{prose(1, 80)}</p>", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 5 + "ß\x00"
    rows = [(7, "https://www.Example.com/a?b=1#c", long), (3, "http://example.com:8080", long), (9, "http://user@a.b.example.com/x\ny", long), (5, None, long)]
    rows += [(None, "http://z.org/", long), (11, None, None), (12, "", ""), (13, "no scheme", "short"), (14, "no scheme", "short")]
    rows += [(20, "http://t.org/1", tricky), (21, "http://t.org/2", tricky), (22, "http://t.org/1", "é" * 50), (23, "http://t.org/1", "é" * 50), (24, "u", "é" * 49 + "x")]
    rows += [(30, "http://same.org/", long * 2), (30, "http://same.org/", long * 2), (None, None, "n" * 200), (None, None, "n" * 200)]
    rows += [(100 + i, f"http://h{rnd.randint(0, 9)}.example.org/{i % 17}", prose(i % 40, 60)) for i in range(150)]
    return rows


@pytest.mark.parametrize("block, archive", [(2, 2000), (3000, 32 << 20)])
def test_pages_come_back(spark, monkeypatch, block, archive):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(5).withColumn("digest", F.lit("mine")).withColumn("first", F.lit("mine"))
    captures, index = warc.archived(df)
    back = warc.read_back(captures, index)
    assert back.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in back.collect()), key=repr) == brute(rows)
    # every capture's range is a whole record, and a whole archive is a plain gzip file
    fs, base = warc.opened(index.folder)
    for r in captures.collect():
        with fs.open_input_file(f"{base}/{r.file}") as f:
            f.seek(r.offset)
            fields, _ = warc.parsed(gzip.decompress(f.read(r.length)))
        assert fields["WARC-Type"] == r.kind
    # look-ups find what a scan finds
    asked = spark.createDataFrame([(u,) for u in ("http://t.org/1", "https://www.Example.com/a?b=1", "http://h1.example.org/3", "http://nowhere.org/", "no scheme")], "url string")
    got = sorted((r.url, r.page_id) for r in warc.found(asked, index).collect())
    want = sorted((a.url, p) for a in asked.collect() for p, u, _ in rows if warc.surt(warc._printable(u)) == warc.surt(warc._printable(a.url)))
    assert got == want and len(got) > 6


def test_keys_sort_by_reversed_host():
    assert warc.surt("https://www.Example.com:81/a?b#c") == "com,example,www:81)/a?b"
    assert warc.surt("http://example.com") == "com,example)/" and warc.surt("http://example.com?q") == "com,example)?q"
    assert warc.capture_key("http://a.b", -5) < warc.capture_key("http://a.b", 3) < warc.capture_key("http://a.b", None)


def test_revisits_hold_no_payload_and_broken_archives_are_told():
    raw = warc.record(2, "http://a.b/", b"x" * 200, "d", (1, "http://c.d/"))
    fields, payload = warc.parsed(raw)
    assert payload == b"" and fields["WARC-Refers-To"] == "<urn:page:1>"
    with pytest.raises(ValueError):
        warc.parsed(raw[:-1])


def test_empty_table(spark):
    df = spark.createDataFrame([], PAGES)
    assert warc.read_back(*warc.archived(df)).count() == 0


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op11_warc(spark, sf).collect()), key=repr) == brute(rows)
