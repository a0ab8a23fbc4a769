import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import warc

PAGES = [
    (1, "http://www.Example.com/a?q=1", "<p>x</p>"), (2, "https://example.com:8080/", "<p>x</p>"), (3, "http://b.example.com", None), (4, None, ""),
    (5, "not a url\r\nX: y", "é\r\n\r\nz"), (5, "not a url\r\nX: y", "é\r\n\r\nz"), (None, "http://example.com/n", "<p>x</p>"), (None, "http://[bad", "own"),
    (6, "http://www.example.com/a?q=1", "q" * 200_000), (None, "u", "both null"), (None, "u", "both null"),
]


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame([(*p, 1, "k") for p in PAGES], "page_id long, url string, html string, keep int, SHA string").repartition(2)
    segments = warc.write(df)
    return segments, warc.build_index(segments, lines=2)


@pytest.mark.parametrize("limit", [warc.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, built, monkeypatch, limit):
    segments, index = built
    if not limit:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
        segments = warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
        index = warc.build_index(segments)
    want = []
    for i, _, html in PAGES:
        ids = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        top = max(ids, default=None)
        raw = (html or "").encode()
        again = top is not None and i != top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert warc.read_all(segments).count() == len(PAGES)
    found = warc.search(index, spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    got = warc.read_places(segments, found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_segments_are_files(built):
    for r in built[0].collect():
        raw = gzip.decompress(bytes(r.body))
        assert raw.count(b"WARC/1.0\r\n") == len(r.captures) and raw.startswith(b"WARC/1.0\r\n")


def test_index_is_sorted_and_found(spark, built):
    segments, index = built
    blocks = index.orderBy("block").collect()
    assert all(b.first <= b.last for b in blocks) and all(a.last <= b.first for a, b in zip(blocks, blocks[1:])) and sum(b.n for b in blocks) == len(PAGES)
    urls = spark.createDataFrame([("http://www.example.com/a?q=1",), ("http://absent.org/",), (None,)], "url string")
    for sheets in (1, 2, 1000):
        directory = warc.build_directory(index, sheets)
        assert directory.count() >= 6 // sheets
        places = warc.search(index, urls, directory=directory)
        assert sorted(r.page_id for r in places.collect()) == [1, 4, 6]
    rows = warc.read_places(segments, places).collect()
    assert {r.page_id: len(r.html) if r.html is not None else None for r in rows} == {1: None, 4: 0, 6: 200_000}


def test_keys_and_small_payloads(spark):
    assert warc.url_key("https://www.Example.com/A?b") == "com,example,www)/A?b" and warc.url_key("http://h:81") == "h:81)/"
    segments = warc.write(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string"), least=2)
    assert warc.read_all(segments).where(F.col("record_type") == "response").count() == 2
    empty = warc.write(segments.select(F.lit(1).cast("long").alias("page_id"), F.lit("").alias("url"), F.lit("").alias("html")).limit(0))
    assert warc.read_all(empty).count() == 0
    index = warc.build_index(empty)
    assert warc.search(index, segments.selectExpr("'u' AS url")).count() == 0
    assert warc.search(warc.build_index(segments), segments.selectExpr("'u' AS url").limit(0)).count() == 0


def test_a_key_over_many_blocks(spark):
    """One very common URL takes lines in many blocks and sheets; each capture is found once."""
    rows = [(i, "http://a.org/x" if i % 3 else f"http://a.org/{i}", f"p{i}") for i in range(200)]
    segments = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    index = warc.build_index(segments, lines=7)
    asked = spark.createDataFrame([("http://a.org/x",), ("http://a.org/x",), ("http://a.org/9",)], "url string")
    found = warc.search(index, asked, directory=warc.build_directory(index, 3)).collect()
    assert sorted(r.page_id for r in found) == sorted(i for i in range(200) if i % 3 or i == 9)
