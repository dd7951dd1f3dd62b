import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from wattline.llm import warc
from wattline.llm.catalog import QUERIES
from wattline.llm.common import new_path

from .conftest import SMALL

PAGES = "page_id long, url string, html string"


def want(rows, least=0):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = last.get(h or "")
        alone = sum((r[2] or "") == (h or "") for r in rows) == 1
        refers = None if alone or len(data) < least or top is None or i == top else top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3 x\r\ny", "WARC/1.1\r\n\r\nbody\r\n\r\n"), (4, None, None), (5, "http://a/5", ""),
    (6, "http://a/6", "é中😀" * 5000), (None, "http://a/n", "<p>one</p>"), (None, "http://a/m", "alone"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"),
]


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("digest", F.lit("clash")).withColumn("file", F.lit(1))
    folder = new_path(spark, "test-warc")
    index = warc.write_archives(pages, folder, least)
    got = warc.read_archives(index, folder, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS, least)
    held = {r.page_id: r.payload for r in got if r.record_type == "response" and r.page_id is not None}
    assert held[6] == ROWS[5][2] and held[3] == ROWS[2][2] and all(r.payload is None for r in got if r.record_type == "revisit")
    some = index.where("page_id in (2, 6)")
    assert sorted(r.page_id for r in warc.read_archives(some, folder).collect()) == [2, 6]


def test_small_archives_and_separate_reads(spark, monkeypatch):
    rows = [(k, f"http://b/{k}", f"page {k} " * 40) for k in range(60)]
    folder = new_path(spark, "test-warc")
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    places = sorted(tuple(r) for r in index.select("file", "offset", "length").collect())
    for (f, at, n), (g, after, _) in zip(places, places[1:], strict=False):
        assert f != g or at + n == after
    assert warc.read_archives(index.where("page_id % 7 = 0"), folder).count() == 9


def test_records_parse_back():
    raw = warc.make_record(9, "http://x/ é\n", b"pay\r\n\r\nload", warc.base32_sha1(b"pay\r\n\r\nload"), None)
    fields, size, payload = warc.parse_record(raw)
    assert fields["WARC-Target-URI"] == "http://x/%20é%0A" and (size, payload) == (11, b"pay\r\n\r\nload")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"pay\r\n", b"pax\r\n"))


def test_empty_table(spark):
    folder = new_path(spark, "test-warc")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES), folder), folder).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op5_warc_index_first"](spark, SMALL).collect()), key=str) == want(rows)
