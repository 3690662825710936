import base64
import hashlib
from collections import Counter, defaultdict

import pytest

from fairlead.llm import warc
from fairlead.llm.shared import filesystem, shared_dir


def brute(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = Counter()
    for payload, pages in groups.items():
        best = max((p for p in pages if p is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for p in pages:
            other = best is not None and p != best
            out[(p, len(payload), digest, "revisit" if other else "response", best if other else None)] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.mark.parametrize("broadcast", [0, warc.BROADCAST])
def test_round_trip(spark, pages, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    odd = [(1, None, None), (2, "http://a", ""), (3, "http://a b\r\nX: 1", "x\r\n\r\ny"), (4, None, "x\r\n\r\ny"), (4, None, "x\r\n\r\ny"), (None, "u", "x\r\n\r\ny"), (None, "u", "z"), (None, "u", "z"), (7, "http://é", "漢🙂" * 300_000)]
    odd = spark.createDataFrame([(*r, "clash") for r in odd], "page_id long, url string, html string, hex string").repartition(3)
    for own in (odd, pages, pages.limit(0)):
        assert Counter(map(tuple, warc.round_trip(own).collect())) == brute([(r["page_id"], r["html"]) for r in own.collect()])


def test_selected_records_come_back_whole(spark, pages, monkeypatch):
    folder = shared_dir(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    html = {r["page_id"]: r for r in pages.collect()}
    some = index.where("page_id % 7 = 1 and record_type = 'response'")
    for gap, read in ((0, 1), (warc.GAP, warc.READ)):
        monkeypatch.setattr(warc, "GAP", gap)
        monkeypatch.setattr(warc, "READ", read)
        rows = warc.read_records(spark, some, folder).collect()
        assert len(rows) == some.count() > 0
        for r in rows:
            assert r["payload"].decode() == html[r["page_id"]]["html"] and r["url"] == html[r["page_id"]]["url"]
    assert {r["record_type"] for r in index.select("record_type").collect()} <= {"response", "revisit"}


def test_a_damaged_payload_is_an_error(spark):
    folder = shared_dir(spark, "warc-bad")
    pages = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    index = warc.write_archives(pages, folder)
    name, offset, length = index.select("archive", "offset", "length").first()
    fs, path = filesystem(folder)
    import zlib

    with fs.open_input_file(f"{path}/archives/{name}") as f:
        record = zlib.decompress(f.read(), 31)
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = squeeze.compress(record.replace(b"body", b"bodY")) + squeeze.flush()
    with fs.open_output_stream(f"{path}/archives/{name}", compression=None) as f:
        f.write(data)
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_records(spark, index.withColumn("length", F.lit(len(data))), folder).collect()
