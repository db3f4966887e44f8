import base64
import hashlib

import pytest

from parsefold.llm import warc
from parsefold.llm.queries import OP6_SQL, op6_warc
from tests.test_queries import compare

PAGE = "page_id long, url string, html string, digest string, size string, first string, body string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], PAGE)


def read(df):
    names = ("payload_bytes", "payload_digest", "warc_type")
    return sorted(((*[r[n] for n in names], r.page, r.refers) for r in df.select("*", warc.page_of(df.record_id).alias("page"), warc.page_of(df.refers_to).alias("refers")).collect()), key=str)


def plain(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same and len(b) >= min_bytes and sum((g or "") == (h or "") for _, _, g in rows) > 1 else None
        again = first is not None and first != i
        out.append((len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", i, first if again else None))
    return sorted(out, key=str)


def test_query_equals_sql(spark, duck, tmp_path):
    assert compare(spark, duck, op6_warc, OP6_SQL, tmp_path) > 10


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HOSTILE = [
    (1, "http://a/WARC/1.1 x\r\ny", "plain"),
    (2, None, "\r\n\r\n" + FAKE * 3 + "tail"),
    (3, "u", "\r\n\r\nWARC/1."),
    (4, "u", "\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\nWARC-Type: response\r\n\r\n"),
    (5, "u", None),
    (6, "u", ""),
    (7, "u", "\r\n\r\n"),
    (8, "u", "é😀" * 400),
    (9, "u", "plain"),
    (None, "u", "plain"),
    (10, "u", "x" * 3000 + "\r\n\r\n" + FAKE + "\r\n\r\nWARC/1.0\r\n\r\n" + "y" * 3000),
    (11, "u", "WARC/1.1\r\nWARC-Type: warcinfo\r\n\r\n\r\n"),
]


@pytest.mark.parametrize("split", ["64m", "1500b", "300b"])
def test_hostile_payloads_in_small_ranges(spark, split):
    """Ranges smaller than records: chains cross many of them."""
    rows = HOSTILE * 1 + [(100 + i, "u", f"page {i} " * 20) for i in range(60)]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert read(warc.round_trip(pages(spark, rows).repartition(2))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (5, "u", ""), (6, "u", None)]
    assert read(warc.round_trip(pages(spark, rows), min_bytes=3)) == plain(rows, 3)


def test_payloads_come_back_whole(spark, tmp_path):
    rows = [(i, "u", h) for i, (_, _, h) in enumerate(HOSTILE)]
    warc.write_pages(pages(spark, rows), str(tmp_path / "w"))
    got = {warc_id: bytes(p) for warc_id, p in ((r.record_id, r.payload) for r in warc.read_records(spark, str(tmp_path / "w"), keep_payload=True).where("warc_type = 'response'").collect())}
    for i, _, h in rows:
        if f"<urn:x-page:{i}>" in got:
            assert got[f"<urn:x-page:{i}>"] == (h or "").encode()
    assert len(got) >= 9


def test_foreign_archives_and_broken_ones(spark, tmp_path):
    def record(kind, body, extra=""):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{len(body)}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    (tmp_path / "a.warc").write_text(record("warcinfo", "software: x\r\n") + record("resource", "a body"), newline="")
    (tmp_path / "b.warc").write_text("junk" + record("resource", "never reached"), newline="")
    (tmp_path / "c.warc").write_text(record("resource", "good") + record("resource", "cut off").replace("Content-Length: 7", "Content-Length: 5") + record("resource", "after the break"), newline="")
    (tmp_path / "d.warc").write_text("")
    got = sorted((r.file[-6:], r.record_offset, r.warc_type, r.payload_bytes) for r in warc.read_records(spark, str(tmp_path)).collect())
    assert got == [("a.warc", 0, "warcinfo", 13), ("a.warc", len(record("warcinfo", "software: x\r\n")), "resource", 6), ("c.warc", 0, "resource", 4), ("c.warc", len(record("resource", "good")), "resource", 5)]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
