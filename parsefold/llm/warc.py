"""WARC archives: writing pages as response and revisit records, and reading archives
back in parallel with boundary-chain verification.

Reading. Spark splits archives by byte ranges, each task cutting its range at the bytes
that can begin a record (a blank line, then the magic). A payload may hold the same
bytes, so a task only emits candidates: where a record would start and, from its length
field, where its successor would. Inside a task, chains are followed to where they
leave the range. Pointer jumping over these exits, from the start of each file and
doubling the stride every round, finds the ranges' true entries; what is reachable from
them is a record, all else is payload. Records whose payload was cut by false candidates
are put together in a second pass over the pieces they own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsefold.llm.common import join_to_one, new_path, ship, table

MAGIC = b"WARC/1."
CUT = b"\r\n\r\n" + MAGIC
#: Fixed values of the format.
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: forty bits are eight digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX_DIGITS, _BASE32)


def _field(value: Column) -> Column:
    """A header value: no control characters or spaces."""
    for code in (*range(0x21), 0x7F):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row, in archives under `path` (one for each task).

    Of rows with equal payloads of at least min_bytes bytes, those with the smallest
    page_id (one, where ids are unique) become responses, the others revisits of it;
    smaller payloads are all responses. Null payloads count as empty, null urls as the
    empty string; rows with a null id revisit if they can. A very long payload is one record, written
    by the task that holds its row; repeated rows are records of their own. An empty table
    gives no record; other columns are not read."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", sha1_base32(F.col("body"))).withColumn("size", F.octet_length("body"))
    again = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("count"))
    again = table(again.where("count > 1 AND first IS NOT NULL"), "payloads")
    rows = join_to_one(rows, again.select("digest", "first"), "digest", "left", again.select("digest", "count"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    rows = rows.select("*", revisit.alias("revisit"), http.alias("http"))
    length = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _urn(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        _field(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: "), _urn(F.col("first")), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        length,
        F.lit("\r\n\r\n"),
        F.col("http"),
    )
    record = F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body").cast("string")))
    rows.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


# ---------------------------------------------------------------- reading

_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
_INFO = "warc_type string, record_id string, target_uri string, refers_to string, header_digest string, payload_bytes long, payload_digest string"


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, v in _FIELD.findall(head)}


def _described(fields: dict[bytes, bytes], block: bytes, keep: bool) -> tuple:
    """What a complete record says. The payload of an HTTP response follows its headers;
    a revisit has none, and its length is that its HTTP headers state."""
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind, digest, size, payload = text(b"warc-type"), None, None, block
    stated = text(b"warc-payload-digest")
    if fields.get(b"content-type", b"").lower().startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            n = _fields(head).get(b"content-length", b"")
            size = int(n) if n.isdigit() else None
    if kind == "revisit":
        digest = stated.rpartition(":")[2] if stated else None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return (kind, text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"), stated, size, digest) + ((payload,) if keep else ())


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, bytes between cuts), in order inside each range."""
    found = spark.read.option("lineSep", CUT.decode()).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, range, index, start of the bytes after the magic as counted from the first
    bytes of this range, bytes), for each segment; -1 as start: no magic before it."""
    at, index, now = 0, 0, None
    for part in parts:
        for file, begin, value in zip(*(part.column(i).to_pylist() for i in range(3))):
            if (file, begin) != now:
                at, index, now = 0, 0, (file, begin)
            if begin == 0 and index == 0:
                start = len(MAGIC) if value.startswith(MAGIC) else -1
                yield file, begin, index, start, value[len(MAGIC) :] if start >= 0 else value
            else:
                yield file, begin, index, at, value
            at += len(value) + len(CUT)
            index += 1


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """The records of the archives under `path` (uncompressed): file, record_offset,
    warc_type, record_id, target_uri, refers_to, header_digest, payload_bytes,
    payload_digest (computed, base32 SHA-1; of a revisit as stated) and, on request,
    payload. A file that does not begin with a record has none; after a broken length
    field the rest of that file is unreachable. An empty folder gives no rows."""
    ship(spark)
    info = _INFO + ", payload binary" * keep_payload
    width = len(info.split(","))
    names = ["file", "range", "index", "start", "after", "bytes_read", "whole", "exit", *[x.split()[0] for x in info.split(", ")]]
    kinds = "file string, range long, index int, start long, after long, bytes_read long, whole boolean, exit long, " + info

    def candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[list]) -> pa.RecordBatch:
            exits: dict[int, int] = {}
            for r in reversed(rows):  # where the chain from here leaves this range
                if r[4] is not None:
                    r[7] = exits[r[3]] = exits.get(r[4], r[4])
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *[pa.binary()] * keep_payload]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        rows: list[list] = []
        for file, begin, index, start, value in _placed(parts):
            if rows and rows[0][:2] != [file, begin]:
                yield told(rows)
                rows = []
            row = [file, begin, index, start - len(MAGIC), None, len(value) + len(CUT), False, None, *[None] * width]
            if begin == 0 and index == 0:
                row[5] += max(start, 0)
            end = value.find(b"\r\n\r\n")
            if start >= 0 and end >= 0 and re.match(rb"\d\r\n", value):
                fields = _fields(value[:end])
                n = fields.get(b"content-length", b"")
                if n.isdigit() and b"warc-type" in fields:
                    row[4] = start + end + 4 + int(n) + 4
                    block = value[end + 4 : end + 4 + int(n)]
                    if len(block) == int(n):
                        row[6], row[8:] = True, list(_described(fields, block, keep_payload))
            rows.append(row)
        if rows:
            yield told(rows)

    found = table(_segments(spark, path).mapInArrow(candidates, kinds), "candidates")
    in_file = Window.partitionBy("file").orderBy("range")
    bases = found.groupBy("file", "range").agg(F.sum("bytes_read").alias("n"))
    bases = bases.select("file", "range", (F.sum("n").over(in_file) - F.col("n")).alias("base"))
    ours = found.join(bases, ["file", "range"])
    place = lambda c: (F.col("base") + F.col(c)).alias(c)
    ours = ours.select("file", "range", "index", place("start"), place("after"), place("exit"), "whole", *[n for n in names[8:]])

    entries = _entries(ours)
    marked = ours.join(entries, ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))

    def reached(group: pa.Table) -> pa.Table:
        starts, after, entry = (group.column(c).to_pylist() for c in ("start", "after", "entry"))
        wanted = {s for s, e in zip(starts, entry) if e}
        flags = {}
        for s, a in sorted(zip(starts, after), key=lambda x: x[0]):
            if s in wanted and a is not None:
                flags[s] = True
                wanted.add(a)
        return group.select(["file", "range", "index", "start"]).append_column("reached", pa.array([flags.get(s, False) for s in starts]))

    flags = marked.select("file", "range", "index", "start", "after", "entry").groupBy("file", "range").applyInArrow(reached, "file string, range long, index int, start long, reached boolean")
    flags = table(flags, "reached")
    true = ours.join(flags.where("reached").select("file", "range", "index"), ["file", "range", "index"])
    out = ["file", F.col("start").alias("record_offset"), *names[8:]]
    done = true.where("whole").select(*out)
    cut = true.where(~F.col("whole")).select("file", F.col("start").alias("owner"))
    if cut.isEmpty():
        return done
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = flags.withColumn("owner", F.last(F.when(F.col("reached"), F.col("start")), ignorenulls=True).over(order))
    owned = table(owned.join(cut, ["file", "owner"], "left_semi").select("file", "range", "index", "start", "owner"), "pieces")

    def again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin, index, _, value in _placed(parts):
            yield pa.record_batch([pa.array([file]), pa.array([begin], pa.int64()), pa.array([index], pa.int32()), pa.array([value], pa.binary())], names=["file", "range", "index", "value"])

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        value = CUT.join(group.column("value").to_pylist())
        end = value.find(b"\r\n\r\n")
        fields = _fields(value[:end])
        n = int(fields[b"content-length"])
        row = _described(fields, value[end + 4 : end + 4 + n], keep_payload)
        columns = {"file": group.column("file").slice(0, 1), "record_offset": group.column("owner").slice(0, 1)}
        return pa.table(columns | {k: pa.array([v], pa.int64() if k == "payload_bytes" else pa.binary() if k == "payload" else pa.string()) for k, v in zip(names[8:], row)})

    pieces = _segments(spark, path).mapInArrow(again, "file string, range long, index int, value binary").join(owned, ["file", "range", "index"])
    return done.unionByName(pieces.groupBy("file", "owner").applyInArrow(joined, "file string, record_offset long, " + info))


def _entries(candidates: DataFrame) -> DataFrame:
    """(file, start, entry): the candidates at which the true chain enters a range, by
    pointer jumping over exits from the start of each file."""
    jump = table(candidates.where("exit IS NOT NULL").select("file", "start", F.col("exit").alias("to")), "jumps")
    reached = table(jump.where("start = 0").select("file", "start"), "entries")
    n = reached.count()
    while True:
        onward = reached.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        onward = onward.join(jump.select("file", "start"), ["file", "start"], "left_semi")
        reached = table(reached.unionByName(onward).distinct(), "entries")
        more = reached.count()
        if more == n:
            return reached.withColumn("entry", F.lit(True))
        n = more
        after = jump.select("file", F.col("start").alias("to"), F.col("to").alias("further"))
        jump = table(jump.join(after, ["file", "to"]).select("file", "start", F.col("further").alias("to")).unionByName(jump.join(after, ["file", "to"], "left_anti").select("file", "start", "to")), "jumps")


def page_of(urn: Column) -> Column:
    """The page id in a record id, null if there is none."""
    return F.regexp_extract(urn, r"^<urn:x-page:(-?\d*)>\z", 1).try_cast("long")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path, page_id, url, payload, min_bytes)
    return read_records(spark, path)
