"""Choosing between embedded and optical text, joining runs, importing files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from parsefold.api import InvalidArgument, get_reading_status, insert_reading_text
from parsefold.functions import fixed_values as v
from parsefold.operators import pdf
from parsefold.sources import imports

DENSE = "A normal paragraph with valid readable digital text."
# mode, embedded, embedded error, optical, optical error -> text, source, note, error
READS = [
    ("optical", "garbled", None, "The visible words.", None, "The visible words.", "optical", None, None),
    ("optical", "garbled", None, None, "OCR unavailable", None, None, None, "OCR unavailable"),
    ("optical", "x", None, "", None, "", "optical", None, None),
    ("auto", None, "Missing mapping", "Recovered.", None, "Recovered.", "optical", v.NOTE_NOT_DECODED, None),
    ("auto", None, "Missing mapping", None, "OCR failed", None, None, None, "OCR failed"),
    *[("auto", b * 100, None, "Short but correct.", None, "Short but correct.", "optical", v.NOTE_INVALID_MAP, None) for b in ("�", "", "\x00", "\U000f0001")],
    ("auto", "�" * 200, None, None, "OCR failed", None, None, None, "OCR failed"),
    ("auto", DENSE, None, None, "must not run", DENSE, "embedded", None, None),
    ("auto", "Chapter one", None, None, "No connection", "Chapter one", "embedded", v.NOTE_OPTICAL_FAILED, None),
    ("auto", "Chapter one", None, "Ch", None, "Chapter one", "embedded", None, None),
    ("auto", "Chapter", None, "Chapter one", None, "Chapter one", "optical", None, None),
    ("auto", "  ", None, None, "No connection", None, None, None, "No connection"),
]


def test_page_sources(spark):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(READS)], "n int, mode string, e string, ee string, o string, oe string")
    got = rows.select("n", pdf.choose_source(*[F.col(c) for c in ("mode", "e", "ee", "o", "oe")]).alias("r"), pdf.needs_optical(F.col("mode"), F.col("e"), F.col("ee")).alias("needs")).orderBy("n").collect()
    assert [tuple(r.r) for r in got] == [r[5:] for r in READS]
    assert [r.n for r in got if not r.needs] == [i for i, r in enumerate(READS) if r[1] == DENSE]


def test_runs_are_joined_without_blanks_inside_words(spark):
    item = lambda s, x, w, eol=False, y=200.0: (s, float(x), y, float(w), 18.0, "ltr", eol)
    rows = spark.createDataFrame([(1, [item("inter", 0, 30), item("national", 30, 50), item("agreement", 86, 60, True)]), (2, [item("up", 0, 10), item("", 12, 0), item("down", 0, 10, y=100.0), (None, 0.0, 0.0, 0.0, 0.0, None, None)]), (3, [])], f"n int, items array<{pdf.ITEM}>")
    got = {r.n: r.t for r in rows.select("n", pdf.join_items(F.col("items")).alias("t")).collect()}
    assert got == {1: "international agreement\n", 2: "up down", 3: ""}  # the empty run leaves a blank, which stands for the gap


def test_pdf_documents_collect_warnings(spark):
    rows = [("d", 0, "auto", DENSE, None, None, None, None), ("d", 1, "auto", None, "bad", "Seen.", None, 40.0), ("d", 2, "auto", "", None, "", None, 90.0), ("e", 0, "auto", None, "bad", None, "boom", None)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, mode string, embedded string, embedded_error string, optical string, optical_error string, confidence double")
    got = {r.doc_id: r for r in pdf.pdf_documents(pdf.read_pages(pages)).collect()}
    assert got["d"].kind == "PDF · automatic OCR" and got["d"].pages == [DENSE, "Seen.", ""] and got["d"].error is None
    assert [w.split(".")[0] for w in got["d"].warnings] == ["Read 2 of 3 pages visually", "Recognition confidence is low on page 2", "Page 2: PDF text could not be decoded", "No readable text was found on page 3"]
    assert got["e"].error == "boom"


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_are_imported_and_failures_reported(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Hello\r\nworld\x00 again".encode())
    (tmp_path / "b.docx").write_bytes(docx(["One", "Two"]))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.md").write_bytes(b"  ")
    (tmp_path / "g.csv").write_bytes(b"a,\xff,b")
    got = {r.name: r for r in imports.import_files(imports.scan_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].pages == ["Hello\nworld again"] and got["a.txt"].kind == "Text" and got["a.txt"].words == 3
    assert got["b.docx"].pages == ["One end\n\nTwo end"] and got["b.docx"].kind == "Word"
    assert "could not be opened" in got["c.docx"].error and got["d.exe"].error == v.UNSUPPORTED and got["f.md"].error == v.NO_TEXT
    assert got["g.csv"].pages == ["a,�,b"]
    report = imports.shown_report(imports.import_files(imports.scan_files(spark, str(tmp_path))))
    assert len(report.split("\n")) == 4 and report.startswith("c.docx: ")

    def reader(files):
        return files.select(F.col("path").alias("doc_id"), F.lit(0).alias("page"), F.lit("auto").alias("mode"), F.lit(DENSE).alias("embedded"), *[F.lit(None).cast("string").alias(c) for c in ("embedded_error", "optical", "optical_error")], F.lit(None).cast("double").alias("confidence"))

    read = {r.name: r for r in imports.import_files(imports.scan_files(spark, str(tmp_path)), pdf_provider=reader).collect()}
    assert read["e.pdf"].pages == [DENSE] and read["e.pdf"].kind == "PDF · embedded text"


def test_word_files_with_unknown_parts_are_marked(spark, tmp_path):
    whole = docx(["One"])
    assert imports.docx_is_whole(whole)
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        xml = z.read("word/document.xml").decode().replace("<w:body>", "<w:body><w:altChunk/>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(whole)
    (tmp_path / "b.docx").write_bytes(out.getvalue())
    got = {r.name: r.warnings for r in imports.import_files(imports.scan_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": [], "b.docx": [v.WARN_WORD]}


class Engine:
    """Reads an image as its own bytes; tells how many engines a task made."""

    def __init__(self):
        self.uses = 0

    def recognize(self, content):
        import time

        self.uses += 1
        if content == b"bad":
            raise ValueError("unreadable")
        if content == b"slow":
            time.sleep(5)
        return f"{content.decode()} seen as number {self.uses}", 40.0 if content == b"dim" else 95.0

    def close(self):
        self.uses = -100


def test_images_are_recognised_by_one_engine_a_task(spark, tmp_path):
    for name, content in (("a.png", b"clear"), ("b.png", b"dim"), ("c.png", b"bad"), ("d.png", b"slow"), ("e.png", b"last")):
        (tmp_path / name).write_bytes(content)
    files = imports.scan_files(spark, str(tmp_path)).coalesce(1).orderBy("path")
    got = {r.name: r for r in imports.import_files(files, image_provider=imports.image_recogniser(Engine, 500)).collect()}
    assert got["a.png"].warnings == [v.WARN_IMAGE] and got["a.png"].kind == "Image · text recognized"
    assert got["b.png"].warnings == [v.WARN_IMAGE, v.WARN_LOW + v.WARN_LOW_END]
    assert got["c.png"].error == "unreadable" and got["d.png"].error == v.TIMED_OUT
    numbers = [int(got[n].pages[0].split()[-1]) for n in ("a.png", "b.png", "e.png")]
    assert numbers == [1, 2, 1]  # a new engine follows a time-out


def test_a_password_is_named(spark):
    rows = [("d", 0, "auto", None, v.PASSWORD_EXCEPTION, None, v.PASSWORD_EXCEPTION, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, mode string, embedded string, embedded_error string, optical string, optical_error string, confidence double")
    assert pdf.pdf_documents(pdf.read_pages(pages)).first().error == v.PASSWORD_PROTECTED


def test_imports_are_cancelled_timed_and_followed(spark, tmp_path):
    import threading
    import time

    from parsefold.streaming.tasks import Cancelled, Signal, run_job

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"Hello")
    (tmp_path / "in/b.exe").write_bytes(b"x")
    told = []
    report = imports.import_to(str(tmp_path / "out"), imports.scan_files(spark, str(tmp_path / "in")), progress=lambda m, p: told.append(p))
    assert report == f"b.exe: {v.UNSUPPORTED}" and [r.name for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()] == ["a.txt"]
    assert told[0] == 0 and told[-1] == 100 and all(0 <= p <= 100 for p in told)

    slow = lambda: spark.range(8, numPartitions=8).mapInPandas(lambda parts: (time.sleep(30) or p for p in parts), "id long").collect()
    for signal, limit, error in ((Signal(), None, Cancelled), (Signal(), 1500, TimeoutError)):
        if limit is None:
            threading.Timer(1.5, signal.abort).start()
        told.clear()
        began = time.time()
        with pytest.raises(error):
            run_job(spark, slow, signal, lambda m, p: told.append(p), timeout_ms=limit)
        assert time.time() - began < 15 and told and 100 not in told
        for _ in range(100):
            if not spark.sparkContext.statusTracker().getActiveJobsIds():
                break
            time.sleep(0.1)
        assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_text_is_saved_by_file_name(spark, tmp_path):
    docs = spark.createDataFrame([("x.y.pdf", ["One.", "Two."])], "name string, pages array<string>")
    imports.save_text(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/file_name=x.y.txt"), wholetext=True).first().value.strip() == "One.\n\nTwo."


def test_calls_check_their_arguments(spark):
    made, told = insert_reading_text(spark, {"text": "One two three.", "title": " "})
    assert told["title"] == "Pasted text" and told["pages"] == 1 and told["words"] == 3
    assert get_reading_status(made, {}) == {"title": "Pasted text", "pages": 1, "words": 3}
    for bad in ({"text": "  "}, {"text": 3}, {"text": "x", "title": "t" * 201}, {"text": "x", "more": 1}, {}):
        with pytest.raises(InvalidArgument):
            insert_reading_text(spark, bad)
    with pytest.raises(InvalidArgument):
        get_reading_status(made, {"x": 1})
