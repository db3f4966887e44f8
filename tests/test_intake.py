"""A folder that grows, taken in once; texts as files, all or none."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.sources import intake, text_files
from parsefold.sources.imports import import_files, scan_files
from parsefold.streaming.tasks import Cancelled, Signal


def word(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def put(folder, **named):
    for name, content in named.items():
        (folder / name.replace("__", ".")).write_bytes(content)


class Pdf:
    made = 0

    def read(self, content):
        if content == b"locked":
            raise ValueError(v.PASSWORD_EXCEPTION)
        return [{"mode": "auto", "embedded": content.decode() * 9, "embedded_error": None, "optical": None, "optical_error": None, "confidence": None} for _ in range(2)]

    def close(self):
        pass


class Eyes:
    def recognize(self, content):
        if content == b"slow":
            time.sleep(3)
        return content.decode(), 50.0

    def close(self):
        pass


def documents(spark, path):
    return {r["name"]: r for r in intake.documents(spark, path).collect()}


def test_each_file_is_read_once(spark, tmp_path):
    folder, path = tmp_path / "in", f"{tmp_path}/out"
    (folder / "below").mkdir(parents=True)
    put(folder, a__txt="\ufeffkelp é".encode(), b__docx=word("tide", "rope"), c__exe=b"x", d__docx=b"no zip", e__md=b"  ", f__pdf=b"x", g__png=b"x")
    put(folder / "below", **{"h [1]{2}*__LOG": b"gull"})
    told = []
    run = intake.take_in(spark, str(folder), path, buckets=4, progress=lambda m, p: told.append(p))
    assert run == intake.Run(1, 8, 3, 5) and told[0] == 0 and told[-1] == 100
    got = documents(spark, path)
    assert {n: (r.pages, r.kind) for n, r in got.items()} == {"a.txt": (["kelp é"], "Text"), "b.docx": (["tide\n\nrope"], "Word"), "h [1]{2}*.LOG": (["gull"], "Text")}
    failed = {r["name"]: r.error for r in intake.failures(spark, path).collect()}
    assert failed == {"c.exe": v.UNSUPPORTED, "d.docx": "This Word file could not be opened: File is not a zip file", "e.md": v.NO_TEXT, "f.pdf": "No pdf reader is configured.", "g.png": "No image reader is configured."}

    # Nothing new: nothing is opened, though the file could not even be read any more.
    opened = []
    spark.sparkContext.setJobGroup("again", "again")
    hidden = {f: os.stat(f).st_mtime_ns for f in map(str, folder.rglob("*.*"))}
    for f in hidden:
        os.chmod(f, 0)
    assert intake.take_in(spark, str(folder), path, progress=lambda m, p: opened.append(p)) == intake.Run(1, 0, 0, 0)
    for f in hidden:
        os.chmod(f, 0o644)

    # A file that changes is read again and keeps its id; what failed has its last state.
    put(folder, a__txt=b"kelp beds", d__docx=word("moss"), i__txt=b"shoal")
    assert intake.take_in(spark, str(folder), path) == intake.Run(2, 3, 3, 0)
    now = documents(spark, path)
    assert now["a.txt"].pages == ["kelp beds"] and now["a.txt"].doc_id == got["a.txt"].doc_id and now["b.docx"].version == 1 and now["i.txt"].version == 2
    assert "d.docx" not in {r["name"] for r in intake.failures(spark, path).collect()} and intake.failures(spark, path, run=2).count() == 0
    assert intake.ledger(spark, path).count() == 11


def test_engines_and_their_errors(spark, tmp_path):
    folder, path = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    put(folder, a__pdf=b"kelp and moss", b__pdf=b"locked", c__png=b"lamp", d__png=b"slow", e__gif=b"  ")
    run = intake.take_in(spark, str(folder), path, intake.Readers(Pdf, Eyes, timeout_ms=1500))
    assert (run.files, run.documents) == (5, 2)
    got = documents(spark, path)
    assert len(got["a.pdf"].pages) == 2 and got["a.pdf"].kind == v.KIND_EMBEDDED and got["c.png"].warnings == [v.WARN_IMAGE, v.WARN_LOW + v.WARN_LOW_END]
    failed = {r["name"]: r.error for r in intake.failures(spark, path).collect()}
    assert failed == {"b.pdf": v.PASSWORD_EXCEPTION, "d.png": v.TIMED_OUT, "e.gif": v.NO_TEXT}


def test_a_run_that_ends_early_is_run_again(spark, tmp_path):
    folder, path = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()
    put(folder, a__txt=b"kelp")
    stop = Signal()
    stop.abort()
    with pytest.raises(Cancelled):
        intake.take_in(spark, str(folder), path, signal=stop)
    assert intake.ledger(spark, path) is None
    # A library without a ledger: the run died between the two.
    assert intake.take_in(spark, str(folder), path).documents == 1
    import shutil

    shutil.rmtree(f"{path}/files")
    put(folder, b__txt=b"moss")
    assert intake.take_in(spark, str(folder), path) == intake.Run(1, 2, 2, 0) and set(documents(spark, path)) == {"a.txt", "b.txt"}


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert intake.take_in(spark, str(tmp_path / "in"), f"{tmp_path}/out") == intake.Run(0, 0, 0, 0)


def test_importing_at_once_opens_texts_and_word_files_in_one_pass(spark, tmp_path):
    put(tmp_path, a__txt=b"kelp", b__docx=word("tide"), c__exe=b"x")
    made = import_files(scan_files(spark, str(tmp_path)))
    assert {r["name"]: r.pages for r in made.where("error IS NULL").collect()} == {"a.txt": ["kelp"], "b.docx": ["tide"]}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


# ---------------------------------------------------------------- texts as files


def texts(spark, names, pages=("one", "two")):
    return spark.createDataFrame([(i, n, list(pages)) for i, n in enumerate(names)], "doc_id long, name string, pages array<string>")


def test_clashing_names_are_numbered(spark, tmp_path):
    names = ["a.pdf", "a.txt", "a (2).txt", "b", "a", "x/y.txt", "x\\y", "", None, ".hidden.txt", "é" * 300 + ".txt"]
    got = text_files.save_texts(texts(spark, names), f"{tmp_path}/out").orderBy("doc_id").collect()
    assert [r.file_name for r in got] == ["a.txt", "a (2).txt", "a (2) (1).txt", "b.txt", "a (3).txt", "x_y.txt", "x_y (2).txt", "_.txt", "_ (2).txt", "_hidden.txt", "é" * 60 + ".txt"]
    assert sorted(os.listdir(tmp_path / "out")) == sorted(r.file_name for r in got)
    assert (tmp_path / "out" / "a.txt").read_bytes() == b"one\n\ntwo"


def test_a_hot_name_is_numbered_over_many_ranges(spark):
    names = texts(spark, ["hot.txt" if i % 3 else f"n{i}.txt" for i in range(4000)]).repartition(8)
    got = text_files.file_names(names).collect()
    hot = [r.file_name for r in sorted(got, key=lambda r: r.doc_id) if r.file_name.startswith("hot")]
    assert hot == ["hot.txt"] + [f"hot ({k}).txt" for k in range(2, len(hot) + 1)] and len({r.file_name for r in got}) == 4000


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    bad = spark.range(100, numPartitions=4).select(F.concat("id", F.lit(".txt")).alias("file_name"), F.when(F.col("id") == 77, F.raise_error("stop")).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="stop"):
        text_files.write_files(bad, out)
    assert os.listdir(out) == []
    twice = spark.createDataFrame([("a.txt", "x"), ("a.txt", "y")], "file_name string, text string")
    for df in (twice.coalesce(1), twice.repartition(2, "text"), twice.limit(1).withColumn("file_name", F.lit("../a.txt"))):
        with pytest.raises(Exception, match="exists|one file name|not a file name"):
            text_files.write_files(df, out)
        assert os.listdir(out) == []


def test_what_is_there_is_replaced_only_when_asked(spark, tmp_path):
    out, one = f"{tmp_path}/out", spark.createDataFrame([("a.txt", "x"), ("b.txt", None)], "file_name string, text string")
    text_files.write_files(one, out)
    with pytest.raises(Exception, match="there already"):
        text_files.write_files(one.where("file_name = 'a.txt'").withColumn("text", F.lit("y")).unionByName(spark.createDataFrame([("c.txt", "z")], "file_name string, text string")), out)
    assert sorted(os.listdir(out)) == ["a.txt", "b.txt"] and open(f"{out}/a.txt").read() == "x" and open(f"{out}/b.txt").read() == ""
    text_files.write_files(one.limit(1).withColumn("text", F.lit("y")), f"file:{out}", overwrite=True)
    assert open(f"{out}/a.txt").read() == "y" and sorted(os.listdir(out)) == ["a.txt", "b.txt"]
    text_files.write_files(one.limit(0), out)
    with pytest.raises(ValueError, match="mount"):
        text_files.write_files(one, "s3a://bucket/x")
