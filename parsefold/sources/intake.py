"""Import of a folder that grows: each file is read once, and only when it is new.

What was taken in is a ledger of path, length and time of change. A run lists the folder
(metadata alone), drops what the ledger holds, refuses by name and size what can't be read,
and opens the rest: one pass, in which each task routes its files by name and decodes them
all, whatever their kind. Documents go into a library by buckets of their ids; a file that
has changed replaces its document. The ledger is written last, so a run that dies is simply
run again.
"""

from __future__ import annotations

import itertools
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.shipping import ship
from parsefold.functions.text import trim
from parsefold.operators.paging import make_documents, paginate
from parsefold.operators.pdf import pdf_documents, read_pages
from parsefold.sources import library
from parsefold.sources.imports import docx_is_whole, docx_text, guard, route
from parsefold.sources.shared import clean, new_path
from parsefold.streaming.tasks import Signal, abortable, run_job

#: Paths that pass the driver at once, as the names of what a job reads.
PATHS = 20_000
LEDGER = "path string, length long, modified timestamp, run long, error string"
PAGE = "struct<mode:string,embedded:string,embedded_error:string,optical:string,optical_error:string,confidence:double>"
DECODED = f"path string, name string, route string, text string, whole boolean, confidence double, pages array<{PAGE}>, error string"
DOCUMENT = "doc_id long, path string, name string, kind string, pages array<string>, warnings array<string>, words int"


@dataclass
class Readers:
    """What opens files that need an engine; each task makes one of a kind before its first
    such file. pdf() gives an object whose read(bytes) is a list of pages, each a dict with
    fields of PAGE; image() one whose recognize(bytes) is (text, confidence). Both have
    close(). Without one, such files are refused."""

    pdf: Callable[[], Any] | None = None
    image: Callable[[], Any] | None = None
    timeout_ms: int = v.TASK_TIMEOUT_MS


@dataclass
class Run:
    """What a run did: its number, files found new, documents taken in, files that failed."""

    run: int
    files: int
    documents: int
    failed: int


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, modified) of all files under a folder: none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def _opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """These files and no others. Spark looks each of them up, by default in a task of its
    own; a few for each core will do."""
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.format("binaryFile").load([_literal(p) for p in paths])
    finally:
        spark.conf.set(conf, before)


def _literal(path: str) -> str:
    """The path as a pattern that matches nothing else."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def _decoder(readers: Readers, done) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    page = pa.struct([*[(n, pa.string()) for n in ("mode", "embedded", "embedded_error", "optical", "optical_error")], ("confidence", pa.float64())])
    kinds = pa.schema([(n, pa.string()) for n in ("path", "name", "route", "text")] + [("whole", pa.bool_()), ("confidence", pa.float64()), ("pages", pa.list_(page)), ("error", pa.string())])

    def decoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines: dict[str, Any] = {}

        def engine(kind: str) -> Any:
            if kind not in engines:
                engines[kind] = getattr(readers, kind)()
            return engines[kind]

        def opened(kind: str, content: bytes) -> dict:
            if kind == "text":
                return {"text": content.decode("utf-8-sig", "replace")}
            if kind == "docx":
                try:
                    return {"text": docx_text(content), "whole": docx_is_whole(content)}
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    return {"error": f"This Word file could not be opened: {e}"}
            if getattr(readers, kind) is None:
                return {"error": f"No {kind} reader is configured."}
            try:
                own = engine(kind)
                work = (lambda: own.read(content)) if kind == "pdf" else (lambda: own.recognize(content))
                found = abortable(work, Signal(), readers.timeout_ms)
                return {"pages": found} if kind == "pdf" else {"text": found[0], "confidence": float(found[1])}
            except Exception as e:  # noqa: BLE001  becomes the file's error
                if isinstance(e, TimeoutError):
                    engines.pop(kind).close()
                return {"error": str(e) or type(e).__name__}

        try:
            for part in parts:
                for i in range(part.num_rows):  # a file may have fifty megabytes
                    path, name, kind, content = (part.column(c)[i].as_py() for c in range(4))
                    row = {"path": path, "name": name, "route": kind, **opened(kind, content)}
                    done.add(1)
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)
        finally:
            for e in engines.values():
                e.close()

    return decoded


def _as_documents(decoded: DataFrame) -> DataFrame:
    """One row for each decoded file: path, name, kind, pages, warnings, words, error."""
    empty = F.array().cast("array<string>")
    plain = decoded.where("route <> 'pdf' OR error IS NOT NULL")
    kind = F.when(F.col("route") == "text", "Text").when(F.col("route") == "docx", "Word").when(F.col("route") == "pdf", "PDF").otherwise("Image · text recognized")
    low = F.when((F.col("confidence") < v.LOW_CONFIDENCE) & (trim(F.col("text")) != ""), v.WARN_LOW + v.WARN_LOW_END)
    said = F.array(F.when(F.col("route") == "image", v.WARN_IMAGE), low, F.when(~F.col("whole"), v.WARN_WORD))
    rows = plain.select("path", "name", kind.alias("kind"), F.coalesce(paginate(F.col("text")), empty).alias("pages"), F.when(F.col("error").isNull(), F.array_compact(said)).otherwise(empty).alias("warnings"), F.col("error").alias("refused"))
    pages = decoded.where("route = 'pdf' AND error IS NULL").select(F.col("path").alias("doc_id"), F.posexplode_outer("pages").alias("page", "p"))
    read = pdf_documents(read_pages(pages.select("doc_id", F.coalesce("page", F.lit(0)).alias("page"), "p.*")))
    named = read.select(F.col("doc_id").alias("path"), F.element_at(F.split("doc_id", "/"), -1).alias("name"), "kind", "pages", "warnings", F.col("error").alias("refused"))
    made = make_documents(rows.unionByName(named))
    return made.withColumn("error", F.coalesce("refused", "error")).drop("refused")


def take_in(spark: SparkSession, folder: str, path: str, readers: Readers | None = None, buckets: int = library.BUCKETS, signal: Signal | None = None, progress: Callable[[str, int], None] | None = None, timeout_ms: int | None = None) -> Run:
    """Take the files under `folder` that are new or have changed into the library under
    `path`/library, and note them in the ledger. progress(message, percent) follows the
    files that are done; setting the signal, or the time limit, ends the run, which leaves
    library and ledger as they were or is finished by the next one.

    A file that fails is noted with its error and tried again once it changes; the others go
    on. A blank file has no text and fails; one without a single byte is not listed by
    Spark. A folder without new files changes nothing."""
    ship(spark)
    readers, counted, total = readers or Readers(), spark.sparkContext.accumulator(0), [0]

    def share() -> int:
        # A task that runs twice counts twice.
        return min(99, 100 * counted.value // total[0]) if total[0] else 0

    def work() -> Run:
        known = ledger(spark, path)
        last = known.agg(F.max("run")).first()[0] if known is not None else None
        number = (last or 0) + 1
        files = listing(spark, folder)
        new = files if known is None else files.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
        none = F.lit(None).cast("string")
        tables = [new_path(spark, n) for n in ("new-files", "decoded", "documents")]
        new = _kept(new.withColumns({"route": route(F.col("name"), none), "error": guard(F.col("name"), none, F.col("length"))}), tables[0])
        total[0] = new.count()
        if not total[0]:
            return Run(number - 1, 0, 0, 0)
        opened = tables[1]
        spark.createDataFrame([], DECODED).write.parquet(opened)
        paths = (r["path"] for r in new.where("error IS NULL").select("path").toLocalIterator())
        while some := list(itertools.islice(paths, PATHS)):
            content = _opened(spark, some)
            name = F.element_at(F.split("path", "/"), -1)
            content.select("path", name.alias("name"), route(name, none).alias("route"), "content").mapInArrow(_decoder(readers, counted), DECODED).write.mode("append").parquet(opened)
        decoded = spark.read.schema(spark.createDataFrame([], DECODED).schema).parquet(opened)
        made = _kept(_as_documents(decoded).withColumn("doc_id", F.xxhash64("path")).select("doc_id", "path", "name", "kind", "pages", "warnings", "words", "error"), tables[2])
        _drop(spark, tables[1])
        good = made.where("error IS NULL").drop("error")
        documents = good.count()
        if last is None:
            # A run that died before its ledger may have left a library.
            library.create(good, f"{path}/library", buckets, mode="overwrite")
        else:
            library.put(spark, f"{path}/library", good)
        failed = made.where("error IS NOT NULL").select("path", F.col("error").alias("failed"))
        noted = new.join(failed, "path", "left").select("path", "length", "modified", F.lit(number).cast("long").alias("run"), F.coalesce("error", "failed").alias("error"))
        noted.write.mode("append").parquet(f"{path}/files")
        _drop(spark, tables[0], tables[2])
        return Run(number, total[0], documents, total[0] - documents)

    return run_job(spark, work, signal or Signal(), progress, "Opening files…", timeout_ms, share=share)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that this run made for itself, and shuffle files it has done with."""
    for path in paths:
        system, at = _files(spark, path)
        system.delete(at, True)
    clean(spark)


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length, modified, run, error) of all files taken in, or None before the first
    run; a file that has changed has a row for each time."""
    system, at = _files(spark, f"{path}/files")
    return spark.read.schema(LEDGER).parquet(f"{path}/files") if system.exists(at) else None


def documents(spark: SparkSession, path: str) -> DataFrame:
    return library.read_library(spark, f"{path}/library")


def failures(spark: SparkSession, path: str, run: int | None = None) -> DataFrame:
    """(path, name, error) of the files that failed, of one run or as each last stood."""
    known = ledger(spark, path)
    last = known.where(F.col("run") == run) if run is not None else known.groupBy("path").agg(F.max_by(F.struct("run", "error"), "run").alias("x")).select("path", "x.*")
    return last.where("error IS NOT NULL").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "error")
