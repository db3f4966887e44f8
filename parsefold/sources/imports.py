"""Documents from files and from pasted text, and text files from documents.

A file that cannot be read becomes a row with an error; the rest go on. Decoding PDF
pages and recognising images are left to providers: functions from rows to page tables
that run where the files are."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.functions.shipping import ship
from parsefold.functions.text import extension, file_stem, title_or_default, trim
from parsefold.operators.paging import make_documents, paginate
from parsefold.operators.pdf import pdf_documents, read_pages
from parsefold.streaming.tasks import Signal, abortable, run_job

SAMPLE_PAGE = "Some pages are best heard. Press play and follow the words at your own pace.\n\nThis page is here so that a voice can be tried before anything is opened.\n\nOpen a file of your own, and it takes the place of this one."


def route(name: Column, mime: Column) -> Column:
    """pdf, docx, text, image, or null for what is not supported. The name's extension or
    the type decides, in this order."""
    ext, kind = extension(name), F.coalesce(mime, F.lit(""))
    return (
        F.when((ext == "pdf") | (kind == "application/pdf"), "pdf")
        .when(ext == "docx", "docx")
        .when(ext.isin(*v.TEXT_EXTENSIONS) | (kind == "text/plain"), "text")
        .when(ext.isin(*v.IMAGE_EXTENSIONS) | kind.isin(*v.IMAGE_TYPES), "image")
    )


def guard(name: Column, mime: Column, length: Column) -> Column:
    """Why a file is refused before it is read, or null."""
    return F.when(length > v.MAX_BYTES, v.TOO_LARGE).when(route(name, mime).isNull(), v.UNSUPPORTED)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """name, mime, length, content, error of the files under path. The size is tested
    before a file is read: the content column of refused files is never asked for."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    named = lambda df, content: df.select(F.col("path"), name.alias("name"), F.lit(None).cast("string").alias("mime"), "length", content.alias("content"))
    small = named(files.where(F.col("length") <= v.MAX_BYTES), F.col("content"))
    large = named(files.where(F.col("length") > v.MAX_BYTES), F.lit(None).cast("binary"))
    return small.unionByName(large).withColumn("error", guard(F.col("name"), F.col("mime"), F.col("length")))


# The names of a word-processing file's parts.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_body(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")


def docx_is_whole(content: bytes) -> bool:
    """Whether a Word file's body holds nothing but what a reader of its raw text knows."""

    def known(node) -> bool:
        name = node.tag.rpartition("}")[2]
        return name in v.WORD_ELEMENTS and (name in v.WORD_CLOSED or all(known(c) for c in node))

    body = _docx_body(content)
    return body is None or all(known(c) for c in body)


def docx_text(content: bytes) -> str:
    """The raw text of a Word file: each paragraph followed by a blank line, tabs kept."""

    def text(node) -> str:
        if node.tag == f"{_W}t":
            return node.text or ""
        if node.tag == f"{_W}tab" and not list(node) and node.get(f"{_W}val") is None:
            return "\t"
        inner = "".join(text(c) for c in node)
        return inner + "\n\n" if node.tag == f"{_W}p" else inner

    body = _docx_body(content)
    return text(body) if body is not None else ""


def _decoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and Word files, told apart in the task: path, name, route, text, whole, error."""
    for part in parts:
        rows = []
        for i in range(part.num_rows):
            kind, content = part.column(2)[i].as_py(), part.column(3)[i].as_py()
            try:
                text = content.decode("utf-8-sig", "replace") if kind == "text" else docx_text(content)
                rows.append((text, kind == "text" or docx_is_whole(content), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                rows.append((None, True, f"This Word file could not be opened: {e}"))
        texts, whole, errors = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch([*part.columns[:3], pa.array(texts, pa.string()), pa.array(whole, pa.bool_()), pa.array(errors, pa.string())], names=["path", "name", "route", "text", "whole", "error"])


def image_recogniser(make_engine: Callable[[], Any], timeout_ms: int = v.TASK_TIMEOUT_MS) -> Callable[[DataFrame], DataFrame]:
    """An image_provider for import_files. make_engine() gives an object with
    recognize(bytes) -> (text, confidence) and close(); each task makes one before its first
    image, uses it for all, and closes it. An image that fails or takes longer than
    timeout_ms becomes an error, and after a time-out the engine is made anew."""

    def recognised(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        try:
            for part in parts:
                rows = []
                for content in part.column(1).to_pylist():
                    try:
                        engine = engine or make_engine()
                        text, confidence = abortable(lambda: engine.recognize(content), Signal(), timeout_ms)
                        rows.append((text, float(confidence), None))
                    except Exception as e:  # noqa: BLE001  becomes the file's error
                        rows.append((None, None, str(e) or type(e).__name__))
                        if isinstance(e, TimeoutError):
                            engine.close()
                            engine = None
                texts, confidences, errors = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array(confidences, pa.float64()), pa.array(errors, pa.string())], names=["path", "text", "confidence", "error"])
        finally:
            if engine is not None:
                engine.close()

    return lambda files: files.select("path", "content").mapInArrow(recognised, "path string, text string, confidence double, error string")


def import_files(files: DataFrame, pdf_provider: Callable[[DataFrame], DataFrame] | None = None, image_provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each file of scan_files: doc_id (a hash of the path), name, kind, pages,
    passages, words, warnings, error.

    pdf_provider turns (path, content) into page rows for read_pages with `path` as
    doc_id; image_provider into (path, text, confidence, error). Without one, such files
    are refused with an error."""
    ship(files.sparkSession)
    routed = files.withColumn("route", route(F.col("name"), F.col("mime")))
    empty = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    columns = ["path", "name", "kind", "pages", "warnings", "error"]

    def row(df: DataFrame, kind: Column, pages: Column, warnings: Column = empty, error: Column = null) -> DataFrame:
        return df.select("path", "name", kind.alias("kind"), pages.alias("pages"), warnings.alias("warnings"), error.alias("error"))

    good = routed.where("error IS NULL")
    parts = [row(routed.where("error IS NOT NULL"), null, empty, empty, F.col("error"))]
    # One pass opens texts and Word files, whatever their mix; names travel with them.
    opened = good.where("route IN ('text', 'docx')").select("path", "name", "route", "content").mapInArrow(_decoded, "path string, name string, route string, text string, whole boolean, error string")
    kind = F.when(F.col("route") == "text", "Text").otherwise("Word")
    parts.append(row(opened, kind, F.coalesce(paginate(F.col("text")), empty), F.when(F.col("whole"), empty).otherwise(F.array(F.lit(v.WARN_WORD))), F.col("error")))
    for kind, provider, label in (("pdf", pdf_provider, "PDF"), ("image", image_provider, "Image · text recognized")):
        own = good.where(F.col("route") == kind)
        if provider is None:
            parts.append(row(own, F.lit(label), empty, empty, F.lit(f"No {kind} reader is configured.")))
        elif kind == "pdf":
            read = pdf_documents(read_pages(provider(own.select("path", "content")))).withColumnRenamed("doc_id", "path")
            parts.append(own.select("path", "name").join(read, "path").select(*columns))
        else:
            read = own.select("path", "name").join(provider(own.select("path", "content")), "path")
            low = F.when((F.col("confidence") < v.LOW_CONFIDENCE) & (trim(F.col("text")) != ""), v.WARN_LOW + v.WARN_LOW_END)
            warnings = F.filter(F.array(F.lit(v.WARN_IMAGE), low), lambda x: x.isNotNull())
            parts.append(row(read, F.lit(label), F.coalesce(paginate(F.col("text")), empty), warnings, F.col("error")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    made = make_documents(rows.withColumnRenamed("error", "refused"))
    error = F.coalesce("refused", "error")
    return made.withColumn("error", error).withColumn("doc_id", F.xxhash64("path")).drop("refused")


def import_to(path: str, files: DataFrame, signal: Signal | None = None, progress: Callable[[str, int], None] | None = None, timeout_ms: int | None = None, **providers: Callable[[DataFrame], DataFrame]) -> str | None:
    """Import files and write the documents that were opened under path as Parquet; what
    failed is a table beside them, of which the first lines are returned, or None. Setting the signal, from another
    thread, ends the running tasks and raises Cancelled; so does the time limit, with
    TimeoutError. progress(message, percent) follows the share of tasks done."""
    spark, made = files.sparkSession, import_files(files, **providers)

    def work() -> str | None:
        made.write.mode("overwrite").parquet(f"{path}/all")
        done = spark.read.schema(made.schema).parquet(f"{path}/all")
        done.where("error IS NULL").write.mode("overwrite").parquet(f"{path}/documents")
        failure_report(done).write.mode("overwrite").parquet(f"{path}/failures")
        return shown_report(done)

    return run_job(spark, work, signal or Signal(), progress, "Opening files…", timeout_ms)


def text_error(text: Column) -> Column:
    """Why a pasted text is refused, or null; null for a null text."""
    return F.when(trim(text) == "", v.NO_TEXT).when(F.char_length(text) > v.MAX_CHARACTERS, v.TOO_MANY_CHARACTERS)


def add_text(texts: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """Pasted texts as documents; a blank title is replaced, a text too long refused."""
    guarded = texts.withColumn("refused", F.when(F.char_length(text) > v.MAX_CHARACTERS, v.TOO_MANY_CHARACTERS))
    made = make_documents(guarded.withColumn("pages", F.when(F.col("refused").isNull(), paginate(F.col(text)))))
    return made.withColumn("error", F.coalesce("refused", "error")).withColumn("name", title_or_default(F.col(name))).withColumn("kind", F.lit("Text")).drop("refused")


def sample_document(spark: SparkSession) -> DataFrame:
    """A constant document of one page, with id 'sample'."""
    one = spark.range(1).select(F.lit("sample").alias("doc_id"), F.lit("A page to try").alias("name"), F.lit("Sample").alias("kind"), F.array(F.lit(SAMPLE_PAGE)).alias("pages"), F.array().cast("array<string>").alias("warnings"))
    return make_documents(one)


def ocr_languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *x) for n, x in enumerate(v.OCR_LANGUAGES)], "ordinal int, value string, label string")


def reread(documents: DataFrame, again: DataFrame, key: str = "doc_id") -> DataFrame:
    """documents with rows replaced by those of `again` that have no error; a failed read
    keeps the old row, and ids stay."""
    done = again.where("error IS NULL")
    return documents.join(done.select(key), key, "left_anti").unionByName(done.select(*documents.columns))


def failure_report(imported: DataFrame) -> DataFrame:
    """(path, line): 'name: message' for each failed file. Readers that show it order by
    path; however many files fail, they stay rows."""
    return imported.where("error IS NOT NULL").select("path", F.concat(F.coalesce("name", F.lit("")), F.lit(": "), "error").alias("line"))


def whole_report(imported: DataFrame) -> DataFrame:
    """One row (report): all lines of the failure report in order of path, null if nothing
    failed. Lines are sorted and joined by ranges of paths, so that only the ranges' texts
    meet in one task; that report is one string, which bounds it to 2 GB."""
    lines = failure_report(imported).repartitionByRange("path", "line").withColumn("range", F.spark_partition_id())
    parts = lines.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("x"))
    texts = parts.select(F.col("x")[0].alias("first"), F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
    every = texts.agg(F.sort_array(F.collect_list(F.struct("first", "text"))).alias("x"))
    return every.select(F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda r: r["text"]), "\n")).alias("report"))


#: Lines of a report that is shown as one text.
SHOWN = 100


def shown_report(imported: DataFrame) -> str | None:
    """The first lines of the failure report by path, and how many more there are; None if
    nothing failed."""
    report = failure_report(imported)
    lines = [r["line"] for r in report.orderBy("path").limit(SHOWN + 1).collect()]
    if len(lines) > SHOWN:
        lines[SHOWN:] = [f"and {report.count() - SHOWN} more"]
    return "\n".join(lines) or None


def text_of(documents: DataFrame, *also: str) -> DataFrame:
    """(file_name, text) to save, and columns asked for: pages with a blank line between."""
    return documents.select(*also, F.concat(file_stem(F.col("name")), F.lit(".txt")).alias("file_name"), F.array_join("pages", "\n\n").alias("text"))


def save_text(documents: DataFrame, path: str) -> None:
    """Write texts under path, in a folder for each file name."""
    text_of(documents).write.partitionBy("file_name").text(path)
