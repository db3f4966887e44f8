"""Documents as text files, one for each, in a folder that all executors see.

`save_texts` numbers names that clash, whoever many documents share one, and writes through
a data source of Spark's own interface: tasks write into folders of their own, the driver
moves their files into place when all are done, and a failed job leaves nothing behind.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from parsefold.functions.arrays import fresh
from parsefold.functions.shipping import ship
from parsefold.functions.text import file_stem, trim
from parsefold.sources.shared import new_path

FORMAT = "parsefold_text_files"
#: Characters of a stem that go into a file name; systems allow 255 bytes.
STEM_CHARACTERS = 60
_STAGED = ".staged-"


def local_path(path: str) -> str:
    """The path of a folder that tasks open themselves: a local or a mounted one."""
    url = urlparse(path)
    if url.scheme == "file":
        return unquote(url.path)
    if url.scheme and len(url.scheme) > 1:
        raise ValueError(f"text files are written to folders that executors mount, not to {url.scheme}:")
    return path


@dataclass
class Written(WriterCommitMessage):
    folder: str


class TextFiles(DataSource):
    """Rows (file_name, text) as UTF-8 files of the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(local_path(self.options["path"]), overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staged = os.path.join(path, _STAGED + uuid.uuid4().hex)
        os.makedirs(self.staged)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        # An attempt that fails, or that a second one overtakes, is never committed.
        folder = os.path.join(self.staged, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.mkdir(folder)  # not its parent: once a job is given up, late tasks write nothing
        for part in iterator:
            for name, text in zip(part.column(0).to_pylist(), part.column(1)):
                if not name or name != os.path.basename(name) or name.startswith("."):
                    raise ValueError(f"not a file name: {name!r}")
                # x: two rows of one name are an error, not one file.
                with open(os.path.join(folder, name), "xb") as f:
                    f.write(text.as_buffer() if text.is_valid else b"")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            found = [e for m in messages if m for e in os.scandir(m.folder)]
            names = {e.name for e in found}
            if len(names) < len(found):
                raise FileExistsError("two documents have one file name")
            if not self.overwrite:
                there = [n for n in names if os.path.lexists(os.path.join(self.path, n))]
                if there:
                    raise FileExistsError(f"{len(there)} files are there already, such as {min(there)}")
            for e in found:
                os.replace(e.path, os.path.join(self.path, e.name))
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Take away what was staged, while tasks that are being killed may still write."""
        for _ in range(100):
            shutil.rmtree(self.staged, ignore_errors=True)
            if not os.path.lexists(self.staged):
                return
            time.sleep(0.1)


def _safe(stem: Column) -> Column:
    """A stem without what can't be in a file name, never empty, never hidden."""
    bare = F.substring(F.regexp_replace(F.coalesce(stem, F.lit("")), r"[\x00-\x1f\x7f/\\]", "_"), 1, STEM_CHARACTERS)
    bare = F.regexp_replace(trim(bare), r"^\.", "_")
    return F.when(bare == "", "_").otherwise(bare)


def file_names(documents: DataFrame, key: str = "doc_id", name: str = "name", end: str = ".txt") -> DataFrame:
    """(key, file_name): a name of its own for each document. Of several with one stem, the
    first in order of key keeps it, others are numbered from 2: `stem (2).txt`. A stem that
    ends like a number of this kind always gets one, so that no two names can meet.

    Sorted by stem and key, rows are dealt to ranges; each range counts its stems, and
    numbers go on from what ranges before it hold: a stem that a third of all documents
    share is numbered by many tasks. A key stands for one document."""
    spark = documents.sparkSession
    stems = documents.select(F.col(key), _safe(file_stem(F.col(name))).alias("stem"))
    path = new_path(spark, "file-names")
    # Ranges are drawn by a sample: they are written once, so that all below see the same.
    stems.repartitionByRange("stem", key).withColumn("range", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    before = Window.partitionBy("stem").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("stem", "range").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("stem", "range").orderBy(key))
    numbered = placed.withColumn("own", own).join(counts.select("stem", "range", "before"), ["stem", "range"])
    number = F.col("before") + F.col("own")
    shown = F.when((number > 1) | F.col("stem").rlike(r" \(\d+\)\z"), F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise("")
    return numbered.select(key, F.concat("stem", shown, F.lit(end)).alias("file_name"))


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (file_name, text) as files under path, all or none. Null text is an empty
    file. A name that is there already is an error, unless overwrite replaces it; files of
    other names stay."""
    spark = files.sparkSession
    ship(spark)
    os.makedirs(local_path(path), exist_ok=True)
    spark.dataSource.register(TextFiles)
    files.select("file_name", "text").write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()


def save_texts(documents: DataFrame, path: str, key: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """Write each document's pages, a blank line between them, into a file named after it
    under path, and return (key, file_name). Documents need key, name and pages."""
    names = file_names(documents, key)
    kept = new_path(documents.sparkSession, "named")
    names.write.parquet(kept)
    names = documents.sparkSession.read.parquet(kept)
    text = fresh(documents, "text")
    rows = documents.select(key, F.array_join("pages", "\n\n").alias(text)).join(names, key)
    write_files(rows.select("file_name", F.col(text).alias("text")), path, overwrite)
    return names
