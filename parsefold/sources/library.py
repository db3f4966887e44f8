"""A library of documents as a table that is updated by buckets of ids.

Under a path lie `documents`, Parquet partitioned by bucket (a hash of the id), and
`updates`, a ledger with a row for each update. An update reads and writes again only the
buckets that its ids fall into, by dynamic partition overwrite: work follows what changes,
and all other files stay as they are. Every row carries the number of the update that wrote
it; a removed document leaves a row that says so, which readers pass over. So what changed
since any update is a filter on the table that Parquet's statistics prune.

One writer at a time: Spark swaps the buckets of an update when its last task is done, but
two updates that run at once may both replace one bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.functions.arrays import fresh
from parsefold.operators.paging import make_documents
from parsefold.sources.shared import clean

#: Buckets of a new library. An update touches at most so many; choose them so that one
#: holds about as much as a task should write (a gigabyte or less).
BUCKETS = 64
#: What a library adds to a document; documents can't have columns of these names.
OWN = ("bucket", "version", "removed")
LEDGER = "version long, kind string, buckets int, rows long, touched int, schema string, key string"


def create(documents: DataFrame, path: str, buckets: int = BUCKETS, key: str = "doc_id", mode: str = "error") -> None:
    """Write documents, one row for each key, as version 1 of a library. A row without a
    key is refused with an error, as it could not be found again. mode: error if there is
    something at the path, or overwrite."""
    taken = sorted(set(OWN) & {c.lower() for c in documents.columns})
    if taken:
        raise ValueError(f"a library has columns of its own named {', '.join(taken)}")
    kept = documents.withColumns({key: _known(key), "version": F.lit(1).cast("long"), "removed": F.lit(False)})
    _write(kept, path, buckets, key, mode, "static")
    spark = documents.sparkSession
    clean(spark)
    rows = spark.read.schema(_stored(documents.schema)).parquet(f"{path}/documents").count()
    _note(spark, path, 1, "create", buckets, rows, buckets, documents.schema.json(), key)


def _known(key: str) -> Column:
    return F.coalesce(F.col(key), F.raise_error(f"a document without {key}"))


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("removed", T.BooleanType()), T.StructField("bucket", T.IntegerType())])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int, key: str, mode: str = "overwrite", replaced: str = "dynamic") -> None:
    placed = rows.withColumn("bucket", _bucket(F.col(key), buckets))
    # Rows are dealt by bucket for files of a good size; a bucket that is too large for one
    # task, or several small ones, are dealt anew by adaptive execution.
    even = placed.hint("rebalance", "bucket")
    even.write.mode(mode).option("partitionOverwriteMode", replaced).partitionBy("bucket").parquet(f"{path}/documents")


def _note(spark: SparkSession, path: str, version: int, kind: str, buckets: int, rows: int, touched: int, schema: str, key: str) -> None:
    mode = "overwrite" if version == 1 else "append"
    spark.createDataFrame([(version, kind, buckets, rows, touched, schema, key)], LEDGER).coalesce(1).write.mode(mode).parquet(f"{path}/updates")


def updates(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: version, kind, rows and buckets touched of each update."""
    return spark.read.schema(LEDGER).parquet(f"{path}/updates")


class _State:
    """What the ledger's last row says of a library."""

    def __init__(self, spark: SparkSession, path: str):
        last = updates(spark, path).orderBy(F.desc("version")).first()
        self.spark, self.path, self.version, self.buckets, self.key = spark, path, last["version"], last["buckets"], last["key"]
        self.schema = T.StructType.fromJson(json.loads(last["schema"]))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_stored(self.schema)).parquet(f"{self.path}/documents")

    def of_buckets(self, keys: DataFrame) -> tuple[DataFrame, int]:
        """The rows of the buckets that keys fall into: other partitions are not read. The
        driver gets the numbers of these buckets."""
        touched = [r[0] for r in keys.select(_bucket(F.col(self.key), self.buckets)).distinct().collect()]
        return self.rows().where(F.col("bucket").isin(touched)), len(touched)

    def same_type(self, keys: DataFrame) -> DataFrame:
        """keys with the library's type: equal ids of another type hash otherwise."""
        return keys.withColumn(self.key, F.col(self.key).cast(self.schema[self.key].dataType))


def read_library(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The documents there are, with the `version` that wrote each; those written after
    update `since` alone."""
    rows = _State(spark, path).rows().where(~F.col("removed")).drop("removed", "bucket")
    return rows.where(F.col("version") > since) if since else rows


def _replace(at: _State, changed: DataFrame, kind: str) -> int:
    """Put changed rows, one for each key, in place of those with their keys, and return
    the new version. Without any, the library stays at its version."""
    columns = [*at.schema.names, "removed"]
    changed = at.same_type(changed).select(*columns).withColumn("version", F.lit(at.version + 1).cast("long")).withColumn(at.key, _known(at.key))
    held = changed.persist()
    try:
        rows = held.count()
        if not rows:
            return at.version
        if held.select(at.key).distinct().count() < rows:
            raise ValueError(f"an update has at most one row for each {at.key}")
        old, touched = at.of_buckets(held)
        kept = old.drop("bucket").join(held.select(at.key), at.key, "left_anti")
        _write(kept.unionByName(held), at.path, at.buckets, at.key)
    finally:
        held.unpersist()
    del old, kept
    clean(at.spark)
    _note(at.spark, at.path, at.version + 1, kind, at.buckets, rows, touched, at.schema.json(), at.key)
    return at.version + 1


def append(spark: SparkSession, path: str, more: DataFrame) -> int:
    """Add documents whose ids the library does not hold; others stay as they are. Columns
    that `more` lacks are null."""
    at = _State(spark, path)
    more = at.same_type(more)
    there = at.of_buckets(more)[0].where(~F.col("removed")).select(at.key)
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in at.schema if f.name not in more.columns}
    return _replace(at, more.withColumns(lacking).withColumn("removed", F.lit(False)).join(there, at.key, "left_anti"), "append")


def put(spark: SparkSession, path: str, documents: DataFrame) -> int:
    """Replace the documents of these ids and add those there are none of."""
    return _replace(_State(spark, path), documents.withColumn("removed", F.lit(False)), "put")


def reread(spark: SparkSession, path: str, again: DataFrame) -> int:
    """Replace documents by those of `again` that were read without error; a failed read
    keeps the old row, ids stay."""
    at = _State(spark, path)
    return _replace(at, again.where("error IS NULL").withColumn("removed", F.lit(False)), "reread")


def edit_pages(spark: SparkSession, path: str, edits: DataFrame) -> int:
    """Replace pages by edits(key, page, text), and make anew what follows from them; name
    and warnings stay. Edits of documents or pages that are not there change nothing; of
    several edits of one page the greatest text counts; a null text empties the page."""
    at = _State(spark, path)
    edits = at.same_type(edits).groupBy(at.key, "page").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    name = fresh(at.rows(), "__edits")
    by = edits.groupBy(at.key).agg(F.map_from_entries(F.collect_list(F.struct("page", "text"))).alias(name))
    old = at.of_buckets(edits)[0].where(~F.col("removed")).join(by, at.key)
    hit = old.where(F.exists(F.map_keys(name), lambda p: (p >= 0) & (p < F.size("pages"))))
    pages = F.transform("pages", lambda p, i: F.coalesce(F.try_element_at(F.col(name), i), p))
    derived = [c for c in ("passages", "words", "error") if c in at.schema.names]
    return _replace(at, make_documents(hit.withColumn("pages", pages).drop(*derived)), "edit")


def remove(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Take documents out. Each leaves a row with its id that says so."""
    at = _State(spark, path)
    ids = at.same_type(ids).select(at.key).distinct()
    gone = at.of_buckets(ids)[0].where(~F.col("removed")).join(ids, at.key, "left_semi").select(at.key)
    empty = {f.name: F.lit(None).cast(f.dataType) for f in at.schema if f.name != at.key}
    return _replace(at, gone.withColumns(empty).withColumn("removed", F.lit(True)), "remove")


def changes(before: DataFrame, after: DataFrame, key: str = "doc_id", compared: tuple[str, ...] | None = None) -> DataFrame:
    """(key, change, columns): inserted, removed and changed rows of two versions, and the
    names of the columns that differ. Rows have one key each; `compared` defaults to what
    both have but the key and the version. Equal rows do not appear. Nulls are equal. Only
    hashes of the columns are shuffled."""
    names = compared or tuple(c for c in before.columns if c in after.columns and c not in (key, "version"))
    hashes = lambda df, side: df.select(F.col(key), F.array(*[F.xxhash64(_plain(df, c)) for c in names]).alias(side))
    both = hashes(before, "old").join(hashes(after, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed").otherwise("changed")
    differ = F.array(*[F.when(F.get("old", F.lit(i)) != F.get("new", F.lit(i)), F.lit(n)) for i, n in enumerate(names)])
    return both.where("old IS NULL OR new IS NULL OR old <> new").select(key, change.alias("change"), F.when(change == "changed", F.array_compact(differ)).alias("columns"))


def _plain(df: DataFrame, column: str) -> Column:
    """The column as something hashable that tells null from empty."""
    return F.to_json(F.struct(F.col(column)))


def span_changes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, change, page, start, end, text, reason): omissions that only one of two
    versions has, as often as it has them more: removed and inserted ones. Each version is
    made once; its equal rows are counted before they are shuffled."""
    columns = [key, "page", "start", "end", "text", "reason"]
    counted = lambda df, by: df.select(*columns).withColumn("__more", F.lit(by))
    more = counted(before, 1).unionByName(counted(after, -1)).groupBy(*columns).agg(F.sum("__more").alias("__more")).where("__more <> 0")
    change = F.when(F.col("__more") > 0, "removed").otherwise("inserted")
    return more.select(*columns, change.alias("change"), F.explode(F.array_repeat(F.lit(0), F.abs("__more").cast("int"))).alias("__n")).drop("__n")
