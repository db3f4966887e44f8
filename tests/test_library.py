"""Libraries in place: what an update rewrites, what it leaves, what readers see."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from parsefold.operators.paging import make_documents
from parsefold.sources import library

BUCKETS = 16


def files(path):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for f in glob.glob(f"{path}/documents/bucket=*/*.parquet")}


def bucket_of(file):
    return int(file.split("bucket=")[1].split("/")[0])


def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, name string, pages array<string>")
    return make_documents(made.withColumn("warnings", F.array().cast("array<string>"))).drop("passages")


@pytest.fixture
def path(spark, tmp_path):
    at = f"{tmp_path}/library"
    library.create(docs(spark, [(i, f"n{i}", [f"page {i}", "moss"]) for i in range(200)]), at, BUCKETS)
    return at


def rows(spark, path, **how):
    return {r.doc_id: r for r in library.read_library(spark, path, **how).collect()}


def test_an_update_writes_its_buckets_and_no_other(spark, path):
    before = files(path)
    assert len({bucket_of(f) for f in before}) == BUCKETS
    edited = spark.createDataFrame([(7, 0, "  Edited\t page "), (7, 5, "no such page"), (9, 1, None), (999, 0, "no such document")], "doc_id long, page int, text string")
    hashed = spark.createDataFrame([(7,), (9,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).collect()
    touched = {r[0] for r in hashed}
    assert library.edit_pages(spark, path, edited) == 2
    after = files(path)
    assert {f: x for f, x in before.items() if bucket_of(f) not in touched} == {f: x for f, x in after.items() if bucket_of(f) not in touched}
    assert not {f for f in before if bucket_of(f) in touched} & set(after)
    got = rows(spark, path)
    assert len(got) == 200 and got[7].pages == ["Edited page", "moss"] and got[7].words == 3 and got[7].version == 2
    assert got[9].pages == ["page 9", ""] and got[8].version == 1
    assert {r.doc_id for r in library.read_library(spark, path, since=1).collect()} == {7, 9}
    assert [(r.version, r.kind, r.rows) for r in library.updates(spark, path).orderBy("version").collect()] == [(1, "create", 200), (2, "edit", 2)]


def test_a_bucket_is_all_that_is_read(spark, path):
    """The plan of an update prunes partitions by the buckets touched."""
    old, touched = library._State(spark, path).of_buckets(spark.createDataFrame([(7,)], "doc_id long"))
    scan = old._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters: [")[2]
    assert touched == 1 and "bucket" in scan[: scan.index("]")]
    assert old.select("bucket").distinct().count() == 1


def test_reread_append_put_and_remove(spark, path):
    again = docs(spark, [(1, "again", ["new"]), (2, "again", ["  "]), (500, "again", ["more"])])
    assert library.reread(spark, path, again) == 2
    assert library.append(spark, path, docs(spark, [(3, "clash", ["x"]), (600, "new", ["y z"])]).drop("warnings")) == 3
    assert library.remove(spark, path, spark.createDataFrame([(4,), (4,), (777,)], "doc_id int")) == 4
    got = rows(spark, path)
    assert got[1].name == "again" and got[2].name == "n2" and got[500].pages == ["more"]
    assert got[3].name == "n3" and got[600].warnings is None and got[600].words == 2 and 4 not in got and len(got) == 201
    # A removed document may come back, and what is not there can't be removed or edited.
    assert library.remove(spark, path, spark.createDataFrame([(4,), (777,)], "doc_id long")) == 4
    assert library.edit_pages(spark, path, spark.createDataFrame([(4, 0, "x")], "doc_id long, page int, text string")) == 4
    assert library.append(spark, path, docs(spark, [(4, "back", ["x"])])) == 5 and rows(spark, path)[4].name == "back"
    assert library.put(spark, path, docs(spark, [(4, "put", ["x"]), (5, "put", ["x"])])) == 6
    assert {i: rows(spark, path)[i].name for i in (4, 5)} == {4: "put", 5: "put"}


def test_odd_rows(spark, path, tmp_path):
    with pytest.raises(ValueError, match="at most one row"):
        library.put(spark, path, docs(spark, [(1, "a", ["x"]), (1, "b", ["y"])]))
    with pytest.raises(Exception, match="a document without doc_id"):
        library.put(spark, path, docs(spark, [(None, "a", ["x"])]))
    with pytest.raises(ValueError, match="bucket"):
        library.create(docs(spark, []).withColumn("Bucket", F.lit(1)), f"{tmp_path}/other")
    assert rows(spark, path)[1].version == 1 and len(rows(spark, path)) == 200
    empty = f"{tmp_path}/empty"
    library.create(docs(spark, []), empty)
    assert rows(spark, empty) == {} and library.remove(spark, empty, spark.createDataFrame([], "doc_id long")) == 1
    assert library.append(spark, empty, docs(spark, [(1, "first", ["x"])])) == 2 and list(rows(spark, empty)) == [1]


def test_ids_of_text_and_a_failed_update(spark, tmp_path):
    at = f"{tmp_path}/named"
    named = docs(spark, [(i, f"n{i}", ["x"]) for i in range(30)]).withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id").cast("string")))
    library.create(named, at, 4)
    before = files(at)
    bad = named.where("doc_id < 'é2'").withColumn("name", F.when(F.col("doc_id") == "é11", F.raise_error("no more")).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no more"):
        library.put(spark, at, bad)
    assert files(at) == before and library.updates(spark, at).count() == 1


def test_changes_between_versions(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", [1]), (3, None, [2]), (4, "d", [3])], "doc_id int, name string, x array<int>")
    after = spark.createDataFrame([(1, "a", None), (2, "c", [1, 1]), (3, "", [2]), (5, "d", [3])], "doc_id int, name string, x array<int>")
    got = {tuple(r)[:2]: r.columns for r in library.changes(before, after).collect()}
    assert got == {(2, "changed"): ["name", "x"], (3, "changed"): ["name"], (4, "removed"): None, (5, "inserted"): None}
    assert library.changes(before, before).count() == 0 and library.changes(before.limit(0), after).count() == 4


def test_span_changes_count_repeats(spark):
    kind = "doc_id int, page int, start int, end int, text string, reason string"
    one, two = (1, 0, 2, 5, "[8]", "r"), (1, 0, 7, 9, "(2", "r")
    got = library.span_changes(spark.createDataFrame([one, one, two], kind), spark.createDataFrame([one, (2, *one[1:])], kind)).collect()
    assert sorted((r.doc_id, r.change, r.start) for r in got) == [(1, "removed", 2), (1, "removed", 7), (2, "inserted", 2)]
