"""The library in SQL, and sketches that are stored and merged."""

import pytest
from pyspark.sql import functions as F

from parsefold import sql
from parsefold.functions.text import clean
from parsefold.operators.paging import make_documents, paginate
from parsefold.plans import views


def test_pages_and_passages_equal_those_of_the_library(spark):
    sql.register(spark)
    text = "Kelp bends.\r\n\r\n\r\n\r\nMoss\t grows. " * 400
    rows = [(1, text), (2, None), (3, "  "), (4, "tide\x00s ﻿"), (5, text + "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    docs.createOrReplaceTempView("sql_docs")
    pages = spark.sql("SELECT d.doc_id, p.* FROM (SELECT doc_id, clean_text(text) AS text FROM sql_docs) d, LATERAL pages_of(d.text) p")
    own = docs.select("doc_id", F.posexplode(paginate(F.col("text"))).alias("page", "text"))
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, own.collect())) and docs.where(F.expr("clean_text(text)").eqNullSafe(clean(F.col("text")))).count() == 5
    pages.createOrReplaceTempView("sql_pages")
    passages = spark.sql("SELECT * FROM passages_of(TABLE(SELECT doc_id, page, text FROM sql_pages))")
    made = make_documents(docs.select("doc_id", paginate(F.col("text")).alias("pages"))).where("error IS NULL")
    same = made.select("doc_id", F.posexplode("passages").alias("source_index", "p")).select("doc_id", "source_index", "p.*")
    assert passages.columns == same.columns and sorted(map(tuple, passages.collect())) == sorted(map(tuple, same.collect()))


def test_tables_of_other_columns_are_refused_and_keys_keep_their_type(spark):
    sql.register(spark)
    with pytest.raises(Exception, match="page and text"):
        spark.sql("SELECT * FROM passages_of(TABLE(SELECT 1 AS doc_id, 'x' AS text))").collect()
    got = spark.sql("SELECT * FROM passages_of(TABLE(SELECT 'é' AS book, 3 AS page, 'Moss' AS text))")
    assert got.columns[0] == "book" and [tuple(r) for r in got.collect()] == [("é", 0, 3, 0, 0, 4, "Moss")]


def test_speech_of_cuts(spark):
    sql.register(spark)
    # tide [8] bends: cut once, twice, not at all; marks alone are spoken only uncut.
    rows = [
        ("a", 0, 0, "tide [8] , bends", 5, 8, " "),
        ("a", 1, 0, "*moss* gull", 0, 1, ""),
        ("a", 1, 0, "*moss* gull", 5, 6, ""),
        ("a", 2, 1, "[8].", 0, 3, " "),
        ("a", 3, 1, "***", None, None, None),
        ("b", 0, 0, "lamp", 0, 99, " "),
        ("b", 1, 0, " sail ", None, None, None),
    ]
    spark.createDataFrame(rows, "k string, source_index int, page int, text string, cut_start int, cut_end int, fill string").repartition(4).createOrReplaceTempView("sql_cuts")
    got = spark.sql("SELECT * FROM speak(TABLE(SELECT k, source_index, page, text, cut_start, cut_end, fill FROM sql_cuts))").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 0, "tide, bends"), ("a", 1, 1, 0, "moss gull"), ("a", 2, 3, 1, "***"), ("b", 0, 1, 0, "sail")]


def test_merged_sketches_estimate_as_one(spark):
    rows = [(i, "s" if i % 3 else "t", [f"word{i % 700} {'x' * (i % 90)}"]) for i in range(3000)] + [(9000, None, ["kelp"]), (9001, "empty", [" "])]
    docs = make_documents(spark.createDataFrame(rows, "doc_id long, source string, pages array<string>"))
    parts = [views.reading_sketches(docs.where(F.col("doc_id") % 4 == n)) for n in range(4)]
    stored = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = {r.source: r for r in views.merged_sketches(stored).select("source", "documents", F.hll_sketch_estimate("words").alias("words"), F.kll_sketch_get_n_bigint("lengths").alias("n")).collect()}
    assert {s: (r.documents, r.n) for s, r in got.items()} == {"s": (2000, 2000), "t": (1000, 1000), None: (1, 1), "empty": (1, 0)}
    assert abs(got["s"].words - 760) <= views.DISTINCT_ERROR * 760 and got["empty"].words == 0
    assert views.reading_sketches(docs.limit(0)).count() == 0


def test_skipped_passages_of_a_long_queue(spark):
    rows = [(1, [{"page": n // 9} for n in range(20_000)], [{"source_index": n} for n in range(20_000) if n % 7]), (2, [], []), (3, [{"page": 4}], [])]
    docs = spark.createDataFrame(rows, "doc_id int, passages array<struct<page:int>>, queue array<struct<source_index:int>>")
    got = views.skipped_passages(docs).collect()
    assert len(got) == 20_001 and all(r.skipped == (r.source_index % 7 == 0) and r.page == r.source_index // 9 for r in got if r.doc_id == 1)
    assert [tuple(r) for r in got if r.doc_id == 3] == [(3, 0, 4, True)]


def test_totals_of_no_omissions(spark):
    none = spark.createDataFrame([], "doc_id int, lang string, text string, reason string")
    got = views.omission_totals(none, [("lang", "reason"), ()]).collect()
    assert [(r.level, r.omissions, r.characters, r.documents) for r in got] == []
