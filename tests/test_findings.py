"""What reviews found: work done twice, states that grow, results left unassembled."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from parsefold import table_queries  # noqa: F401  registers its queries
from parsefold.functions import text as t
from parsefold.functions.spans import match_spans
from parsefold.operators import clutter, paging, pdf
from parsefold.plans import speech
from parsefold.queries import QUERIES
from parsefold.sources import imports, library
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, calls", [("g1_paginate", 1), ("g2_split_passages", 2), ("f5_f6_squash", 1), ("q3_passages_on_page", 2), ("q4_paragraph_groups", 2), ("g5_make_documents", 2)])
def test_paging_functions_run_once_a_row(spark, name, calls):
    assert plan(QUERIES[name](spark, SF)).split("Physical Plan")[-1].count("ArrowEvalPython [") <= calls


def test_paging_makes_strings_of_a_slice_at_a_time():
    texts = ["a b" * 1000, None] * 1000
    parts = list(paging._by_slices(iter([pa.array(texts)]), paging.paginate_text, len, paging._PAGES))
    assert len(parts) == 3 and sum(map(len, parts)) == len(texts)
    assert [p for x in parts for p in x.to_pylist()] == [None if x is None else paging.paginate_text(x) for x in texts]


def test_passages_are_made_of_one_batch_and_a_slice_at_a_time():
    pages, read = [["One two. " * 500, None, "Three\n\nfour"], None, []], []
    batch = pages * 500

    def batches():
        for n in range(3):
            read.append(n)
            yield pa.array(batch, pa.list_(pa.string()))

    got, sizes = [], []
    for part in paging._split.func(batches()):
        assert part.type == paging._PASSAGES and len(read) == 1 + len(got) // len(batch)
        sizes.append(sum(len(p["text"]) for row in part.to_pylist() for p in row or []))
        got += part.to_pylist()
    assert len(sizes) == 9 and max(sizes) <= paging.SLICE + 4511
    want = [None if x is None else [dict(zip(("page", "paragraph", "start", "end", "text"), p)) for p in paging._passages(x)] for x in pages]
    assert got == want * 1500


@pytest.mark.parametrize("name, calls, cuts", [("g1_paginate", 0, 1), ("f1_clean_text", 0, 1), ("f5_f6_squash", 0, 1), ("v9_plan_summary", 1, 1), ("v5_interval_join", 1, 2), ("q2_omissions_on_page", 0, 1)])
def test_pages_are_cut_without_python_and_once_a_scan(spark, name, calls, cuts):
    text = plan(QUERIES[name](spark, SF)).split("Initial Plan")[-1]
    assert text.count("ArrowEvalPython [") == calls and text.count("{1,%d}" % paging.PAGE_BLOCK) == cuts


def test_pages_cut_in_blocks_are_those_of_the_whole_text(spark):
    draw, texts = random.Random(7), [None, "", " \n ", "x" * 65_001, "ab " * 30_000]
    for n in (2_500, 4_999, 5_000, 5_001, 5_002, 5_003, 19_999, 20_000, 20_001, 24_999, 25_002, 25_003, 40_001, 90_000):
        for kinds in ("a", "a" * 5 + " ", "é漢😀" * 99 + " ", "a" * 900 + "\n", "b\xa0" * 50 + "\n" * 3, "ab" * 1500 + "\n \ufeff"):
            texts.append("".join(draw.choice(kinds) for _ in range(n)))
    texts += ["x" * n + " \n\n" + "y" * 10 + " " + "z" * 15_000 for n in range(4_995, 5_004)]
    texts += ["x" * 19_990 + " " * n + "y" * 9_000 for n in (5, 11)] + ["x" * 19_990 + "\u2003" * n + "y" * 9_000 for n in (5, 11, 22_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", t.clean(F.col("text")).alias("c"), paging.paginate(F.col("text")).alias("pages"))
    got = rows.collect()
    assert len(got) == len(texts)
    assert [r.n for r in got if r.pages != (None if r.c is None else paging.paginate_text(r.c))] == []


def test_report_is_one_text_in_order(spark):
    rows = [(f"{n:05}", f"name {n}", "failed" if n % 3 else None) for n in range(999)]
    df = spark.createDataFrame(rows[::-1], "path string, name string, error string")
    want = "\n".join(f"{name}: {e}" for _, name, e in rows if e)
    assert [r.report for r in imports.whole_report(df).collect()] == [want]
    assert [r.report for r in imports.whole_report(df.where("error IS NULL")).collect()] == [None]


def test_long_texts_are_joined_in_linear_time(spark):
    item = "struct<str:string,x:double,y:double,width:double,height:double,dir:string,has_eol:boolean>"
    words = "filter(transform(sequence(0, 99999), n -> cast(named_struct('str', if(n % 50 = 9, '', concat('w', n % 7)), 'x', n % 6 * 40.0D, 'y', 700 - 14.0D * floor(n / 6), 'width', if(n % 4 = 0, 40.0D, 36.0D), 'height', 10.0D, 'dir', 'ltr', 'has_eol', n % 17 = 16) as {})), x -> true)".format(item)
    began = time.perf_counter()
    got = spark.range(1).select(pdf.join_items(F.expr(words)).alias("t"), F.expr(words).alias("x")).first()
    assert time.perf_counter() - began < 30
    text, last = "", None
    for r in got.x:
        if last is not None and not text[-1:].isspace() and not r["str"][:1].isspace():
            text += "\n" if abs(r.y - last.y) > max(2, last.height * 0.4) else " " if r.x - last.x - last.width > max(0.5, last.height * 0.08) else ""
        text, last = text + r["str"] + "\n" * r.has_eol, r
    assert got.t == text


def test_texts_without_a_rule_s_marks_are_not_matched(spark):
    rows = spark.createDataFrame([Row(text="no marks at all"), Row(text="kelp [3] (Ito 1999) *so*"), Row(text=None)], "text string")
    spans = clutter.page_spans(F.col("text"), F.lit(0), clutter.PAGE_RULES)
    assert "Contains(" in rows.select(spans.alias("x"))._jdf.queryExecution().analyzed().toString().replace("contains(", "Contains(")
    assert [None if r.x is None else len(r.x) for r in rows.select(spans.alias("x")).collect()] == [0, 4, None]
    found = [r.x for r in rows.select(match_spans(F.col("text"), "k(e)", 1).alias("x")).collect()]
    assert found == [[], [Row(start=0, match="ke", g1="e")], None]


def test_clean_and_squash_change_what_they_must(spark):
    texts = ["a b", " a\tb ", "a  b", "a\r\nb\rc", "a\0b", "a\n\n\n\nb", "a\n\r\n\rb", "a \t\xa0 b , c", "a\u2003b", "a ,b", "", None]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, x string").coalesce(1)
    got = rows.select(t.clean(F.col("x")), t.squash(F.col("x"))).collect()
    assert [r[0] for r in got] == ["a b", "a b", "a b", "a\nb\nc", "ab", "a\n\nb", "a\n\nb", "a \xa0 b , c", "a\u2003b", "a ,b", "", None]
    assert [r[1] for r in got] == ["a b", "a b", "a b", "a b c", "a\0b", "a b", "a b", "a b, c", "a b", "a,b", "", None]


def test_versions_are_compared_by_counts_and_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    columns = "doc_id long, page int, start int, end int, text string, reason string"
    row = lambda n, text: (n, 0, 1, 2, text, "r")

    @F.udf("string")
    def seen(x):
        made.add(1)
        return x

    seen = seen.asNondeterministic()
    version = lambda *rows: spark.createDataFrame(rows, columns).withColumn("text", seen("text"))
    got = library.span_changes(version(row(1, "a"), row(1, "a"), row(1, "a"), row(2, None)), version(row(1, "a"), row(2, None), row(3, "b"), row(3, "b"))).collect()
    assert sorted((r.doc_id, r.change) for r in got) == [(1, "removed"), (1, "removed"), (3, "inserted"), (3, "inserted")]
    assert made.value == 8


def test_white_space_of_java_is_that_of_the_fixed_values(spark):
    every = "transform(filter(sequence(1, 65535), n -> n < 55296 or n > 57343), n -> decode(unhex(lpad(hex(n), 4, '0')), 'UTF-16BE'))"
    found = spark.range(1).select(F.filter(F.expr(every), lambda c: c.rlike(f"^{t.SPACE}$")).alias("x")).first().x
    assert sorted(found) == sorted(t.v.SPACES)
    # Printable ASCII is told apart before the ranges, in what runs for each passage.
    for x in (t.squash(F.col("text")), t.word_count(F.col("text")), speech.queue_words(F.array(F.struct("text")))):
        plan_of = spark.createDataFrame([("a",)], "text string").select(x)._jdf.queryExecution().analyzed().toString()
        assert plan_of.count(f"{t.SPACE}+") >= 1 and plan_of.count(f"{t.v.S}+") == 0


def test_squashed_texts_and_their_words_are_those_of_the_rule(spark):
    draw, spaces, alphabet = random.Random(5), f"[{t.v.SPACES}]", "ab,.;:!?é漢\x1f\x85" + t.v.SPACES + " " * 20
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = rows.select("n", t.squash(F.col("text")).alias("squashed"), t.word_count(F.col("text")).alias("words"), speech.queue_words(F.array(F.struct("text"))).alias("queued")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = re.sub(f"{spaces}+([,.;:!?])", r"\1", re.sub(f"{spaces}+", " ", texts[r.n])).strip(t.v.SPACES)
        assert (r.squashed, r.words, r.queued) == (want, len(re.split(f"{spaces}+", texts[r.n].strip(t.v.SPACES))), len(re.split(f"{spaces}+", texts[r.n])))
