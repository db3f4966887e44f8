"""Sketches against all shingles; audits against a plain loop over sorted documents."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parsefold.llm import queries, sketch
from tests.conftest import SF
from tests.test_queries import compare

TOP = 1 << 64


def plain_sketch(text, words=5, scale=8):
    w = [sketch.word_hash(x) for x in text.encode().lower().split()]
    found = set()
    for i in range(max(1, len(w) - words + 1) if w else 0):
        x = sum(h * m for h, m in zip(w[i : i + words], sketch.multipliers(words))) % TOP
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % TOP
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % TOP
        found.add((x ^ (x >> 31)) >> 1)
    low = {x for x in found if x < (1 << 63) // scale}
    return sorted(low or set(sorted(found)[:1]))


def plain_audit(rows):
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = map(plain_sketch, (text, edited, after))
        like = lambda x, y: len({*x} & {*y}) / min(len(x), len(y)) if x and y else float(len(x) == len(y))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return out


def by_row(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_audit_of_odd_rows(spark, odd_docs, ranges):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert by_row(sketch.audit(odd_docs, ranges=ranges).collect()) == by_row(plain_audit(rows))


def test_audit_of_repeated_ids_over_many_ranges(spark):
    random.seed(5)
    word = lambda: random.choice("abcdefgh") * 3
    rows = [(random.choice([None, 7, 7, 7, *range(-9, 40)]), " ".join(word() for _ in range(random.randrange(30)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert by_row(sketch.audit(docs, ranges=24).collect()) == by_row(plain_audit(rows))


def test_one_document_follows_itself_and_none_gives_none(spark, no_docs):
    one = sketch.audit(spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one[0]["near_next"] == 1.0
    assert sketch.audit(no_docs).count() == 0 and sketch.with_sketch(no_docs).count() == 0


def test_sketches_merge_and_estimate_containment_of_unequal_texts(spark):
    draw = random.Random(2)
    book = [f"w{draw.randrange(5000)}" for _ in range(40_000)]
    part, other = book[11_000:13_000], [f"v{draw.randrange(5000)}" for _ in range(3_000)]
    rows = [(" ".join(book), " ".join(part + other), " ".join(book + part + other))]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for name in "abc":
        df = sketch.with_sketch(df, name, f"s{name}")
    share, back, same, whole = df.select(sketch.containment(F.col("sb"), F.col("sa")), sketch.containment(F.col("sa"), F.col("sb")), sketch.merged(F.col("sa"), F.col("sb")), "sc").first()
    assert abs(share - 0.4) < 0.08 and abs(back - 0.05) < 0.02
    # The joined text has eight shingles more, over its seams.
    assert set(same) <= set(whole) and len(whole) - len(same) <= 8


def test_merged_keeps_the_rule_of_small_sketches(spark):
    limit = (1 << 63) // sketch.SCALE
    rows = [([limit + 5], [limit + 9]), ([3], [limit + 9]), ([], [limit + 1]), ([], []), ([1, 4], [2, 4])]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(sketch.merged(F.col("a"), F.col("b"))).collect()] == [[limit + 5], [3], [limit + 1], [], [1, 2, 4]]
    assert [r[0] for r in df.select(sketch.resemblance(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, None, 0.25 * 4 / 3]


def test_with_sketch_over_an_expression_with_a_lambda(spark, odd_docs):
    df = odd_docs.withColumn("text", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), " "), F.upper), " "))
    got = sketch.with_sketch(df, out="score").select("text", "score").collect()
    assert all(r["score"] == plain_sketch(r["text"]) for r in got) and len(got) == odd_docs.count()


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(sketch.Sketcher, "REMEMBERED", 10)
    own, text = sketch.Sketcher(), " ".join(f"w{i}" for i in range(200)) + " " + "y" * 100
    assert own.sketch(text.encode()).tolist() == plain_sketch(text) and len(own.known) <= 10


def test_query_equals_sql_and_tells_edits_from_others(spark, duck, tmp_path):
    assert compare(spark, duck, queries.op12_document_fingerprints, queries.op12_sql(), tmp_path) == 200
    rows = queries.op12_document_fingerprints(spark, SF).collect()
    assert np.median([r["near_edited"] for r in rows]) > 0.6 and np.median([r["near_next"] for r in rows]) < 0.05
