"""Runs against a definition that tries every period at every place."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parsefold.llm import periodic, queries
from tests.conftest import SF
from tests.test_queries import compare


def plain_runs(words, min_length=6, exponent=4):
    """By definition, in time that grows with the cube."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        same = [words[i] == words[i + p] for i in range(n - p)] + [False]
        begin = None
        for i, x in enumerate(same):
            if x and begin is None:
                begin = i
            if not x and begin is not None:
                stretch = words[begin : i + p]
                smaller = any(all(stretch[k] == stretch[k + q] for k in range(len(stretch) - q)) for q in range(1, p))
                if len(stretch) >= max(min_length, exponent * p) and not smaller:
                    found.append((begin, len(stretch), p))
                begin = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found_runs(docs, **how):
    bounds = np.cumsum([0, *map(len, docs)])
    doc, *runs = periodic.find(np.array([w for d in docs for w in d], np.int64), bounds, **how)
    out = [[] for _ in docs]
    for d, *run in zip(doc.tolist(), *(x.tolist() for x in runs)):
        out[d].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=40), st.integers(0, 39), st.integers(1, 9)), max_size=4), st.sampled_from([(6, 4), (1, 2), (4, 3), (12, 2)]))
def test_every_run_is_found(made, how):
    docs = [[w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < len(w) else 0 for i in range(len(w))] for w, a, p in made]
    assert found_runs(docs, min_length=how[0], exponent=how[1]) == [plain_runs(d, *how) for d in docs]


def test_ranges_have_their_smallest_values():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1000, 777)
    low = draw.integers(0, 777, 3000)
    high = np.minimum(low + draw.integers(0, 777, 3000), 776)
    assert periodic.Minima(values).between(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


def test_runs_of_odd_rows(spark, odd_docs):
    found = periodic.with_runs(odd_docs, prefix="found_").collect()
    assert len(found) == odd_docs.count()
    for r in found:
        words = (r["text"] or "").encode().split()
        assert r["found_n_words"] == len(words)
        if len(words) < 1000:
            runs = plain_runs(words)
            assert [tuple(x) for x in r["found_runs"]] == runs and r["n_words"] == "x"
            assert r["found_collapsed"] == collapsed([w.decode() for w in words], runs)


def test_names_are_replaced_and_an_empty_table_stays_empty(spark, odd_docs, no_docs):
    found = periodic.with_runs(odd_docs.withColumn("runs", F.lit("x")).withColumn("__runs", F.lit("y")))
    assert found.where("__runs = 'y'").count() == odd_docs.count() and dict(found.dtypes)["runs"].startswith("array<struct<start:bigint")
    assert periodic.with_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(no_docs, exponent=1)


def test_a_long_text_of_one_run_and_one_of_many_words(spark):
    random.seed(3)
    tail = " ".join(f"z{random.randrange(4)}" for _ in range(120_000))
    texts = [("a b c " * 60_000).strip(), tail, "x " * 50_000 + tail]
    got = periodic.with_runs(spark.createDataFrame(enumerate(texts), "i int, text string")).orderBy("i").collect()
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 180_000, 3)] and got[0]["collapsed"] == "a b c"
    for r, text in zip(got[1:], texts[1:]):
        words = np.unique(text.split(), return_inverse=True)[1]
        for start, length, p in r["runs"]:
            inside = words[start : start + length]
            assert length >= max(6, 4 * p) and (inside[p:] == inside[:-p]).all()
            assert start == 0 or words[start - 1] != words[start - 1 + p]
            assert start + length == len(words) or words[start + length] != words[start + length - p]
    assert tuple(got[2]["runs"][0]) == (0, 50_000, 1)


def test_query_equals_sql(spark, duck, tmp_path):
    assert compare(spark, duck, queries.op11_periodic_runs, queries.op11_sql(), tmp_path) == 200
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert sum(r["n_runs"] > 0 for r in rows) > 15 and {r["length"] is None for r in rows} == {True, False}
