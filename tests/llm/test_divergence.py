"""The audit of sources against a plain computation over every cell."""

import random
import re
from collections import Counter

import pytest

from parsefold.llm import divergence, queries
from tests.test_queries import compare

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        counts, documents = {}, Counter()
        for text, own, source in rows:
            if own == lang:
                found = TERM.findall(text.translate(SMALL))
                counts.setdefault(source, Counter()).update(found)
                documents.update(set(found))
        kept = [t for t, n in documents.items() if n >= least]
        share = lambda c, n: 1 + (10**9 * (c + 5)) // (n + 5 * len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        for s, c in counts.items():
            pairs = [(sum(abs(share(c[t], total[s]) - share(d[t], total[o])) for t in kept), o) for o, d in counts.items() if o != s]
            more = [(share(c[t], total[s]) - share(whole[t], sum(whole.values())), t) for t in kept if c[t]]
            for part, found in (("pair", pairs), ("term", [x for x in more if x[0] > 0])):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def made(n=400, seed=1):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("Éa", "b", "C", "中", "zé") for b in "abcdefgh"]
    return [
        (" ".join(draw.choices(words, [1 + k % 7 for k in range(len(words))], k=draw.randrange(40))) + draw.choice(["", "1x-y_Z", "\x00\x7f"]), draw.choice(["en", "en", "fr", "", None]), draw.choice(["s", "s", "s", "t", "u\n", "é", None]))
        for _ in range(n)
    ]


def found(df, **how):
    return sorted(map(tuple, divergence.divergence(df, **how).collect()))


@pytest.mark.parametrize("least,top", [(30, 50), (3, 4), (10_000, 50)])
def test_every_value(spark, least, top):
    rows = made() + [(None, "de", "one"), (None, None, None), ("a b", "it", "only"), ("", "it", "only")] + [("Aa bb", "fr", "copy")] * 40
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert found(df, least=least, top=top) == plain(rows, least, top)


def test_small_blocks_and_small_dictionaries_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    rows = made(60, 4)
    whole = pa.record_batch([pa.array([r[i] or "" for r in rows], pa.string()) for i in (1, 2)] + [pa.array([r[0].encode() for r in rows], pa.binary())], names=["lang", "source", "text"])

    def counts():
        total = Counter()
        for part in divergence._counted(iter([whole])):
            for lang, source, term, n, d in zip(*(c.to_pylist() for c in part.columns)):
                total[lang, source, term, "n"] += n
                total[lang, source, term, "d"] += d
        return total

    def tallies(terms):
        total = Counter()
        for part in divergence._tallied(iter([terms])):
            for *cell, m in zip(*(c.to_pylist() for c in part.columns)):
                total[tuple(cell)] += m
        return total

    by = [[{"source": s, "n": n} for s, n in (("é", 3), ("s", k % 3 + 1), ("zz", 3))[k % 2 :]] for k in range(40)]
    terms = pa.record_batch([pa.array(["en", "fr"] * 20), pa.array(by, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))], names=["lang", "by"])
    first, second = counts(), tallies(terms)
    assert second["en", "s", "zz", 1, 3] == 7 and ("en", "é", "zz", 3, 3) not in second and second["en", "zz", "é", 3, 3] == 20
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 7)
    monkeypatch.setattr(divergence, "CELLS", 6)
    assert counts() == first and tallies(terms) == second


def test_odd_rows_and_none(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    assert found(odd_docs, least=2) == plain(rows, 2)
    assert found(no_docs) == []


def test_query_equals_sql(spark, duck, tmp_path):
    assert compare(spark, duck, queries.op13_source_divergence, queries.OP13_SQL, tmp_path) > 1000
