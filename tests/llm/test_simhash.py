import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parsefold.llm import simhash
from parsefold.llm.queries import op1_simhash_near_dedup
from tests.conftest import SF


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_query_equals_brute_force(spark, duck):
    docs = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    fp = [plain_fingerprint(t) for _, t in docs]
    want = classes(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    got = {r.doc_id: r for r in op1_simhash_near_dedup(spark, SF).collect()}
    assert len(got) == len(docs) and any(w != i for i, w in enumerate(want))
    for i, (doc_id, _) in enumerate(docs):
        assert got[doc_id].fingerprint == f"{fp[i]:016x}" and got[doc_id].component_id == docs[want[i]][0]


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(seed):
    random = np.random.default_rng(seed)
    base = random.integers(0, 2**63, 30, dtype=np.uint64) * np.uint64(2)

    def near(n):
        out = []
        for _ in range(n):
            x = int(base[random.integers(30)])
            for _ in range(random.integers(0, 5)):
                x ^= 1 << int(random.integers(64))
            out.append(x)
        return np.unique(np.array(out, np.uint64))

    a, b = near(120), near(90)
    both = [int(x) for x in np.concatenate([a, b])]
    links = [(i, j) for i in range(len(both)) for j in range(i) if (both[i] ^ both[j]).bit_count() <= 3]
    inside = [x for x in links if x[0] < len(a)]
    across = [x for x in links if x[0] >= len(a) > x[1]]
    assert simhash.trie_components(a, None).tolist() == classes(len(a), inside)
    assert simhash.trie_components(a, b).tolist() == classes(len(both), across)


def test_forest_over_many_small_subtrees(spark, monkeypatch):
    """The cut of the trie, at several depths, loses no link."""
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    monkeypatch.setattr(simhash, "MAX_NODES", 1000)
    random = np.random.default_rng(5)
    keys = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        x = int(random.integers(0, 2**63)) * 2 if random.random() < 0.5 else int(random.integers(0, 64))
        for _ in range(6):
            keys.add(x)
            x ^= 1 << int(random.integers(64))
    keys = sorted(keys)
    want = classes(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if (keys[i] ^ keys[j]).bit_count() <= 3])
    rows = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)), i) for i, k in enumerate(keys)], "fp long, least long")
    number = {int(np.uint64(k).astype(np.int64)): i for i, k in enumerate(keys)}
    edges = [(number[r.u], number[r.v]) for r in simhash.trie_forest(rows).collect()]
    assert classes(len(keys), edges) == want and len(edges) < 40 * len(keys)
    stars = {number[r.u]: number[r.v] for r in simhash.connected(spark.createDataFrame([(int(np.uint64(keys[a]).astype(np.int64)), int(np.uint64(keys[b]).astype(np.int64))) for a, b in edges], "u long, v long")).collect()}
    found = classes(len(keys), list(stars.items()))
    assert found == want


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7)]
    got = {r.u: r.v for r in simhash.connected(spark.createDataFrame([e for e in chain if e[0] > e[1]], "u long, v long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)}


def test_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in simhash.components(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = {i: c for i, _, c in got if i is not None}
    assert by[1] == by[2] == by[0] == 0 and by[6] == by[7] == by[5] == 5 and by[9] == by[8] == 8
    assert {(f, c) for i, f, c in got if i is None} == {(0, 0), (next(f for i, f, _ in got if i == 5), 5)}
    assert simhash.components(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 8, 10, 11]
    assert simhash.deduplicate(no_docs).count() == 0
    assert {r.c for r in kept.groupBy("doc_id").agg(F.count("*").alias("c")).collect()} == {1}
