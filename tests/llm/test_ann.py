import numpy as np
import pytest
from pyspark.sql import functions as F

from parsefold.llm import ann
from parsefold.llm.queries import op2_nearest_neighbours
from tests.conftest import SF


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != q][:k]


def test_query_recall(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in op2_nearest_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = brute(ids, x, q)
        found = got[int(ids[q])]
        assert len(found) == len(want)
        total += len(want)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        for i, s in found:
            assert abs(s - np.sqrt(((x[ids == i][0] - x[q]) ** 2).sum())) < 1e-12
    assert hits >= 0.9 * total


def test_recall_when_few_buckets_are_searched(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(40, 32))
    x = (centres[random.integers(40, size=4000)] + 0.3 * random.normal(size=(4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, axes=1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids, y = np.arange(4000), x.astype(np.float64)
    hits = sum(len({i for i, _ in brute(ids, y, q)} & got[q]) for q in range(0, 4000, 100))
    assert hits >= 0.9 * 400


def test_copies_and_split_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 10)
    random = np.random.default_rng(4)
    x = np.concatenate([np.tile(random.normal(size=8), (120, 1)), random.normal(size=(80, 8))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], "clash") for i, r in enumerate(x)], "vec_id long, embedding array<float>, score string").repartition(5)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float64)
    for q in range(0, 200, 20):
        want = brute(np.arange(200), y, q)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want])


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.5]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.1]), (7, [1.0, 0.5]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.lit(True)).orderBy("query_id", "rank").select("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 7), (0, 2, 9), (7, 1, 0), (7, 2, 9), (9, 1, 0), (9, 2, 7)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert dict(ann.search(df, F.lit(True)).dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}


def test_hadamard_is_orthogonal():
    h = ann.hadamard(np.eye(16, dtype=np.float32))
    assert np.array_equal(h @ h.T, 16 * np.eye(16))


def spread(random, n, dim, how):
    """Vectors of several kinds: even directions with even or uneven lengths, clusters, and
    a common mean that is longer than all differences."""
    x = random.normal(size=(n, dim))
    if how == "clusters":
        return (random.normal(size=(30, dim))[random.integers(30, size=n)] + 0.4 * x).astype(np.float32)
    if how == "mean":
        return (x + 1.5).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * random.lognormal(size=(n, 1)) if how == "lengths" else x).astype(np.float32)


def fit(x, tables=ann.TABLES, axes=None, recall=ann.RECALL):
    """The index as search() fits it, and the neighbours of other queries."""
    random = np.random.default_rng(7)
    order = random.permutation(len(x))
    y = x.astype(np.float64)

    def near(q):
        d = (y**2).sum(1)[None] - 2 * y[q] @ y.T
        d[np.arange(len(q)), q] = np.inf
        return np.argpartition(d, 10, axis=1)[:, :10]

    index = ann.fitted(x.shape[1], len(x), y[order[: ann.FIT_ROWS]], tables, axes)
    asked = order[: ann.FIT_QUERIES]
    work = ann.calibrate(index, y[asked], y[near(asked).ravel()], np.repeat(np.arange(len(asked)), 10), y[order[: ann.FIT_ROWS]], recall)
    return index, work, order[-100:], near(order[-100:])


def found(index, x, queries, want):
    """Share of the wanted rows in the buckets probed, and of all rows that are compared."""
    (unit, length), (asked, lengths) = index.centred(x), index.centred(x[queries])
    hit, compared = np.zeros(want.shape, bool), 0
    for t in range(len(index.signs)):
        bucket, probed = index.buckets(unit, length, t), index.probed(asked, lengths, t)
        for i, p in enumerate(probed):
            hit[i] |= np.isin(bucket[want[i]], p)
            compared += int(np.isin(bucket, p).sum())
    return hit.mean(), compared / len(x) / len(queries)


@pytest.mark.parametrize("how", ["even", "lengths", "clusters", "mean"])
@pytest.mark.parametrize("dim", [8, 64, 100, 256])
@pytest.mark.parametrize("n", [2000, 12_000])
def test_recall_holds_for_any_dimension_length_and_mean(how, dim, n):
    x = spread(np.random.default_rng(dim + n), n, dim, how)
    index, work, queries, want = fit(x)
    recall, compared = found(index, x, queries, want)
    assert recall >= 0.9 and compared <= 1.0001 and work <= 1


def test_work_falls_with_size():
    """The share of rows compared, of even unit vectors of 64 dimensions."""
    shares = [found(i, x, q, w)[1] for n in (3000, 50_000) for x in [spread(np.random.default_rng(n), n, 64, "even")] for i, _, q, w in [fit(x)]]
    assert shares[1] < shares[0] / 2 and shares[1] < 1 / 3


def test_the_real_search_finds_what_the_index_promises(spark):
    x = spread(np.random.default_rng(2), 4000, 64, "lengths")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = answers(ann.search(df, F.col("vec_id") % 40 == 0))
    hits = sum(len({i for i, _ in brute(np.arange(4000), x.astype(np.float64), q)} & {i for i, _ in got[q]}) for q in range(0, 4000, 40))
    assert hits >= 0.9 * 1000


def test_every_bucket_meets_its_visits_in_one_task(monkeypatch):
    """However ranges are cut, buckets dealt and hot ones split: each row has its task among
    those that a query visiting its bucket is sent to, once."""
    monkeypatch.setattr(ann, "GROUP", 50)
    monkeypatch.setattr(ann, "CHUNK", 40)
    monkeypatch.setattr(ann, "FIT_ROWS", 30)
    x = np.concatenate([spread(np.random.default_rng(1), 1500, 16, "even"), np.ones((500, 16), np.float32) + 1e-4 * spread(np.random.default_rng(2), 500, 16, "even")])
    index, _, _, _ = fit(x)
    assert not index.whole and index.within > 1 and any(index.parts)
    unit, length = index.centred(x)
    for t in range(len(index.signs)):
        bucket = index.buckets(unit, length, t)
        part = np.arange(len(x)) % np.array([index.parts[t].get(int(b), 1) for b in bucket])
        at = index.task(t, bucket, part)
        for b in np.unique(bucket):
            visited = index.task(t, *index.visited(t, np.array([b])))
            assert len(set(visited.tolist())) == len(visited) and set(at[bucket == b].tolist()) <= set(visited.tolist())


def answers(found):
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("kind", ["float", "double"])
def test_a_share_of_one_is_exact(spark, kind):
    random = np.random.default_rng(8)
    x = random.normal(size=(700, 12))
    x[100:200] = x[:100] * (1 + 1e-7)  # nearly equal: the bytes can't tell them apart
    x[200:230] = x[230:260]
    x = x.astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = answers(ann.search(df, F.col("vec_id") % 7 == 0, recall=1.0))
    y = x.astype(np.float64)
    for q in range(0, 700, 7):
        want = brute(np.arange(700), y, q)
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], rtol=1e-12, atol=1e-12)
        assert {i for i, s in got[q] if s < want[-1][1] - 1e-9} == {i for i, s in want if s < want[-1][1] - 1e-9}


def test_a_query_far_from_all_others_still_gets_ten(spark, monkeypatch):
    """All other vectors lie in buckets that it does not probe: it is searched against all
    rows, in several blocks."""
    monkeypatch.setattr(ann, "CHUNK", 500)
    random = np.random.default_rng(9)
    x = (np.ones(64) + 0.01 * random.normal(size=(3000, 64))).astype(np.float32)
    x[0] = -x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = answers(ann.search(df, F.col("vec_id") == 0, axes=2))
    assert [i for i, _ in got[0]] == [i for i, _ in brute(np.arange(3000), x.astype(np.float64), 0)]


def test_bytes_bound_what_they_cost():
    x = np.random.default_rng(1).normal(size=(500, 20)) * np.geomspace(1e-20, 1e20, 500)[:, None]
    b, scale, away = ann.encoded(x)
    assert b.dtype == np.int8 and (np.sqrt(((x - b * scale[:, None]) ** 2).sum(1)) <= away).all() and (away <= np.abs(x).max(1) * np.sqrt(20) / 200).all()
