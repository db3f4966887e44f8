"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are centred, scaled to unit length and put through fast pseudo-rotations (three
rounds of random signs and a Walsh-Hadamard transform); the hash is the signed axis nearest
to the result, taken once, twice or three times, as the table is large. As Euclidean
distance also asks for lengths, a bucket is a band of lengths and those axes. Each of TABLES
tables is searched in the buckets that promise the smallest distance.

How many buckets that takes depends on the data, so it is measured: the true neighbours of a
bounded sample of queries are found by brute force, and the index is probed as far as it
takes to find the wanted share of them. A bucket and the queries that probe it meet in a
task. There a vector is one byte a component with a bound on what that costs; what may still
be among a query's nearest is then fetched once, by id, and measured exactly.

Equal vectors are one row with their k + 1 smallest ids (no other copy can be among the
k nearest of any query), so a vector repeated in a third of all rows costs as much as any.
A visit travels once, to the one task that holds its bucket; only a bucket that is itself
too large for a task is split, and visited in each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import ship, table

K = 10
#: Tables at most: as many are used as make for the least work.
TABLES = 8
#: Share of the true neighbours of the sample that the probed buckets hold; what is asked
#: of the whole is 0.9.
RECALL = 0.97
#: The sample: rows from which mean, bands of lengths and the load of buckets are taken, and
#: queries whose true neighbours are found by brute force.
FIT_ROWS, FIT_QUERIES = 4096, 128
#: Bands of lengths, at most, and by what factor their limits differ at least.
BANDS, APART = 8, 1.1
#: Rows for each bucket, on average, from which one more axis names it.
FILLED = 0.5
#: Rows that meet in a task, about, and rows of one bucket from which it is split.
GROUP, CHUNK = 32_768, 65_536
#: What probing a bucket costs, beside measuring a vector.
PROBE = 0.2
#: Scores of buckets held at once while probes are chosen.
SCORES = 1 << 21
#: Rows of a bucket from which distances are a product of matrices; pairs held at once.
LARGE, PAIRS = 512, 1 << 16
#: Rows, at most, into which the ids of equal queries are dealt.
SALTS = 16
SEED = 20_240_101


def rotations(dim: int, tables: int, levels: int, seed: int = SEED) -> np.ndarray:
    """Signs of three diagonal matrices for each table and level, for vectors padded to
    a power of two."""
    width = 1 << max(1, dim - 1).bit_length()
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0], np.float32), (tables, levels, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, unscaled."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


@dataclass
class Index:
    """What hashing needs to know of vectors of one dimension."""

    signs: np.ndarray  # tables, axes, 3, width
    mean: np.ndarray
    limits: np.ndarray  # lengths between bands
    length: np.ndarray  # the middle length of each band
    tallest: float = 0.0  # mean of the largest coordinate after rotation
    probes: int = 0  # buckets that a query visits in each table
    ranges: list[np.ndarray] | None = None  # for each table, buckets at which a range begins
    parts: list[dict[int, int]] | None = None  # for each table, the buckets that are split
    within: int = 1  # tasks among which the buckets of a range are dealt
    rows: int = 0
    whole: bool = False  # all rows are one bucket, and every query visits it

    @property
    def kinds(self) -> int:
        return 2 * self.signs.shape[-1]

    @property
    def cells(self) -> int:
        """Buckets of a table."""
        return len(self.length) * self.kinds ** self.signs.shape[1]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions and lengths, seen from the mean."""
        x = x.astype(np.float64) - self.mean
        length = np.sqrt((x * x).sum(axis=1))
        return (x / np.maximum(length, 1e-300)[:, None]).astype(np.float32), length

    def along(self, unit: np.ndarray, table_: int) -> list[np.ndarray]:
        """The coordinates along the signed axes, for each axis of a table's buckets."""
        out = []
        for level in self.signs[table_]:
            y = np.zeros((len(unit), level.shape[-1]), np.float32)
            y[:, : unit.shape[1]] = unit
            for s in level:
                y = hadamard(y * s) / np.sqrt(np.float32(level.shape[-1]))
            out.append(np.stack([y, -y], axis=2).reshape(len(y), -1))
        return out

    def band(self, length: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, length, side="right")

    def buckets(self, unit: np.ndarray, length: np.ndarray, table_: int) -> np.ndarray:
        if self.whole:
            return np.zeros(len(unit), np.int64)
        out = self.band(length)
        for y in self.along(unit, table_):
            out = out * self.kinds + y.argmax(axis=1)
        return out

    def promise(self, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """What the squared distance is likely to exceed |q|^2 by: for each query, band and
        sum of coordinates along a bucket's axes."""
        r = self.length[None, :, None]
        return r * r - 2 * r * self.tallest * length[:, None, None] * score[:, None, :]

    def sums(self, unit: np.ndarray, table_: int) -> np.ndarray:
        """For each row and all axes of a table, in order of their number, the sums of the
        coordinates along them."""
        total = np.zeros((len(unit), 1), np.float32)
        for y in self.along(unit, table_):
            total = (total[:, :, None] + y[:, None, :]).reshape(len(unit), -1)
        return total

    def probed(self, unit: np.ndarray, length: np.ndarray, table_: int) -> np.ndarray:
        """The buckets of a table that each row promises to find the nearest in."""
        if self.whole:
            return np.zeros((len(unit), 1), np.int64)
        score = self.sums(unit, table_)
        each = score.shape[1]
        best = min(self.probes, each)
        axes = np.argpartition(-score, best - 1, axis=1)[:, :best] if best < each else np.broadcast_to(np.arange(each), score.shape)
        value = self.promise(length, np.take_along_axis(score, axes, 1)).reshape(len(unit), -1)
        code = (np.arange(len(self.length))[None, :, None] * each + axes[:, None, :]).reshape(len(unit), -1)
        kept = np.argpartition(value, self.probes - 1, axis=1)[:, : self.probes] if self.probes < value.shape[1] else np.broadcast_to(np.arange(value.shape[1]), value.shape)
        return np.take_along_axis(code, kept, 1)

    def task(self, table_: int, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The number of the task that a bucket's part meets its visits in: ranges of buckets
        with about as many rows each, whose buckets may be dealt further, and the parts of
        buckets that are split."""
        range_ = np.searchsorted(self.ranges[table_], bucket, side="right")
        further = np.where(part > 0, self.within + part, (bucket * 2654435761 >> 8) % self.within)
        return (np.int64(len(self.mean)) << 44) + (((np.int64(table_) << 18) + range_) << 20) + further

    def visited(self, table_: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets with their parts: all parts of a bucket that is split."""
        many = np.ones(len(bucket), np.int64)
        for hot, parts in self.parts[table_].items():
            many[bucket == hot] = parts
        end = np.cumsum(many)
        return np.repeat(bucket, many), np.arange(end[-1] if len(end) else 0) - np.repeat(end - many, many)

    def place(self, unit: np.ndarray, length: np.ndarray, table_: int, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many buckets of a table come before the bucket of x[j] when query of[j] probes
        them in order of promise."""
        bucket = self.buckets(*self.centred(x), table_)
        out = np.zeros(len(x), np.int64)
        for q in np.unique(of):
            own = np.flatnonzero(of == q)
            score = np.sort(self.sums(unit[q : q + 1], table_)[0])
            plain = self.sums(unit[q : q + 1], table_)[0]
            band, axes = np.divmod(bucket[own], len(score))
            value = self.length[band] ** 2 - 2 * self.length[band] * self.tallest * length[q] * plain[axes]
            for r in self.length:  # scores from which a bucket of this band promises more
                from_ = (r * r - value) / np.maximum(2 * r * self.tallest * length[q], 1e-300)
                out[own] += len(score) - np.searchsorted(score, from_, side="right")
        return out


def fitted(dim: int, n: int, rows: np.ndarray, tables: int, axes: int | None = None) -> Index:
    """The index for n vectors of one dimension, from a sample of them."""
    width = 1 << max(1, dim - 1).bit_length()
    if axes is None:
        axes = next((a for a in (3, 2) if n >= FILLED * (2 * width) ** a), 1)
    mean = rows.astype(np.float64).mean(axis=0)
    length = np.sqrt(((rows - mean) ** 2).sum(axis=1))
    limits: list[float] = []
    for limit in np.quantile(length, np.arange(1, BANDS) / BANDS):
        if limit > APART * (limits[-1] if limits else max(length.min(), 1e-300)) and limit < length.max() / APART:
            limits.append(float(limit))
    band = np.searchsorted(limits, length, side="right")
    middle = np.array([np.median(length[band == b]) if (band == b).any() else 0.0 for b in range(len(limits) + 1)])
    index = Index(rotations(dim, tables, axes), mean, np.array(limits), middle, rows=n)
    unit, length = index.centred(rows)
    index.tallest = float(index.along(unit[:512], 0)[0].max(axis=1).mean())
    index.ranges, index.parts = [], []
    many = min(len(rows), -(-n // GROUP))
    for t in range(tables):
        held = np.sort(index.buckets(unit, length, t))
        index.ranges.append(np.unique(held[np.arange(1, many) * len(held) // many]))
        own, seen = np.unique(held, return_counts=True)
        index.parts.append({int(o): int(-(-s * n // (len(rows) * CHUNK))) for o, s in zip(own, seen) if s > 1 and s * n > len(rows) * CHUNK})
    index.within = max(1, -(-n // (GROUP * len(rows))))
    return index


def calibrate(index: Index, queries: np.ndarray, near: np.ndarray, of: np.ndarray, rows: np.ndarray, recall: float) -> float:
    """Set how many tables a query visits, and how many buckets of each, so that the sample's
    queries find that share of their neighbours near[j], which belong to query of[j]. Of all
    numbers of tables the one with the least work counts, which is returned: the share of
    rows, all tables together, that a query is measured against, and PROBE for each bucket.
    Where that is not below one, or all is wanted, every query visits all rows."""
    best = (1.0, 1, 0)
    if recall < 1 and len(near):
        unit, length = index.centred(queries)
        seen, lengths = index.centred(rows[:1024])
        some = slice(0, 32)
        places, share = np.full(len(near), np.iinfo(np.int64).max), 0.0
        held = [index.buckets(seen, lengths, t) for t in range(len(index.signs))]
        for t in range(len(index.signs)):
            places = np.minimum(places, index.place(unit, length, t, near, of))
            index.probes = int(min(index.cells, np.sort(places)[int(np.ceil(recall * len(places))) - 1] + 1))
            share = sum(float(np.isin(held[s], p).mean()) for s in range(t + 1) for p in index.probed(unit[some], length[some], s)) / len(unit[some])
            best = min(best, (share + PROBE * (t + 1) * index.probes / index.rows, t + 1, index.probes))
    work, tables, index.probes = best
    index.signs = index.signs[:tables]
    if not index.probes:
        index.whole, index.within, index.ranges, index.parts = True, 1, [np.zeros(0, np.int64)], [{0: -(-index.rows // CHUNK)}]
    return work


def usable(vector: Column) -> Column:
    """Not null or empty, no component null or not finite, and not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrices(part: pa.RecordBatch, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch of (id, vector), by dimension."""
    ids, lists = part.column(0).to_numpy(), part.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, first = lists.values.to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield ids[own], flat[first[own][:, None] + np.arange(dim)]


def encoded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as one signed byte a component, the scale of each, and how far each is from
    what its bytes say (rounded up)."""
    x = x.astype(np.float64)
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    bytes_ = np.rint(x / scale[:, None]).astype(np.int8)
    away = np.sqrt(((x - bytes_ * scale[:, None]) ** 2).sum(axis=1))
    return bytes_, scale, away * (1 + 1e-9)


class _Group:
    """The rows that meet in a task: ids, vectors from their bytes, how far these may be
    off, and the bucket of each, in order of buckets."""

    def __init__(self, rows: pa.Table, dim: int):
        column = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        bucket = column("bucket", np.int64)
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.ids, self.away = bucket[order], column("ids", np.int64)[order], column("away", np.float64)[order]
        self.x = column("bytes", np.int8).reshape(-1, dim)[order] * column("scale", np.float64)[order, None]
        self.norm = (self.x * self.x).sum(axis=1)

    def bounds(self, i: np.ndarray, j: np.ndarray, square: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, row, lowest, highest distance) from squared distances."""
        d = np.sqrt(np.maximum(square, 0))
        slack = self.away[j] + 1e-6 * np.sqrt(self.norm[j] + own[i])  # and what rounding may have cost
        return i, j, d - slack, d + slack

    def near(self, q: np.ndarray, visitor: np.ndarray, visited: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, row, lowest, highest distance) of all rows that may be among the k nearest
        of those in the buckets that a query visits."""
        low, high = np.searchsorted(self.bucket, visited, "left"), np.searchsorted(self.bucket, visited, "right")
        own = (q * q).sum(axis=1)
        found = []
        large = high - low >= LARGE
        for bucket in np.unique(visited[large]):  # rows in their order: a product of matrices
            at = np.flatnonzero(visited == bucket)
            a, b = low[at[0]], high[at[0]]
            step = max(1, PAIRS // (b - a))
            for first in range(0, len(at), step):
                i = visitor[at[first : first + step]]
                square = self.norm[None, a:b] - 2 * q[i] @ self.x[a:b].T + own[i][:, None]
                i, j = np.repeat(i, b - a), np.tile(np.arange(a, b), len(i))
                found.append(nearest_of(*self.bounds(i, j, square.ravel(), own), k))
        small = np.flatnonzero(~large & (high > low))
        total = np.cumsum((high - low)[small])
        for some in np.split(small, np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))) if len(small) else ():
            n = (high - low)[some]
            i = np.repeat(visitor[some], n)
            j = np.arange(n.sum()) + np.repeat(low[some] - (np.cumsum(n) - n), n)
            found.append(self.bounds(i, j, ((self.x[j] - q[i]) ** 2).sum(axis=1), own))
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
        return nearest_of(*(np.concatenate(c) for c in zip(*found)), k)


def nearest_of(i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The (query, row, low, high) that may be among each query's k nearest: whose lowest
    distance is not beyond the k-th smallest of the highest."""
    order = np.lexsort((high, i))
    i, j, low, high = i[order], j[order], low[order], high[order]
    begin = np.searchsorted(i, i)
    last = begin + k - 1
    full = last < np.searchsorted(i, i, "right")
    cut = np.where(full, high[np.minimum(last, len(i) - 1)], np.inf)
    kept = low <= cut
    return i[kept], j[kept], low[kept], high[kept]


@F.arrow_udf(T.DoubleType())
def _distance(one: pa.Array, other: pa.Array) -> pa.Array:
    """Euclidean distances in double precision; both arrays hold lists of equal lengths."""
    out = np.zeros(len(one))
    for low in range(0, len(one), 4096):
        a, b = one.slice(low, 4096), other.slice(low, 4096)
        lengths = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        square = (a.flatten().to_numpy(zero_copy_only=False).astype(np.float64) - b.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) ** 2
        if len(square):
            out[low : low + len(a)] = np.sqrt(np.add.reduceat(square, np.cumsum(lengths) - lengths))
    return pa.array(out)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, recall: float = RECALL, tables: int = TABLES, axes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with is_query, its k nearest
    found rows other than itself by Euclidean distance in double precision, ties to
    smaller ids; all candidates, if there are fewer.

    The index is fitted to a sample of FIT_ROWS rows and FIT_QUERIES queries of each
    dimension, drawn by hash of their ids, and covers every row; as many buckets are probed
    as find `recall` of the sample's true neighbours. With a recall of 1 the answer is exact,
    and all rows are compared. `axes` fixes how many axes name a bucket. A query for which
    fewer than k rows are found, though there are more, is searched against all rows, in
    blocks.

    Vectors that are null or empty, all zero, or hold a null or non-finite component take
    no part, nor do rows without id. Vectors of different dimensions are never near. Of
    rows that repeat an id with the same vector one counts. Other columns are not read;
    an empty table gives no rows. Equal vectors are one row, and equal queries one query,
    however often they stand there; a row that is near to very many queries is joined by
    its id, where Spark's own splitting of skewed joins applies."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f8" if "double" in dict(vectors.dtypes)[vector] else "<f4"
    fields = "array<double>" if kind == "<f8" else "array<float>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(fields).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    ranked = rows.select("id", "v").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = table(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"), "vectors")
    # Equal queries: their ids in SALTS rows at most, all under the least of them.
    salted = rows.where("q").groupBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.array_sort(F.collect_set("id")).alias("of"))
    salted = table(salted, "queries")
    keys = table(salted.groupBy("v").agg(F.min(F.col("of")[0]).alias("key")).select("key", "v"), "keys")
    of = salted.join(keys, "v").select("key", "of")

    sizes = {r["dim"]: (r["n"], r["ids"]) for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}  # one row for each dimension
    known = _fit(distinct, keys, kind, {d: n for d, (n, _) in sizes.items()}, k, recall, tables, axes)

    def gathered(code: np.ndarray, held: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Rows gathered by code: a row for each code, the values of its rows end to end."""
        order = np.argsort(code, kind="stable")
        cut = np.flatnonzero(np.diff(code[order], prepend=-1))
        groups = [order[a:b] for a, b in zip(cut, np.append(cut[1:], len(order)))]
        columns = [pa.array([a[g].tobytes() for g in groups], pa.binary()) for a in held.values()]
        return pa.record_batch([pa.array(code[order[cut]]), *columns], names=["code", *held])

    def sent(code: np.ndarray, bucket: np.ndarray, ids: np.ndarray, what: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return gathered(code, dict(zip(("bucket", "ids", "bytes", "scale", "away"), (bucket, ids, *what))))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, x in _matrices(part, kind):
                index, what = known[x.shape[1]], encoded(x)
                unit, length = index.centred(x)
                for t in range(len(index.signs)):
                    bucket = index.buckets(unit, length, t)
                    part_ = np.zeros(len(ids), np.int64)
                    for hot, many in index.parts[t].items():
                        own = bucket == hot
                        part_[own] = ids[own] % many
                    yield sent(index.task(t, bucket, part_), bucket, ids, what)

    def probing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for every, vectors in _matrices(part, kind):
                index = known[vectors.shape[1]]
                step = max(1, SCORES // (1 if index.whole else index.cells // len(index.length)))
                for at in range(0, len(vectors), step):
                    ids, x = every[at : at + step], vectors[at : at + step]
                    unit, length = index.centred(x)
                    for t in range(len(index.signs)):
                        found = index.probed(unit, length, t)
                        for one in range(len(ids)):
                            bucket, part_ = index.visited(t, found[one])
                            told = gathered(index.task(t, bucket, part_), {"bucket": bucket})
                            yield pa.record_batch([told.column("code"), pa.array(np.full(len(told), ids[one])), told.column("bucket"), pa.array([x[one].tobytes()] * len(told), pa.binary())], names=["code", "key", "bucket", "v"])

    def together(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, x in _matrices(part, kind):
                blocks = -(-sizes[x.shape[1]][0] // CHUNK)
                yield sent((np.int64(x.shape[1]) << 44) + ids % blocks, np.zeros(len(ids), np.int64), ids, encoded(x))

    def asking_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(1, np.int64).tobytes()
        for part in parts:
            for ids, x in _matrices(part, kind):
                for block in range(-(-sizes[x.shape[1]][0] // CHUNK)):
                    yield pa.record_batch([pa.array(np.full(len(ids), (np.int64(x.shape[1]) << 44) + block)), pa.array(ids), pa.array([zero] * len(ids), pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["code", "key", "bucket", "v"])

    held = "code long, bucket binary, ids binary, bytes binary, scale binary, away binary"
    visit = "code long, key long, bucket binary, v binary"

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "low": pa.array([], pa.float64()), "high": pa.array([], pa.float64())})
        dim = one.column("code")[0].as_py() >> 44
        group = _Group(one, dim)
        blobs = other.column("bucket").to_pylist()
        q = np.frombuffer(b"".join(other.column("v").to_pylist()), kind).astype(np.float64).reshape(-1, dim)
        i, j, low, high = group.near(q, np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]), np.frombuffer(b"".join(blobs), np.int64), k + 1)
        return pa.table({"key": other.column("key").to_numpy()[i], "rep": group.ids[j], "low": low, "high": high})

    def nearest(dealt: DataFrame, asked: DataFrame) -> DataFrame:
        """(key, near): the k + 1 nearest found (score, vec_id) of each key, in order."""
        found = dealt.groupBy("code").cogroup(asked.groupBy("code")).applyInArrow(meet, "key long, rep long, low double, high double")
        found = found.groupBy("key", "rep").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        by_key = Window.partitionBy("key")
        found = found.withColumn("n", F.row_number().over(by_key.orderBy("high", "rep")))
        found = found.withColumn("cut", F.max(F.when(F.col("n") == k + 1, F.col("high"))).over(by_key)).where("cut IS NULL OR low <= cut")
        exact = found.select("key", "rep").join(distinct, "rep").join(keys.select("key", F.col("v").alias("w")), "key")
        scored = exact.select("key", "ids", _distance(F.col("v"), F.col("w")).alias("score"))
        near = scored.select("key", F.explode(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))).alias("x"))
        return near.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("near"))

    asking = keys.select("key", "v")
    found = table(nearest(distinct.select("rep", "v").mapInArrow(hashed, held), asking.mapInArrow(probing, visit)), "nearest")

    there = spark.createDataFrame([(d, ids) for d, (_, ids) in sizes.items()], "dim int, ids long")
    wanted = keys.join(there, F.size("v") == F.col("dim")).select("key", "dim", F.least("ids", F.lit(k + 1)).alias("want"))
    short = wanted.join(found, "key", "left").where(F.coalesce(F.size("near"), F.lit(0)) < F.col("want")).select("key", "dim")
    short = table(short, "short")
    if not short.isEmpty():
        every, lacking = distinct.select("rep", "v").mapInArrow(together, held), asking.join(short.select("key"), "key").select("key", "v")
        found = found.join(short, "key", "left_anti").unionByName(table(nearest(every, lacking.mapInArrow(asking_all, visit)), "widened"))
    answers = of.join(found, "key").select(F.explode("of").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("n", "x")).select("query_id", (F.col("n") + 1).alias("rank"), "x.vec_id", "x.score")


def _fit(distinct: DataFrame, keys: DataFrame, kind: str, sizes: dict[int, int], k: int, recall: float, tables: int, axes: int | None) -> dict[int, Index]:
    """An index for each dimension, fitted and calibrated on samples that pass the driver."""

    def sample(df: DataFrame, key: str, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(keys, vectors) of at most `most` rows of each dimension, by hash of the key."""
        by = Window.partitionBy("dim").orderBy(F.xxhash64(key), key)
        own = df.select(key, "v", F.size("v").alias("dim")).withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
        found: dict[int, list] = {}
        for r in own.select(key, "v", "dim").collect():
            found.setdefault(r["dim"], []).append((r[key], r["v"]))
        return {d: (np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.float64)) for d, some in found.items()}

    rows = sample(distinct, "rep", FIT_ROWS)
    known = {d: fitted(d, sizes[d], x, tables, axes) for d, (_, x) in rows.items()}
    asked = sample(keys, "key", FIT_QUERIES) if recall < 1 else {}

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of a task's rows to each query of the sample, but itself."""
        best: dict[int, tuple[np.ndarray, ...]] = {}
        for part in parts:
            for ids, x in _matrices(part, kind):
                if x.shape[1] not in asked:
                    continue
                key, q = asked[x.shape[1]]
                y = x.astype(np.float64)
                square = (q * q).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * q @ y.T
                square[ids[None, :] == key[:, None]] = np.inf
                take = min(k, len(ids))
                near = np.argpartition(square, take - 1, axis=1)[:, :take]
                new = (np.take_along_axis(square, near, 1), x[near])
                if x.shape[1] in best:
                    new = tuple(np.concatenate(c, axis=1) for c in zip(best[x.shape[1]], new))
                    near = np.argsort(new[0], axis=1, kind="stable")[:, :k]
                    new = (np.take_along_axis(new[0], near, 1), np.take_along_axis(new[1], near[:, :, None], 1))
                best[x.shape[1]] = new
        for dim, (square, x) in best.items():
            i, j = np.nonzero(np.isfinite(square))
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(square[i, j]), pa.array([v.tobytes() for v in x[i, j].astype(np.float64)], pa.binary())], names=["dim", "q", "square", "x"])

    if asked:
        by = Window.partitionBy("dim", "q").orderBy("square", "x")
        true = distinct.select("rep", "v").mapInArrow(nearest, "dim int, q int, square double, x binary").withColumn("n", F.row_number().over(by)).where(F.col("n") <= k)
        near: dict[int, list] = {}
        for r in true.select("dim", "q", "x").collect():  # k rows for each query of the sample
            near.setdefault(r["dim"], []).append((r["q"], r["x"]))
    for dim, index in known.items():
        mine = near.get(dim, []) if asked else []
        calibrate(index, asked[dim][1] if mine else np.zeros((0, dim)), np.array([np.frombuffer(x) for _, x in mine]).reshape(-1, dim), np.array([q for q, _ in mine], np.int64), rows[dim][1], recall)
    return known
