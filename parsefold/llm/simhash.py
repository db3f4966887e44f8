"""Near-duplicate groups by 64-bit SimHash fingerprints and a binary trie self-join.

1. A vectorised function turns each whole text into a fingerprint. Only
   (fingerprint, id) rows go on; equal fingerprints become one row with their
   smallest id, so that a group of copies of any size is one trie leaf.
2. The top of the trie is cut where a subtree holds few enough fingerprints. Node
   pairs of that cut are traversed on the driver (their number is bounded by
   MAX_NODES), adding up differing prefix bits and dropping pairs over budget.
3. Each surviving pair of subtrees is a task: both subtrees are traversed together,
   differing bits are added up, and a pair is pruned once over budget, or once all
   below it is known to be one component. What leaves a task is a star forest of its
   components: fewer rows than its fingerprints, never all pairs of a group.
4. Large-star/small-star rounds join the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import fresh, give_back, join_to_one, ship, table, utf8

SEED = 42
SHINGLE_WORDS = 3
BUDGET = 3
#: Fingerprints a cut subtree holds at most, while there are few; never more than
#: about MAX_NODES subtrees, so that the plan on the driver stays bounded.
NODE_ROWS, MAX_NODES = 16384, 512

# Byte value -> its eight bits, each in a byte of its own (lowest bit first).
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
_WEIGHTS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in blocks: bytes.lower() touches A-Z alone and
    bytes.split() splits on exactly the six ASCII spaces."""
    w = text.lower().split()
    if not w:
        return
    if len(w) < words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], dtype=np.uint64)
        return
    digest, n = xxhash.xxh64_intdigest, len(w) - words + 1
    for at in range(0, n, 1 << 16):
        part = w[at : at + (1 << 16) + words - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(words))))
        yield np.fromiter((digest(s, SEED) for s in runs), np.uint64, len(part) - words + 1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits, how many of h have it: eight byte-wide counters travel in
    each 64-bit addition, emptied before any can overflow."""
    lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        counts += bit_counts(h)
        n += len(h)
    return int(_WEIGHTS[counts * 2 > n].sum(dtype=np.uint64)) if n else 0


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) for t in texts), np.uint64, len(texts))
    give_back()
    return pa.array(found.view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df with its fingerprint as a signed long in column `out`, which is replaced if it is
    there; null text counts as empty; repeated rows repeat; a very long text is hashed whole,
    65,536 shingles at a time beside its words; an empty table gives no rows."""
    ship(df.sparkSession)
    return df.withColumn(out, _fingerprints(utf8(F.col(text))))


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- the trie in a task


class Trie:
    """Sorted distinct fingerprints seen as a binary trie: at each depth, nodes are
    runs of equal prefixes, and each knows its two children one level down. Levels are
    laid out when the traversal first comes to them."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.child: list[tuple[np.ndarray, np.ndarray]] = []

    def down_to(self, depth: int) -> None:
        while len(self.starts) <= depth:
            d = len(self.starts) - 1
            prefixes = self.keys >> np.uint64(63 - d)
            up, down = self.starts[d], np.concatenate([[0], np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1])
            parent = np.searchsorted(up, down, side="right") - 1
            bit = prefixes[down] & np.uint64(1)
            zero, one = np.full(len(up), -1, np.int64), np.full(len(up), -1, np.int64)
            zero[parent[bit == 0]] = np.flatnonzero(bit == 0)
            one[parent[bit == 1]] = np.flatnonzero(bit == 1)
            self.starts.append(down)
            self.child.append((zero, one))

    def sizes(self, d: int) -> np.ndarray:
        self.down_to(d)
        return np.diff(np.append(self.starts[d], len(self.keys)))

    def uniform(self, d: int, labels: np.ndarray) -> np.ndarray:
        """The label all leaves below a node share, or -1."""
        low, high = np.minimum.reduceat(labels, self.starts[d]), np.maximum.reduceat(labels, self.starts[d])
        return np.where(low == high, low, -1)


def merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the classes of u[i] and v[i]; each keeps its smallest member as label."""
    while len(u):
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further


#: Two nodes of so few keys each are compared key by key instead of further descent.
LEAF = 8


def _leaf_links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within `most` bits among a[i : i + LEAF] and b[j : j + LEAF], for each
    pair of starts. Rows past a node's end belong to its neighbours: their distance is
    measured like any other, so whatever is found is a true link."""
    step = np.arange(LEAF)
    p, q = np.minimum(i[:, None] + step, len(a) - 1), np.minimum(j[:, None] + step, len(b) - 1)
    near = np.bitwise_count(a[p][:, :, None] ^ b[q][:, None, :]) <= most
    n, x, y = np.nonzero(near)
    return p[n, x], q[n, y]


def trie_components(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET, block: int = 1 << 15) -> np.ndarray:
    """Labels over the keys of a (then of b), equal where a chain of links of at most
    `budget` differing bits joins two keys: links inside a, or, given b, between a and
    b. A first pass with a budget of one bit unites dense groups, which the full pass
    then prunes as known."""
    left, right = Trie(a), None if b is None else Trie(b)
    other, shift = (left, 0) if right is None else (right, len(a))
    labels = np.arange(len(a) + (0 if b is None else len(b)), dtype=np.int64)
    if not len(a) or not len(other.keys):
        return labels
    for most in sorted({min(1, budget), budget}):
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        any_known = bool((labels != np.arange(len(labels))).any())

        def same(d: int) -> tuple[np.ndarray, np.ndarray]:
            if d not in known:
                x = left.uniform(d, labels[: len(a)])
                known[d] = (x, x if right is None else right.uniform(d, labels[shift:]))
            return known[d]

        sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        zero = np.zeros(1, np.int64)
        stack = [(0, zero, zero, np.zeros(1, np.int8))]
        while stack:
            d, i, j, used = stack.pop()
            if len(i) > block:
                for at in range(0, len(i), block):
                    stack.append((d, i[at : at + block], j[at : at + block], used[at : at + block]))
                continue
            if d not in sizes:
                sizes[d] = (left.sizes(d), other.sizes(d))
            if any_known:
                x, y = same(d)
                keep = (x[i] < 0) | (x[i] != y[j])
                i, j, used = i[keep], j[keep], used[keep]
            small = (sizes[d][0][i] <= LEAF) & (sizes[d][1][j] <= LEAF)
            if small.any():
                p, q = _leaf_links(a, other.keys, left.starts[d][i[small]], other.starts[d][j[small]], most)
                merge(labels, p, q + shift)
                rest = ~small
                i, j, used = i[rest], j[rest], used[rest]
            if not len(i):
                continue
            left.down_to(d + 1)
            other.down_to(d + 1)
            (l0, l1), (r0, r1) = left.child[d], other.child[d]
            costly = used < most
            p, q, w = i[costly], j[costly], used[costly] + np.int8(1)
            apart = np.ones(len(p), bool) if right is not None else p != q  # a node and itself: once is enough
            ni = np.concatenate([l0[i], l1[i], l0[p], l1[p[apart]]])
            nj = np.concatenate([r0[j], r1[j], r1[q], r0[q[apart]]])
            nu = np.concatenate([used, used, w, w[apart]])
            there = (ni >= 0) & (nj >= 0)
            if there.any():
                stack.append((d + 1, ni[there], nj[there], nu[there]))
    return labels


# ---------------------------------------------------------------- the trie across tasks


def cut_nodes(reps: DataFrame, total: int) -> list[tuple[int, int, int]]:
    """(prefix, depth, rows) of the trie's cut: highest nodes with few enough
    fingerprints. Counts come down eight bits at a time and only below nodes that are
    still too full: at most MAX_NODES * 256 numbers each time."""
    cap = max(NODE_ROWS, -(-total // MAX_NODES))
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    counts: dict[tuple[int, int], int] = {}
    heavy, depth = {0: total}, 0
    while heavy and depth < 64:
        source = reps
        if depth:
            names = sorted(p - (1 << depth) if p >> (depth - 1) else p for p in heavy)
            source = reps.where(F.shiftright("fp", 64 - depth).isin(names))
        depth += 8
        found = source.groupBy(F.shiftright("fp", 64 - depth).alias("p")).count().collect()
        counts |= {(depth, unsigned(r["p"]) & ((1 << depth) - 1)): r["count"] for r in found}
        heavy = {p: n for (d, p), n in counts.items() if d == depth and n > cap}
    full = dict(counts)
    for (d, p), n in counts.items():  # sums of every node above
        for up in range(d - 1, d - 9, -1):
            key = (up, p >> (d - up))
            if up % 8:
                full[key] = full.get(key, 0) + n
    full[0, 0] = total
    out, stack = [], [(0, 0)]
    while stack:
        d, p = stack.pop()
        n = full.get((d, p), 0)
        if not n:
            continue
        if n <= cap or d == 64:
            out.append((p, d, n))
        else:
            stack += [(d + 1, p << 1), (d + 1, p << 1 | 1)]
    return sorted(out, key=lambda x: x[0] << (64 - x[1]))


def node_pairs(nodes: list[tuple[int, int, int]], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Pairs of cut nodes whose prefixes can still meet the budget, found by walking the
    cut trie against itself."""
    number = {(d, p): k for k, (p, d, _) in enumerate(nodes)}
    inner = {(up, p >> (d - up)) for p, d, _ in nodes for up in range(d)}
    found, stack = set(), [((0, 0), (0, 0), 0)]
    while stack:
        a, b, used = stack.pop()
        if a in number and b in number:
            found.add((min(number[a], number[b]), max(number[a], number[b])))
            continue
        (da, pa_), (db, pb) = a, b
        if a in number:
            ups, downs = [a], [(db + 1, pb << 1), (db + 1, pb << 1 | 1)]
        elif b in number:
            ups, downs = [(da + 1, pa_ << 1), (da + 1, pa_ << 1 | 1)], [b]
        else:
            ups, downs = ([(da + 1, pa_ << 1), (da + 1, pa_ << 1 | 1)], [(db + 1, pb << 1), (db + 1, pb << 1 | 1)])
        for x in ups:
            for y in downs:
                if not all(z in number or z in inner for z in (x, y)):
                    continue
                depth = min(x[0], y[0])
                differ = bin((x[1] >> (x[0] - depth)) ^ (y[1] >> (y[0] - depth))).count("1")
                if differ <= budget and (a != b or x <= y):
                    stack.append((x, y, differ))
    return sorted(found)


def trie_forest(reps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all links among the distinct
    fingerprints `fp` of reps."""
    total = reps.count()
    nodes = cut_nodes(reps, total)
    pairs = node_pairs(nodes, budget)
    heads = np.array([p << (64 - d) for p, d, _ in nodes], dtype=np.uint64)
    tasks: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for k, (x, y) in enumerate(pairs):
        tasks[x].append((k, 0))
        if x != y:
            tasks[y].append((k, 1))
    single = [x == y for x, y in pairs]
    schema = pa.schema([("pair", pa.int32()), ("side", pa.int8()), ("keys", pa.binary())])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            at = np.append(np.searchsorted(keys, heads), len(keys))
            for node in range(len(heads)):
                if at[node] < at[node + 1]:
                    blob = keys[at[node] : at[node + 1]].tobytes()
                    own = tasks[node]
                    yield pa.record_batch([pa.array([k for k, _ in own], pa.int32()), pa.array([s for _, s in own], pa.int8()), pa.array([blob] * len(own), pa.binary())], schema=schema)

        held, n = [], 0
        for part in parts:
            held.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= 1 << 18:
                yield from sent(held)
                held, n = [], 0
        if n:
            yield from sent(held)

    def join(group: pa.Table) -> pa.Table:
        sides = {0: [], 1: []}
        for side, blob in zip(group.column("side").to_pylist(), group.column("keys").to_pylist()):
            sides[side].append(np.frombuffer(blob, np.uint64))
        a, b = (np.unique(np.concatenate(s)) if s else np.zeros(0, np.uint64) for s in (sides[0], sides[1]))
        labels = trie_components(a, None if single[group.column("pair")[0].as_py()] else b, budget)
        keys = np.concatenate([a, b]).view(np.int64)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        u, v = keys[moved], keys[labels[moved]]
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    dealt = reps.select("fp").mapInArrow(deal, "pair int, side tinyint, keys binary")
    return dealt.groupBy("pair").applyInArrow(join, "u long, v long")


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges become stars of their components: no more rows than before."""

    def stars(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([p.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for p in parts if p.num_rows]
        if held:
            both = np.concatenate(held, axis=1)
            nodes, at = np.unique(both, return_inverse=True)
            at = at.reshape(both.shape)
            labels = np.arange(len(nodes))
            merge(labels, at[0], at[1])
            moved = np.flatnonzero(labels != np.arange(len(nodes)))
            yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], names=["u", "v"])

    return edges.mapInArrow(stars, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has a smaller one in its component, and that component's
    smallest. Alternating large-star and small-star rounds until nothing changes."""
    now = table(contract(edges), "stars")

    def summary(df: DataFrame) -> tuple:
        return tuple(df.select(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())

    was = summary(now)
    while True:
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_to_one(ends, least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large, "large-stars")
        small = join_to_one(large, large.groupBy("u").agg(F.min("v").alias("m")), "u")
        both = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = table(contract(both.select("e.*").where("u > v").distinct()).distinct(), "stars")
        is_ = summary(now)
        if is_ == was:
            return now
        was = is_


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each row of df: doc_id, fp (signed long), component_id (the smallest
    doc_id reachable by links of at most `budget` differing bits).

    Null text counts as empty; a text with no word has fingerprint zero and links like
    any other; a very long text is read whole, by the task that holds its row. Equal texts, repeated rows and repeated ids share a component. A null
    doc_id never names a component unless no row of it has another id. An empty table
    gives an empty result. Other columns of df are not read."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = table(with_fingerprint(rows).select("doc_id", "fp"), "fingerprints")
    reps = table(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("count")), "distinct")
    joined = connected(trie_forest(reps, budget))
    grouped = reps.join(joined, reps.fp == joined.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    grouped = table(grouped, "roots")
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = table(join_to_one(grouped.select("fp", "root"), names, "root").select("fp", "component_id"), "named")
    return join_to_one(signed, named, "fp", counts=reps.select("fp", "count")).select("doc_id", "fp", "component_id")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without all but one document of each component: that of the smallest doc_id.
    Of rows that repeat a kept id, one stays (the first by its columns as JSON)."""
    found = table(components(df, doc_id, text), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    mark, rank = fresh(df, "__id"), fresh(df, "__rank")
    goes = table(found.where(~stays).select(F.col("doc_id").alias(mark)).distinct(), "duplicates")
    same = lambda other: df[doc_id].cast("long").eqNullSafe(other[mark])
    out = df.join(goes, same(goes), "left_anti")
    again = table(found.where(stays).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark)), "repeated")
    if again.isEmpty():
        return out
    once = out.join(again, same(again), "left_anti")
    order = Window.partitionBy(F.col(doc_id).cast("long")).orderBy(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    first = out.join(again, same(again), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return once.unionByName(first.select(*df.columns))
