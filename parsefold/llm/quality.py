"""Document quality from random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector. A pass over all documents adds the index
vectors of each word's neighbours into its context vector (words share a table of
fixed size by hash). A document is pooled from its words: the mean context vector, the
mean index vector of its words' character triples, and how much its words and word
pairs repeat. A two-layer network, trained in numpy on a bounded sample of labelled
rows, reads the pooled vector; a temperature fitted on rows set aside calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import batches, mix, ship, slices, utf8, Words
from parsefold.llm.labelled import standardise, training_labels

ROWS, DIM, TRIPLE_DIM = 8192, 64, 128
#: Labelled training rows of each class, at most.
PER_CLASS = 10_000
HIDDEN, EPOCHS, BATCH, SEED = 24, 50, 64, 7
KEEP_AT = 0.3
#: Sums of tasks are added up a block of rows at a time, in rounds of at most 2^FAN_BITS
#: terms: four rounds take 2^24 tasks.
_BLOCKS, FAN_BITS, ROUNDS = 32, 6, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_AA = np.uint64(int(_A) ** 2 % (1 << 64))
WIDTH = DIM + TRIPLE_DIM + 4


def word_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each distinct word; the hashes of its character triples (with a
    space on either side), end to end, and their bounds."""
    points, bounds = words.characters()
    value = points.astype(np.uint64) * _B + np.uint64(1)
    triple = mix(value[:-2] + value[1:-1] * _A + value[2:] * _AA) if len(value) > 2 else np.zeros(0, np.uint64)
    n = np.diff(bounds) - 2
    start = np.cumsum(n) - n
    index = np.arange(n.sum()) + np.repeat(bounds[:-1] - start, n)
    triple = triple[index]
    place = mix((np.arange(n.sum()) - np.repeat(start, n)).astype(np.uint64) ^ _B)
    ends = np.append(start, n.sum()).astype(np.int64)
    whole = np.add.reduceat(mix(triple ^ place), start) if len(n) else np.zeros(0, np.uint64)
    return mix(whole), triple, ends


def neighbours(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Sums, for each table row, of the index vectors (two signed ones) of neighbours."""
    out = np.zeros(ROWS * DIM)
    if len(words.ids) < 2:
        return out.reshape(ROWS, DIM)
    h = hashes[words.ids]
    row = (h & np.uint64(ROWS - 1)).astype(np.int64) * DIM
    inside = np.ones(len(h) - 1, bool)
    cuts = words.bounds[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
    for shift in (20, 40):
        place = (h >> np.uint64(shift) & np.uint64(DIM - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * (h >> np.uint64(shift + 10) & np.uint64(1)).astype(np.float64)
        out += np.bincount(row[:-1][inside] + place[1:][inside], sign[1:][inside], ROWS * DIM)
        out += np.bincount(row[1:][inside] + place[:-1][inside], sign[:-1][inside], ROWS * DIM)
    return out.reshape(ROWS, DIM)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The context table over all texts: summed in the tasks, then by block in rounds of
    bounded fan-in; what the driver gets has a fixed size."""

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM))
        for part in parts:
            for texts in batches(slices(part.column(0))):
                words = Words(texts)
                if words.distinct:
                    total += neighbours(words, word_hashes(words)[0])
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        blobs = [b.tobytes() for b in np.split(total.astype(np.int64), _BLOCKS)]
        yield pa.record_batch([pa.array(range(_BLOCKS), pa.int32()), pa.array([task] * _BLOCKS, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "task", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(ROWS * DIM // _BLOCKS, np.int64)
        for blob in group.column("sums"):
            total += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table({"block": group.column("block").slice(0, 1), "task": group.column("task").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "block int, task int, sums binary"
    found = docs.select("text").mapInArrow(summed, kinds)
    for _ in range(ROUNDS):
        found = found.withColumn("task", F.shiftright("task", FAN_BITS)).groupBy("block", "task").applyInArrow(add, kinds)
    table = np.zeros((ROWS, DIM), np.float64)
    for block, blob in zip(*(c.to_pylist() for c in found.select("block", "sums").toArrow().columns)):
        table.reshape(_BLOCKS, -1)[block] += np.frombuffer(blob, np.int64)
    table = np.sign(table) * np.sqrt(np.abs(table))  # frequent neighbours would drown the rest
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.where(norm > 0, table / np.maximum(norm, 1e-9), 0)
    return (table - table.mean(axis=0)).astype(np.float32)


def pooled(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """One row for each text: mean context vector, mean index vector of its character
    triples, and how often words and word pairs repeat (zeros for a text without words)."""
    words = Words(texts)
    n = np.diff(words.bounds)
    some = np.maximum(n, 1)
    docs = len(texts)
    out = np.zeros((docs, WIDTH), np.float32)
    if not words.distinct:
        return out
    hashes, triple, ends = word_hashes(words)
    doc = np.repeat(np.arange(docs), n)
    full = np.flatnonzero(n)
    row = (hashes & np.uint64(ROWS - 1)).astype(np.int64)[words.ids]
    out[full, :DIM] = np.add.reduceat(table[row], words.bounds[full], axis=0) / n[full, None]
    many = np.diff(ends)[words.ids]
    first = np.cumsum(many) - many
    index = np.arange(many.sum()) + np.repeat(ends[:-1][words.ids] - first, many)
    place = (triple & np.uint64(TRIPLE_DIM - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * (triple >> np.uint64(30) & np.uint64(1)).astype(np.float64)
    flat = np.bincount(np.repeat(doc, many) * TRIPLE_DIM + place[index], sign[index], docs * TRIPLE_DIM)
    out[:, DIM:-4] = flat.reshape(docs, TRIPLE_DIM) / some[:, None]
    width = len(words.distinct)
    kinds = np.bincount(np.unique(doc * width + words.ids) // width, minlength=docs)
    same, pairs = np.zeros(docs), np.zeros(docs)
    if len(words.ids) > 1:
        inside = doc[1:] == doc[:-1]
        own = doc[1:][inside]
        same = np.bincount(own, (words.ids[1:] == words.ids[:-1])[inside], docs)
        key = (mix(hashes[words.ids[:-1]]) + hashes[words.ids[1:]])[inside] ^ mix(own.astype(np.uint64))
        pairs = np.bincount(own[np.unique(key, return_index=True)[1]], minlength=docs)
    out[:, -4] = np.log1p(n)
    out[:, -3] = kinds / some
    out[:, -2] = pairs / np.maximum(n - 1, 1)
    out[:, -1] = same / np.maximum(n - 1, 1)
    return out


@dataclass
class Network:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # weights and bias of the hidden layer, then of the output
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, table: np.ndarray) -> Network:
    """Adam on weighted cross entropy, with noise-free standardised inputs; a tenth of
    the rows is set aside for the temperature."""
    random = np.random.default_rng(SEED)
    aside = random.random(len(x)) < 0.1
    mean, scale = standardise(x)
    z = ((x - mean) / scale).astype(np.float32)
    np.clip(z, -8, 8, out=z)
    w = [random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    w = [a.astype(np.float32) for a in w]
    m, v, step, decay = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, 1e-4
    rows = np.flatnonzero(~aside)
    weight = (weight / weight.mean()).astype(np.float32)
    for epoch in range(EPOCHS):
        random.shuffle(rows)
        rate = 0.004 * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(rows), BATCH):
            i = rows[at : at + BATCH]
            a = np.tanh(z[i] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -30, 30)))
            d = weight[i] * (p - y[i]).astype(np.float32) / len(i)
            e = d[:, None] * w[2] * (1 - a * a)
            grad = [z[i].T @ e + decay * w[0], e.sum(0), a.T @ d + decay * w[2], d.sum()]
            step += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(table, mean.astype(np.float32), scale.astype(np.float32), [np.asarray(a, np.float32) for a in w])
    if aside.any():
        logit, t, u = net.logit(x[aside]), y[aside], weight[aside]
        loss = lambda temperature: (u * np.logaddexp(0, np.where(t == 1, -1, 1) * np.clip(logit / temperature, -30, 30))).sum()
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Network:
    """Learn from docs and labels(doc_id, quality), of which at most `per_class` rows of
    each class outside the held-out fold are used.

    Null texts count as empty; a text's length has no bound. Repeated rows count each time;
    rows without id are in no class. Without a row of either class (an empty table, too)
    every score is the share of good rows (1 if there is none). Other columns are not
    read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))
    sampled, share = training_labels(labels, "quality", per_class)
    table = context_vectors(rows)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            first = 0
            for texts in batches(slices(part.column(1))):
                x = pooled(texts, shared.value)
                yield pa.record_batch([part.column(0).slice(first, len(texts)), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])
                first += len(texts)

    chosen = rows.join(F.broadcast(sampled), "doc_id").select("label", "text")  # at most 2 * per_class rows
    got = chosen.mapInArrow(described, "label int, x binary").toArrow()
    shared.unpersist()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(got), WIDTH)
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((x[:, 0], y)) if len(y) else np.zeros(0, np.int64)  # the same rows in the same order, however dealt
    x, y = x[order], y[order]
    if not 0 < y.sum() < len(y):
        c = 30.0 if share[0] == 0 else -30.0 if share[1] == 0 else float(np.log(share[1] / share[0]))
        return Network(table, np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), [np.zeros((WIDTH, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), np.float32(c)])
    weight = np.where(y == 1, share[1] / y.mean(), share[0] / (1 - y.mean()))
    return train(x, y, weight, table)


def scorer(docs: DataFrame, net: Network, text: str = "text") -> Column:
    """A column of probabilities of good quality; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(texts: pa.Array) -> pa.Array:
        out = [shared.value.probability(pooled(some, shared.value.table)) for some in batches(slices(texts))]
        return pa.array(np.concatenate(out).astype(np.float64) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scored, T.DoubleType())(utf8(F.col(text)))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """docs with a quality probability in column `out` (replaced if it is there), for every
    row: also for null, empty and repeated texts and rows without id, whose scores depend
    on the text alone. An empty table gives no rows."""
    return docs.withColumn(out, scorer(docs, fit(docs, labels, doc_id, text, per_class), text))
