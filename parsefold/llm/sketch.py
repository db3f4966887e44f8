"""Document fingerprints as threshold-scaled sketches.

Every shingle of five words has a 63-bit hash; a text's sketch is the set of its hashes
below a fixed fraction of all, or, where none is, the smallest. A sketch grows with its
text, so the share of one sketch that another holds estimates the share of shingles, however
unequal the texts; sketches of parts merge into the sketch of the whole.

Edited texts, which borrow from the next document, need each row's successor: rows are
dealt to ranges of the key, whose bounds come from quantiles; the first row of a range also
goes to the range before. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import fresh, give_back, mix, offsets, pinned, ship, utf8

SHINGLE_WORDS, SCALE = 5, 8
#: Odd multipliers of a shingle's words, by place: the first multiples of the golden ratio's
#: bits. Shingles of more words take more.
_GOLDEN = 0x9E3779B97F4A7C15


def multipliers(words: int) -> list[int]:
    return [((k + 1) * _GOLDEN | 1) & ((1 << 64) - 1) for k in range(words)]


def word_hash(word: bytes) -> int:
    """The second half of the word's MD5 as a little-endian number."""
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[8:], "little")


class Sketcher:
    """Sketches of texts; remembers the hashes of short words, up to a bound."""

    REMEMBERED, LONGEST = 1 << 18, 64

    def __init__(self, words: int = SHINGLE_WORDS, scale: int = SCALE):
        self.words, self.limit = words, np.uint64((1 << 63) // scale)
        self.by = np.array(multipliers(words), np.uint64)
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = word_hash(word)
            if len(word) <= self.LONGEST:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def sketch(self, text: bytes) -> np.ndarray:
        """The sketch, ascending. A-Z are lower-cased, words split at the six ASCII spaces;
        fewer words than a shingle are one shingle, none are no shingle."""
        w = text.lower().split()
        if not w:
            return np.zeros(0, np.int64)
        h = np.fromiter(map(self._hash, w), np.uint64, len(w))
        n = max(1, len(h) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for k, m in enumerate(self.by[: len(h)]):
            total += h[k : k + n] * m
        found = mix(total) >> np.uint64(1)
        low = found[found < self.limit]
        return np.unique(low if len(low) else found.min(keepdims=True)).view(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the smaller sketch that the other holds; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def with_sketch(docs: DataFrame, text: str = "text", out: str = "sketch", words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """docs with the sketch of each whole text as an ascending array<bigint> in column
    `out`, which is replaced if it is there. Null, empty and blank texts have an empty
    sketch; equal texts have equal sketches, repeated rows repeat; a very long text is
    hashed whole, in about 150 bytes a word; an empty table gives no rows."""
    ship(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sketches(texts: pa.Array) -> pa.Array:
        own = Sketcher(words, scale)
        return _lists([own.sketch(t.as_buffer().to_pybytes()) for t in texts])

    held = fresh(docs, "__text")
    return pinned(docs, utf8(F.col(text)), held).withColumn(out, sketches(F.col(held))).drop(held)


def _lists(found: list[np.ndarray]) -> pa.Array:
    bounds = offsets(np.fromiter(map(len, found), np.int64, len(found))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    return F.transform(F.array(both), lambda x: F.when(F.get(x, F.lit(0)) < (1 << 63) // scale, F.filter(x, lambda h: h < (1 << 63) // scale)).otherwise(F.slice(x, 1, 1)))[0]


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; null if a is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def resemblance(a: Column, b: Column) -> Column:
    """The estimated share of shared ones among all shingles of both; null without any."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every)


def hexadecimal(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


# ------------------------------------------------------------- each row and the next


#: Rows of a range of the key, while there are at most MAX_RANGES: one number for each
#: range passes the driver.
RANGE_ROWS, MAX_RANGES = 2048, 1 << 18


def in_ranges(rows: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """rows (key long, ...) with `range` int and `halo` boolean: each row in the range of
    its key, and a copy of the rows with a range's smallest key, marked as halo, in the
    range before; the last range has the first one's. A null key comes first."""
    keys = rows.select(key)
    if ranges is None:
        ranges = max(1, min(MAX_RANGES, keys.count() // RANGE_ROWS))
    # Keys alone are dealt by Spark's sampled bounds; each range is known by its smallest.
    dealt = keys.repartitionByRange(ranges, F.col(key).asc_nulls_first())
    smallest = F.min(F.struct(F.col(key).isNotNull().alias("there"), F.col(key).alias("key")))
    firsts = sorted((r["x"]["there"], r["x"]["key"] or 0) for r in dealt.groupBy(F.spark_partition_id()).agg(smallest.alias("x")).collect())
    has_null = bool(firsts) and not firsts[0][0]
    bounds = np.array([k for there, k in firsts if there], np.int64)

    @F.arrow_udf("array<struct<range:int,halo:boolean>>")
    def places(keys: pa.Array) -> pa.Array:
        # Before the first bound are null keys and, in their range, what follows them.
        none, own = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, own, side="right") - 1 + has_null
        at[none] = 0
        begins = none | np.isin(own, bounds)
        many = offsets(1 + begins.astype(np.int64))
        to, halo = np.repeat(at, 1 + begins), np.zeros(many[-1], bool)
        last = many[1:][begins] - 1
        to[last], halo[last] = (to[last] - 1) % len(firsts), True
        return pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), pa.StructArray.from_arrays([pa.array(to.astype(np.int32)), pa.array(halo)], ["range", "halo"]))

    return rows.withColumn("__to", places(F.col(key))).select("*", F.inline("__to")).drop("__to")


AUDIT = "doc_id long, n_chars long, edited_sha256 string, sketch array<bigint>, edited_sketch array<bigint>, near_edited double, near_next double"


def audit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, scale: int = SCALE, ranges: int | None = None) -> DataFrame:
    """How far an edit moves a fingerprint: for each document doc_id, n_chars (code points),
    edited_sha256, sketch, edited_sketch, near_edited and near_next.

    The edited text is the document with its last quarter of code points (rounded down)
    replaced by the first as many, or all, of the next document's, in order of id; the last
    is followed by the first, a single one by itself. near_edited and near_next are the
    likenesses of the document's sketch to those of the edited text and of the next.

    Null text counts as empty; a null id comes first; documents with one id follow each
    other in order of their texts (all of one id are in one task); repeated rows stay. A
    very long text is handled whole. An empty table gives no rows."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))
    dealt = in_ranges(rows, "doc_id", ranges)
    # Within a range: null ids, then ids, then the halo, which is only looked at.
    sorted_ = dealt.repartition("range").sortWithinPartitions("range", "halo", F.col("doc_id").asc_nulls_first(), "text")

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketcher(words, scale)
        held: tuple | None = None  # the last row: id, text, sketch, range
        for part in parts:
            ids, at, halos, out = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), []
            for i, raw in enumerate(part.column(1)):
                if halos[i] and (held is None or held[3] != at[i]):
                    continue  # a further row of the halo
                raw = raw.as_buffer().to_pybytes()
                new = (ids[i], raw.decode("utf-8", "replace"), own.sketch(raw), at[i])
                if held is not None:
                    key, whole, sketch, _ = held
                    cut = len(whole) // 4
                    edited = (whole[: len(whole) - cut] + new[1][:cut]).encode("utf-8", "surrogatepass")
                    moved = own.sketch(edited)
                    out.append((key, len(whole), hashlib.sha256(edited).hexdigest(), sketch, moved, likeness(sketch, moved), likeness(sketch, new[2])))
                held = None if halos[i] else new
            if out:
                key, n, sha, sketch, moved, near, after = zip(*out)
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), _lists(sketch), _lists(moved), pa.array(near), pa.array(after)], names=["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "near_edited", "near_next"])
        give_back()

    return sorted_.select("doc_id", "text", "range", "halo").mapInArrow(compared, AUDIT)
