"""Periodic runs of words by the runs theorem.

A run is a maximal stretch with smallest period p; its Lyndon root, under one of the two
orders of the alphabet, is the longest Lyndon word at each place where it begins.

1. Each document has an alphabet of its own, so that a batch of documents is one text
   whose suffixes are sorted together by prefix doubling, without comparing copies.
2. The longest Lyndon word at i ends where the inverse suffix array has its next smaller
   value (for the reversed order, its next greater one).
3. Each such root is extended to both sides by longest common extensions: the smallest
   LCP between two ranks, by range-minimum queries over a sparse table of blocks.

Work is n log n for n words of a document; documents are rows of one scan, nothing is
shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import batches, fresh, give_back, offsets, pinned, ship, slices, utf8

MIN_LENGTH, EXPONENT = 6, 4
#: Bytes of text whose suffixes are sorted together; a longer text stands alone.
BATCH_BYTES = 1 << 19
_BLOCK = 16

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank from 1 of each suffix of symbols, a shorter one before what it begins.
    Only groups that are still equal are sorted again, by twice as many symbols."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n + 1, np.int64)

    def number(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank the suffixes in these slots by their sorted keys; the slots still tied."""
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = keys[1:] != keys[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new[:-1], np.arange(len(keys)), 0))] + 1
        return slots[~(new[:-1] & new[1:])]

    tied, step = number(np.arange(n), symbols[order]), 1
    while len(tied):
        at = order[tied]
        keys = rank[at] * (n + 1) + rank[np.minimum(at + step, n)]
        by = np.argsort(keys, kind="stable")
        order[tied] = at[by]
        tied, step = number(tied, keys[by]), step * 2
    return rank[:n]


def next_values(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next one with a smaller rank, and with a greater; the length
    where there is none."""
    n = len(ranks)
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    values = ranks.tolist()
    for i, v in enumerate(values):
        while rising and values[rising[-1]] > v:
            smaller[rising.pop()] = i
        while falling and values[falling[-1]] < v:
            greater[falling.pop()] = i
        rising.append(i)
        falling.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def common_prefixes(symbols: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """By rank, how many symbols a suffix shares with the one sorted before it."""
    n = len(symbols)
    places = np.zeros(n, np.int64)
    places[ranks - 1] = np.arange(n)
    before = places[np.maximum(ranks - 2, 0)].tolist()
    w, out, h = [*symbols.tolist(), -1], [0] * n, 0
    for i, r in enumerate(ranks.tolist()):
        if r > 1:
            j = before[i]
            top = n - max(i, j)
            while h < top and w[i + h] == w[j + h]:
                h += 1
            out[r - 1] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return np.array(out, np.int64)


class Minima:
    """Smallest values of ranges: running minima inside blocks, a sparse table over them."""

    def __init__(self, values: np.ndarray):
        self.values = values
        padded = np.full(-(-len(values) // _BLOCK) * _BLOCK, np.iinfo(np.int64).max)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, _BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest of values[low[i]..high[i]], both included."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        same = np.flatnonzero(first == last)
        if len(same):
            a, b = low[same], high[same]
            out[same] = np.minimum.reduce([self.values[np.minimum(a + k, b)] for k in range(_BLOCK)])
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = level == k
                t = self.table[k]
                at = wide[own]
                out[at] = np.minimum(out[at], np.minimum(t[a[own]], t[b[own] - (1 << int(k))]))
        return out


class Extensions:
    """How far equal symbols go on from two places of a text."""

    def __init__(self, symbols: np.ndarray):
        self.ranks = suffix_ranks(symbols)
        self.minima = Minima(common_prefixes(symbols, self.ranks))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.ranks[i], self.ranks[j]
        return self.minima.between(np.minimum(a, b), np.maximum(a, b) - 1)


def _laid_out(words: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents as one text in which documents share no symbol, each
    with an end mark smaller than its words; and where each begins, with the total."""
    sizes = bounds[docs + 1] - bounds[docs]
    starts = offsets(sizes + 1)
    most = int(words.max(initial=0)) + 2
    owner = np.repeat(np.arange(len(docs)), sizes)
    local = np.arange(len(owner)) - offsets(sizes)[owner]
    symbols = np.repeat(np.arange(len(docs)) * most, sizes + 1)
    symbols[starts[owner] + local] += words[bounds[docs][owner] + local] + 1
    return symbols, starts


def find(words: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of documents whose word numbers are words[bounds[d]:bounds[d + 1]], as
    (document, start, length, period), sorted in this order of start, then period."""
    none = np.zeros(0, np.int64)
    # The shortest stretch with that exponent has that many words.
    docs = np.flatnonzero(np.diff(bounds) >= max(min_length, exponent))
    if not len(docs):
        return none, none, none, none
    symbols, starts = _laid_out(words, bounds, docs)
    held, period = _roots(symbols, min_length, exponent)
    if not len(held):
        return none, none, none, none

    # Roots that may be repeated often enough are few: only their documents go on.
    owner = np.searchsorted(starts, held, side="right") - 1
    local, some = held - starts[owner], np.unique(owner)
    docs, owner = docs[some], np.searchsorted(some, owner)
    symbols, starts = _laid_out(words, bounds, docs)
    at = starts[owner] + local
    right = Extensions(symbols).common(at, at + period)
    enough = right >= _least(period, min_length, exponent)
    at, period, right, owner = at[enough], period[enough], right[enough], owner[enough]
    # Roots of one run share its end and its period: the first of them is enough.
    by = np.lexsort((at, period, at + period + right))
    at, period, right, owner = at[by], period[by], right[by], owner[by]
    end = at + period + right
    first = np.ones(len(at), bool)
    first[1:] = (end[1:] != end[:-1]) | (period[1:] != period[:-1])
    at, period, owner, end = at[first], period[first], owner[first], end[first]
    if not len(at):
        return none, none, none, none

    # To the left: the same in the reversed text, where documents keep end marks.
    last = len(symbols) - 1
    left = np.zeros(len(at), np.int64)
    inner = np.flatnonzero(at > starts[owner])
    if len(inner):
        left[inner] = Extensions(symbols[::-1].copy()).common(last - at[inner] + 1, last - at[inner] - period[inner] + 1)
        left = np.minimum(left, at - starts[owner])
    begin = at - left
    long = end - begin >= np.maximum(min_length, exponent * period)
    doc, start, length, period = docs[owner[long]], (begin - starts[owner])[long], (end - begin)[long], period[long]
    by = np.lexsort((period, start, doc))
    return doc[by], start[by], length[by], period[by]


def _least(period: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """What the first root of a run that is long enough shares at least with what comes a
    period later: the root begins within the run's first period."""
    return np.maximum(np.maximum(min_length, exponent * period) - 2 * period + 1, 1)


def _roots(symbols: np.ndarray, min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the longest Lyndon words, under both orders, that three
    symbols of a long enough repetition don't speak against."""
    places, periods = [], []
    here = np.arange(len(symbols))
    for after in next_values(suffix_ranks(symbols)):
        period = after - here
        shared = _least(period, min_length, exponent)
        at = here[here + period + shared <= len(symbols)]
        for part in (0, 1, 2):
            more = at + (shared[at] - 1) * part // 2
            at = at[symbols[more] == symbols[more + period[at]]]
        places.append(at)
        periods.append(period[at])
    return np.concatenate(places), np.concatenate(periods)


def _batch(texts: list[bytes], min_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], list[bytes]]:
    """Of a batch of texts: words each, runs each, the runs, and the collapsed texts."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    bounds = offsets(sizes)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(bounds[-1]))
    doc, *runs = find(words, bounds, min_length, exponent)
    start, length, period = runs
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, bounds[doc] + start + period, 1)
    np.add.at(dropped, bounds[doc] + start + length, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    some = set(doc.tolist())
    collapsed = [b" ".join([w for w, k in zip(ws, kept[bounds[d] : bounds[d + 1]].tolist()) if k] if d in some else ws) for d, ws in enumerate(split)]
    return sizes, np.bincount(doc, minlength=len(texts)), (start, length, period), collapsed


def with_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, prefix: str = "") -> DataFrame:
    """docs with n_words, runs (array of start, length and period, by start, then period)
    and collapsed (the words joined by one space, without those that a run repeats), each
    named with the prefix; columns of these names are replaced.

    A run is a stretch of consecutive words with smallest period p and at least
    max(min_length, exponent * p) words that no neighbour extends; exponent is 2 or more.
    Null and blank texts have no words, no runs and an empty collapsed text. Repeated rows
    give repeated rows; a text of any length is read whole and needs about 400 bytes a
    word; an empty table gives no rows."""
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    ship(docs.sparkSession)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        sizes, many, runs, collapsed = [], [], [], []
        for some in batches(slices(texts), BATCH_BYTES):
            n, r, at, short = _batch(some, min_length, exponent)
            sizes.append(n)
            many.append(r)
            runs.append(at)
            collapsed.append(pa.array(short, pa.binary()))
        give_back()
        one = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        fields = [pa.array(one([r[k] for r in runs])) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(offsets(one(many)).astype(np.int32)), pa.StructArray.from_arrays(fields, RUN.names))
        return pa.StructArray.from_arrays([pa.array(one(sizes)), lists, pa.chunked_array(collapsed, pa.binary()).combine_chunks()], FOUND.names)

    held = fresh(docs, "__runs")
    named = pinned(docs, utf8(F.col(text)), held).withColumn(held, found(F.col(held)))
    return named.withColumns({prefix + "n_words": F.col(f"{held}.n_words"), prefix + "runs": F.col(f"{held}.runs"), prefix + "collapsed": F.col(f"{held}.collapsed").cast("string")}).drop(held)
