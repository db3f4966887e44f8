"""Toxicity by class-conditional Kneser-Ney models over characters of words.

Each class (toxic, ordinary) has a top-order model of its own, interpolated with lower
orders that both share: continuation counts (in how many distinct contexts a sequence
stands) of the words of ALL documents, so that an expression rare or unseen in either
class backs off to the same numbers in both. A word's score is the difference of its
two log-likelihoods; a document is described by length-normalised differences, over
the whole text and over its most toxic stretches, and a logistic curve fitted on
held-back halves of the training rows turns them into a probability.

Continuation counts depend on the distinct words alone: these are gathered first, in a
table that grows as the corpus does, with their frequencies in training rows, and
sequences are counted from them. A sequence is named by a hash of 64 bits and counts are
exact. A sequence of the top length that neither class has seen has the same shared
probability in both, which cancels in the difference; so scoring needs one number for
each sequence, and for each context, of the bounded sample of training rows, and the
counts of all other sequences never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsefold.llm.common import batches, clean, give_back, mix, offsets, segment_max, segment_sum, ship, slices, table, utf8, Words
from parsefold.llm.labelled import logistic, standardise, training_labels

#: Lengths of the sequences: those that both classes share, then each class's own.
SHARED, TOP = (1, 2, 3, 4, 6), 9
DISCOUNT = 0.75
#: Labelled training rows of each class, at most.
PER_CLASS = 12_000
#: A text is described by its mean, by its worst words (the mean of so many) and by its
#: worst stretch of so many words.
WORST, STRETCH = (1, 2, 3, 5), 8
#: Words of at most SHORT bytes a worker remembers (their scores, or that they were sent)
#: before it starts anew.
REMEMBERED, SHORT = 1 << 16, 64
#: Bytes of words whose sequences are made at once, and surroundings of each length that a
#: task remembers having sent.
AT_ONCE, SEEN = 1 << 17, 1 << 20
#: Probability that stands below the shortest sequences.
FLOOR = 1e-5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = [np.uint64((0xD1B54A32D192ED03 * (n + 1)) % (1 << 64)) for n in range(TOP + 1)]


@dataclass
class Sequences:
    """The sequences that end at each character of each distinct word (a word is preceded
    by spaces and ends with one), by length."""

    gram: dict[int, np.ndarray]  # the key of a sequence
    context: dict[int, np.ndarray]  # the key of a sequence without its last character
    before: dict[int, np.ndarray]  # the code point before it
    last: np.ndarray  # its last code point
    bounds: np.ndarray  # of words among these characters


def sequences(words: Words, lengths: tuple[int, ...]) -> Sequences:
    points, bounds = words.characters()
    n, sizes = len(words.distinct), np.diff(bounds)
    pad = TOP - 1  # one space is there already
    new = offsets(sizes + pad)
    padded = np.full(new[-1], 32, np.uint64)
    padded[np.arange(len(points)) + np.repeat((np.arange(n) + 1) * pad, sizes)] = points
    real = np.ones(new[-1], bool)
    for k in range(pad + 1):
        real[new[:-1] + k] = False
    at = np.flatnonzero(real)
    value = padded * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    h, power = np.zeros(len(at), np.uint64), 1
    past = np.zeros(len(at), np.uint64)  # the same sequence without its last character
    out = Sequences({}, {}, {}, padded[at], offsets(sizes - 1))
    for k in range(max(lengths)):
        term = value[at - k] * np.uint64(power)
        h = h + term
        if k:
            past = past + term
        power = power * int(_BASE) % (1 << 64)
        if k + 1 in lengths:
            out.gram[k + 1], out.context[k + 1] = mix(h ^ _SALT[k]), mix(past ^ _SALT[k])
            out.before[k + 1] = padded[at - min(k + 1, TOP)]
    return out


def top_sequences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = sequences(words, (TOP,))
    return found.gram[TOP], found.context[TOP], found.bounds


class Index:
    """Places of keys in a sorted array of them; len(keys) for a key that is not there."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length() - 1)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        n = len(self.keys)
        if not n:
            return np.zeros(len(wanted), np.int64)
        place = self.starts[wanted >> self.shift].astype(np.int64)
        open_ = np.flatnonzero(place < n)
        while len(open_):
            open_ = open_[self.keys[place[open_]] < wanted[open_]]
            place[open_] += 1
            open_ = open_[place[open_] < n]
        found = place < n
        found[found] = self.keys[place[found]] == wanted[found]
        place[~found] = n
        return place


@dataclass
class Model:
    """What each counted sequence of the top length adds to a word's score, and what a
    counted context adds where a sequence was not counted; nothing is added elsewhere."""

    gram: Index
    delta: np.ndarray
    context: Index
    rest: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) for each distinct word."""
        known = self.__dict__.setdefault("known", {})
        new = [w for w in words.distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words.distinct
        now = dict(zip(new, self.scores(Words([b" ".join(new)])).tolist())) if new else {}
        known.update((w, x) for w, x in now.items() if len(w) <= SHORT)
        return np.fromiter((now[w] if w in now else known[w] for w in words.distinct), np.float64, len(words.distinct))

    def scores(self, words: Words) -> np.ndarray:
        gram, context, bounds = top_sequences(words)
        at = self.gram.find(gram)
        out = self.delta[at].astype(np.float64)
        rare = np.flatnonzero(at == len(self.gram.keys))
        out[rare] = self.rest[self.context.find(context[rare])]
        return np.add.reduceat(out, bounds[:-1])

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text: the mean difference over all words, over its worst words and over
        its worst stretch, and the log of the number of words."""
        words = Words([t.lower() for t in texts])
        n = np.diff(words.bounds)
        scores = self.word_scores(words)[words.ids] if len(words.ids) else np.zeros(0)
        total = np.zeros(len(scores) + 1)
        np.cumsum(scores, out=total[1:])
        columns = [segment_sum(scores, words.bounds) / np.maximum(n, 1)]
        doc = np.repeat(np.arange(len(n)), n)
        ranked = np.append(scores[np.lexsort((-scores, doc))], 0.0)
        kth = [np.where(n > k, ranked[np.minimum(words.bounds[:-1] + k, len(ranked) - 1)], 0.0) for k in range(max(WORST))]
        columns += [sum(kth[:k]) / k for k in WORST]  # absent words count as neutral
        end = np.minimum(np.arange(len(scores)) + STRETCH, np.repeat(words.bounds[1:], n))
        columns.append(segment_max((total[end] - total[:-1]) / STRETCH, words.bounds, 0.0))
        columns.append(np.log1p(n))
        return np.column_stack(columns)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def count_words(docs: DataFrame, ids: np.ndarray, labels: np.ndarray, halves: np.ndarray) -> DataFrame:
    """word, c0..c3: the distinct words of all docs, and how often each stands in the four
    sets of training rows (label, half)."""
    order = np.argsort(ids)
    known = docs.sparkSession.sparkContext.broadcast((ids[order], (labels * 2 + halves)[order]))

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled, group = known.value
        sent: set[bytes] = set()
        for part in parts:
            got = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            groups = np.full(len(got), -1)
            if len(sampled):
                where = np.minimum(np.searchsorted(sampled, got), len(sampled) - 1)
                there = (sampled[where] == got) & part.column(0).is_valid().to_numpy(zero_copy_only=False)
                groups[there] = group[where[there]]
            first = 0
            for texts in batches(slices(part.column(1))):
                own = groups[first : first + len(texts)]
                first += len(texts)
                words = Words([t.lower() for t in texts])
                if not words.distinct:
                    continue
                token = np.repeat(own, np.diff(words.bounds))
                often = np.stack([np.bincount(words.ids[token == g], minlength=len(words.distinct)) for g in range(4)])
                if len(sent) > REMEMBERED:
                    sent.clear()
                more = [i for i, (w, c) in enumerate(zip(words.distinct, often.any(axis=0).tolist())) if c or w not in sent]
                sent.update(w for w in words.distinct if len(w) <= SHORT)
                if more:
                    yield pa.record_batch([pa.array([words.distinct[i] for i in more], pa.binary()), *[pa.array(often[g][more]) for g in range(4)]], names=["word", "c0", "c1", "c2", "c3"])

    found = docs.mapInArrow(counted, "word binary, c0 long, c1 long, c2 long, c3 long")
    out = table(found.groupBy("word").agg(*[F.sum(f"c{g}").alias(f"c{g}") for g in range(4)]), "words")
    known.destroy()
    return out


def learned_lengths(words: DataFrame) -> pa.Table:
    """(k, key, context, shorter) of each sequence of the shared lengths in words of training
    rows; `shorter` is the key of the next shorter sequence with the same end. They are a
    bounded sample's words, so the number of rows is bounded."""

    def shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = sequences(Words([b" ".join(part.column(0).to_pylist())]), SHARED) if len(part) else None
            for k, n in enumerate(SHARED if found else ()):
                key, first = np.unique(found.gram[n], return_index=True)
                shorter = found.gram[SHARED[k - 1]][first] if k else np.zeros(len(first), np.uint64)
                columns = (key, found.context[n][first], shorter)
                yield pa.record_batch([pa.array(np.full(len(first), k, np.int32)), *(pa.array(x.view(np.int64)) for x in columns)], names=["k", "key", "context", "shorter"])

    learned = words.where("c0 + c1 + c2 + c3 > 0").select("word")
    return learned.mapInArrow(shared, "k int, key long, context long, shorter long").distinct().toArrow()


def learned_top(words: DataFrame) -> pa.Table:
    """(key, context, shorter, c0..c3) of the top length, with frequencies in the four sets;
    bounded likewise."""
    longest = SHARED[-1]

    def top(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if len(part):
                found = sequences(Words([b" ".join(part.column(0).to_pylist())]), (longest, TOP))
                often = [np.repeat(part.column(1 + g).to_numpy(), np.diff(found.bounds)) for g in range(4)]
                keys = (found.gram[TOP], found.context[TOP], found.gram[longest])
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in keys] + [pa.array(c) for c in often], names=["key", "context", "shorter", "c0", "c1", "c2", "c3"])

    sets = [f"c{g}" for g in range(4)]
    upper = words.where("c0 + c1 + c2 + c3 > 0").mapInArrow(top, "key long, context long, shorter long, c0 long, c1 long, c2 long, c3 long")
    return upper.groupBy("key", "context", "shorter").agg(*[F.sum(c).cast("int").alias(c) for c in sets]).toArrow()


def continuations(words: DataFrame, grams: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the distinct words of ALL documents: in how many different surroundings each of
    the given sequences stands (distinct characters before it), the same summed over all
    sequences of each of the given contexts, and how many such sequences there are. Every
    sequence of a given context is counted, given or not. Keys are sorted."""
    spark = words.sparkSession
    given = spark.sparkContext.broadcast((Index(grams), Index(contexts)))

    def emitted(some: list[bytes], seen: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, context = given.value
        found = sequences(Words([b" ".join(some)]), SHARED)
        for n in SHARED:
            # Equal surroundings of a sequence count once; what was sent needn't travel twice.
            around, once = np.unique(mix(found.gram[n] + found.before[n] * _BASE), return_index=True)
            if len(seen[n]):
                old = seen[n][np.minimum(np.searchsorted(seen[n], around), len(seen[n]) - 1)] == around
                around, once = around[~old], once[~old]
            if len(seen[n]) + len(around) <= SEEN:
                seen[n] = np.sort(np.concatenate([seen[n], around]), kind="stable")
            h = context.find(found.context[n][once])
            there = np.flatnonzero(h < len(contexts))
            once, h = once[there], h[there]
            g = gram.find(found.gram[n][once])
            before = found.before[n][once].astype(np.int64)
            other = -1 - (found.last[once].astype(np.int64) << 21 | before)
            yield pa.record_batch([pa.array(h.astype(np.int32)), pa.array(np.where(g < len(grams), g << 21 | before, other))], names=["h", "z"])

    def around(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        seen = {n: np.zeros(0, np.uint64) for n in SHARED}
        size = 0
        for part in parts:
            for some in slices(part.column(0), 4096):
                held += some
                size += sum(map(len, some))
                if size >= AT_ONCE:
                    yield from emitted(held, seen)
                    held, size = [], 0
        if held:
            yield from emitted(held, seen)
        give_back()

    # Dealt by context and sequence: the shortest context, which every word has, is shared out
    # by its sequences, and both aggregates find their rows together.
    pairs = words.select("word").mapInArrow(around, "h int, z long").withColumn("g", F.shiftright("z", 21)).repartition("h", "g").distinct()
    sequence = pairs.groupBy("h", "g").agg(F.count("*").alias("n"))
    got = sequence.groupBy("h", F.greatest("g", F.lit(-1).cast("long")).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    given.destroy()
    h, g, n, kinds = (got.column(c).to_numpy() for c in ("h", "g", "n", "kinds"))
    often = np.zeros(len(grams))
    often[g[g >= 0]] = n[g >= 0]
    return often, np.bincount(h, n, len(contexts)), np.bincount(h, kinds, len(contexts))


def shares(often: np.ndarray, of: np.ndarray, mass: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of sequences in their contexts `of`, and what each context leaves
    to shorter ones (all, if nothing was counted there)."""
    full = np.maximum(mass, 1)
    return np.maximum(often - DISCOUNT, 0) / full[of], np.where(mass > 0, DISCOUNT * kinds / full, 1.0)


def shared_probabilities(words: DataFrame) -> tuple[Index, np.ndarray]:
    """The interpolated probability of each sequence of the longest shared length."""
    lower = learned_lengths(words)
    order = np.argsort(_keys(lower, "key"))
    key, which = _keys(lower, "key")[order], lower.column("k").to_numpy().astype(np.int8)[order]
    contexts, of = np.unique(_keys(lower, "context")[order], return_inverse=True)
    every, of = Index(key), of.astype(np.int32)
    shorter = every.find(_keys(lower, "shorter")[order]).astype(np.int32)
    del lower, order
    give_back()
    often, mass, kinds = continuations(words, key, contexts)
    add, keep = shares(often, of, mass, kinds)
    p = np.full(len(key), FLOOR)
    for k in range(len(SHARED)):
        own = np.flatnonzero(which == k)
        p[own] = add[own] + keep[of[own]] * (p[shorter[own]] if k else FLOOR)
    own = np.flatnonzero(which == len(SHARED) - 1)
    return Index(key[own]), p[own]


def _keys(found: pa.Table, name: str) -> np.ndarray:
    return found.column(name).to_numpy().view(np.uint64)


def differences(often: list[np.ndarray], of: np.ndarray, contexts: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From frequencies by class: the log ratio of both classes' probabilities of each
    sequence, and, by context, of every sequence that neither has seen: whatever its
    shared probability, it cancels. The last entries, zero, are for what is not there."""
    ends, left = np.zeros(len(of) + 1, np.float32), np.zeros(contexts + 1, np.float32)
    for c, sign in zip(often, (-1, 1)):
        mass = np.bincount(of, c, contexts)
        kinds = np.bincount(of[c > 0], minlength=contexts)
        left[:-1] += sign * np.log(np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0))
        for low in range(0, len(of), 1 << 18):  # in parts, for the driver's memory
            some = slice(low, min(low + (1 << 18), len(of)))
            add, keep = shares(c[some], of[some], mass, kinds)
            ends[some] += sign * np.log(add + keep[of[some]] * p[some])
    return ends, left


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learn from docs and from labels(doc_id, toxic), of which at most `per_class` rows
    of each class outside the held-out fold are used.

    Null texts count as empty; a text's length has no bound. Repeated rows count once in
    what documents share and each in their class; rows without id are in no class. Without
    a row of either class (an empty table, too) every score is the share of toxic rows (0
    if none). Other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(F.col(text)).alias("text"))
    sampled, share = training_labels(labels, "toxic", per_class)
    chosen = sampled.toArrow()  # at most 2 * per_class rows
    ids, y = (chosen.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    halves = (mix(ids.view(np.uint64) if len(ids) else np.zeros(0, np.uint64)) & np.uint64(1)).astype(np.int64)
    words = count_words(rows, ids, y, halves)
    clean(docs.sparkSession)
    place, known = shared_probabilities(words)
    give_back()
    clean(docs.sparkSession)
    upper = learned_top(words)
    order = np.argsort(_keys(upper, "key"))
    key = _keys(upper, "key")[order]
    contexts, of = np.unique(_keys(upper, "context")[order], return_inverse=True)
    of = of.astype(np.int32)
    p = known[place.find(_keys(upper, "shorter")[order])].astype(np.float32)
    c = [upper.column(f"c{g}").to_numpy()[order] for g in range(4)]
    del upper, order, known, place
    give_back()
    clean(docs.sparkSession)
    by_set = lambda ordinary, toxic: differences([sum(c[g] for g in s) for s in (ordinary, toxic)], of, len(contexts), p)
    half = [by_set((1 - k,), (3 - k,)) for k in (0, 1)]  # learned from the other half
    gram, context = Index(key), Index(contexts)
    delta, rest = by_set((0, 1), (2, 3))
    del c, of, p, key
    give_back()
    one = (np.zeros(1), np.zeros(1), np.ones(1))
    model = Model(gram, delta, context, rest, *one)
    shared = docs.sparkSession.sparkContext.broadcast((gram, context, half))
    label_of = dict(zip(ids.tolist(), zip(y.tolist(), halves.tolist())))

    def described(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, context, half = shared.value
        models = [Model(gram, delta, context, rest, *one) for delta, rest in half]
        for part in parts:
            first, got = 0, part.column(0).to_pylist()
            for texts in batches(slices(part.column(1))):
                own = [label_of[i] for i in got[first : first + len(texts)]]
                first += len(texts)
                for k in (0, 1):
                    mine = [i for i, (_, h) in enumerate(own) if h == k]
                    if mine:
                        f = models[k].features([texts[i] for i in mine])
                        yield pa.record_batch([pa.array([own[i][0] for i in mine], pa.int32()), pa.array(list(f), pa.list_(pa.float64()))], names=["label", "f"])

    train = rows.join(F.broadcast(sampled.select("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    got = train.mapInArrow(described, "label int, f array<double>").toArrow()
    shared.destroy()
    x = np.array(got.column("f").to_pylist(), dtype=np.float64).reshape(len(got), len(WORST) + 3)
    t = got.column("label").to_numpy().astype(np.float64)
    if not 0 < t.sum() < len(t):
        model.weights, model.mean, model.scale = np.append(np.zeros(x.shape[1]), -30.0 if share[1] == 0 else np.log(share[1] / max(share[0], 1e-12))), np.zeros(x.shape[1]), np.ones(x.shape[1])
        return model
    model.mean, model.scale = standardise(x)
    weight = np.where(t == 1, share[1] / t.mean(), share[0] / (1 - t.mean()))
    model.weights = logistic((x - model.mean) / model.scale, t, weight)
    return model


def scorer(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column of probabilities; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        out = [shared.value.probability(shared.value.features(some)) for some in batches(slices(texts))]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scored, T.DoubleType())(utf8(F.col(text)))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "score", per_class: int = PER_CLASS) -> DataFrame:
    """docs with a toxicity probability in column `out` (replaced if it is there), for every
    row: also for null, empty and repeated texts and rows without id, whose scores depend
    on the text alone. An empty table gives no rows."""
    return docs.withColumn(out, scorer(docs, fit(docs, labels, doc_id, text, per_class), text))
