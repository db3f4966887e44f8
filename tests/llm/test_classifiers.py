"""Held-out accuracy, odd rows, and the parts of both classifiers against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parsefold.llm import quality, toxicity
from parsefold.llm.common import Words, crc_fold
from parsefold.llm.labelled import logistic, training_labels
from parsefold.llm.queries import op4_toxicity, op5_quality_classifier

BIG = "/root/testdata/sf0.01"


def held_out(spark, query, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = query(spark, BIG)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").select("held_out", "score", "predicted", column).collect()
    own = [(r.score, r.predicted, r[column]) for r in rows if r.held_out]
    assert len(own) > 50 and all(0 <= s <= 1 for s, _, _ in own)
    s, p, y = (np.array(c) for c in zip(*own))
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    return ((pairs > 0) + 0.5 * (pairs == 0)).mean(), p, y


def test_toxicity_on_held_out_rows(spark):
    area, p, y = held_out(spark, op4_toxicity, "toxic")
    assert area > 0.75 and (p[y == 0] == 0).mean() > 0.95 and (p[y == 1] == 1).mean() > 0.6


def test_quality_on_held_out_rows(spark):
    area, p, y = held_out(spark, op5_quality_classifier, "quality")
    assert area > 0.95 and (p[y == 1] == 1).mean() > 0.97 and (p[y == 0] == 0).mean() > 0.8


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd_docs, no_docs, odd_labels, no_labels, module):
    for labels in (odd_labels, no_labels):
        got = module.score(odd_docs, labels).select("doc_id", "text", "score").collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.text or "", set()).add(round(r.score, 12))
        assert all(len(s) == 1 for s in by.values())  # equal texts score alike, whatever else the row holds
    assert module.score(no_docs, odd_labels).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_do_not_depend_on_partitions(spark, module):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = {r.doc_id: r.score for r in module.score(docs.coalesce(1), labels).collect()}
    many = {r.doc_id: r.score for r in module.score(docs.repartition(7), labels).collect()}
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-6


def test_held_out_and_odd_labels_are_not_sampled(spark, odd_labels):
    rows, share = training_labels(odd_labels, "quality", 100)
    got = {r.doc_id: r.label for r in rows.collect()}
    folds = {r.doc_id: r.f for r in odd_labels.select("doc_id", crc_fold(F.col("doc_id")).alias("f")).collect()}
    assert got and all(folds[i] != 0 for i in got) and None not in got and set(got.values()) == {0, 1}
    assert got.get(5, 0) == 0 and abs(sum(share.values()) - 1) < 1e-9
    assert training_labels(odd_labels, "quality", 1)[0].count() == 2


def plain_word_scores(texts, classes, words):
    """Class-conditional Kneser-Ney over characters with plain dictionaries and every count
    of the corpus: log P(word | toxic) - log P(word | ordinary)."""
    pad = " " * toxicity.TOP
    shown = lambda w: pad + w.decode() + " "
    ends = lambda w: range(len(pad), len(pad) + len(w.decode()) + 1)
    before = {}
    for w in {w for t in texts for w in t.lower().split()}:
        for i in ends(w):
            for n in toxicity.SHARED:
                before.setdefault(shown(w)[i + 1 - n : i + 1], set()).add(shown(w)[i - n])
    top = [{}, {}]
    for t, c in zip(texts, classes):
        for w in t.lower().split() if c is not None else ():
            for i in ends(w):
                g = shown(w)[i + 1 - toxicity.TOP : i + 1]
                top[c][g] = top[c].get(g, 0) + 1

    def by_context(counts):
        own = {}
        for g, n in counts.items():
            own.setdefault((len(g), g[:-1]), []).append(n)
        return counts, own

    def interpolated(tables, g, below):
        counts, contexts = tables
        own = contexts.get((len(g), g[:-1]))
        if not own:
            return below
        return max(counts.get(g, 0) - toxicity.DISCOUNT, 0) / sum(own) + toxicity.DISCOUNT * len(own) / sum(own) * below

    kinds, top = by_context({g: len(b) for g, b in before.items()}), [by_context(t) for t in top]

    def score(w):
        total = 0.0
        for i in ends(w):
            p = toxicity.FLOOR
            for n in toxicity.SHARED:
                p = interpolated(kinds, shown(w)[i + 1 - n : i + 1], p)
            g = shown(w)[i + 1 - toxicity.TOP : i + 1]
            total += np.log(interpolated(top[1], g, p)) - np.log(interpolated(top[0], g, p))
        return total

    return [score(w) for w in words]


def test_word_scores_equal_plain_kneser_ney(spark):
    """Also of words and sequences that no class has seen, and of words of other documents,
    whose characters stand before and after those of the classes."""
    toxic = ["you idiot and clown", "idiots of a clownish kind you", "what an idiot", "clown clown", "éa clown"]
    plain = ["a kind day and an idea", "what a day", "clowns are kind of a show", "an idea of you", "éa day"]
    other = ["idio idea idolish bidiot xidiom clowd", "dayday kindness zclown qdayz unkind", "", None, "Idiotic ideal"]
    rows = [(i, t) for i, t in enumerate(toxic * 4 + plain * 4 + other)]
    labels = [(i, int(i < 20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    taken = {r.doc_id for r in docs.where(crc_fold(F.col("doc_id")) != 0).collect()}
    texts = [(t or "").encode() for _, t in rows]
    classes = [int(i < 20) if i < 40 and i in taken else None for i, _ in rows]
    words = [w.encode() for w in ("idiot", "clown", "day", "idiotically", "bidiot", "kind", "xyz", "éa", "clownx", "dayday", "unheard", "i")]
    want = plain_word_scores(texts, classes, words)
    assert np.allclose(model.scores(Words([b" ".join(words)])), want, atol=1e-5) and max(want) > 1 and min(want) < -1


def test_sequences_of_words_equal_plain_hashes():
    texts = [b"abc de abc", "éx".encode()]
    words = Words(texts)
    assert words.distinct == [b"abc", b"de", "éx".encode()] and words.ids.tolist() == [0, 1, 0, 2]
    found = toxicity.sequences(words, (2, 3, 4))
    assert found.bounds.tolist() == [0, 4, 7, 10]
    same = toxicity.sequences(Words([b"zabc"]), (2, 3, 4))
    assert found.gram[2][2] == same.gram[2][3] and found.gram[2][2] != found.gram[2][1]  # 'bc' in both words
    assert found.context[2][2] == same.context[2][3] and found.gram[3][2] == same.gram[3][3] and found.gram[4][2] != same.gram[4][3]
    assert chr(found.before[2][2]) == "a" and chr(found.last[2]) == "c"


def test_logistic_recovers_a_boundary():
    random = np.random.default_rng(0)
    x = random.normal(size=(4000, 2))
    y = (x @ [2.0, -1.0] + 0.5 + random.logistic(size=4000) > 0).astype(float)
    w = logistic(x, y, np.ones(4000), ridge=1e-6)
    assert np.allclose(w, [2, -1, 0.5], atol=0.25)


def test_context_vectors_count_neighbours_once():
    words = Words([b"a b c", b"c a"])
    hashes = quality.word_hashes(words)[0]
    total = quality.neighbours(words, hashes)
    signs = lambda h: {(int(h >> np.uint64(s)) % quality.DIM, 1 - 2 * (int(h >> np.uint64(s + 10)) & 1)) for s in (20, 40)}
    row = {w: int(h) % quality.ROWS for w, h in zip(words.distinct, hashes)}
    want = np.zeros_like(total)
    for one, other in ((b"a", b"b"), (b"b", b"a"), (b"b", b"c"), (b"c", b"b"), (b"c", b"a"), (b"a", b"c")):
        h = hashes[words.distinct.index(other)]
        for s in (20, 40):
            want[row[one], int(h >> np.uint64(s)) % quality.DIM] += 1 - 2 * (int(h >> np.uint64(s + 10)) & 1)
    assert np.array_equal(total, want) and signs(hashes[0])


def test_pooled_rows_do_not_depend_on_the_batch():
    table = np.random.default_rng(1).normal(size=(quality.ROWS, quality.DIM)).astype(np.float32)
    texts = [b"", b"one two one two one", b"  ", b"x", "é ü é".encode(), b"a a a a"]
    both = quality.pooled(texts, table)
    for i, t in enumerate(texts):
        assert np.allclose(both[i], quality.pooled([t], table)[0], atol=1e-6)
    assert np.allclose(both[1, -3:], [2 / 5, 2 / 4, 0]) and np.allclose(both[5, -3:], [1 / 4, 1 / 3, 1])


def test_continuations_are_counted_over_all_documents(spark):
    """More distinct sequences than 2^19, and more than 64 characters before one."""
    random = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(r) for r in letters[random.integers(26, size=(4000, 8))]) for _ in range(100)]
    texts.append(" ".join(chr(0x4E00 + i) + "qj" for i in range(300)))
    docs = spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "doc_id long, text binary")
    words = toxicity.count_words(docs, np.array([0, 100]), np.array([0, 1]), np.array([0, 0]))
    upper, lower = toxicity.learned_top(words), toxicity.learned_lengths(words)
    learned = {w for t in (texts[0], texts[100]) for w in t.split()}
    n = 6
    last = lambda w: [(" " * 8 + w + " ")[i - n + 1 : i + 2] for i in range(7, 8 + len(w))]  # noqa: E731  one before, then the sequence
    given = {s[1:] for w in learned for s in last(w)}
    before, around = {}, {}
    for w in {w for t in texts for w in t.split()}:
        for s in last(w):
            before.setdefault(s[1:], set()).add(s[0])
            around.setdefault(s[1:-1], set()).add((s[0], s[-1]))
    assert len(before) > 1 << 19
    which, key, context = (lower.column(c).to_numpy() for c in ("k", "key", "context"))
    key, context = np.sort(key.view(np.uint64)), np.unique(context.view(np.uint64))
    often, mass, kinds = toxicity.continuations(words, key, context)
    own = np.isin(key, lower.column("key").to_numpy().view(np.uint64)[which == 4])
    assert sorted(often[own]) == sorted(len(before[g]) for g in given) and often.max() >= 300
    own = np.isin(context, lower.column("context").to_numpy().view(np.uint64)[which == 4])
    contexts = {g[:-1] for g in given}
    assert sorted(mass[own]) == sorted(len(around[h]) for h in contexts)
    assert sorted(kinds[own]) == sorted(len({x for _, x in around[h]}) for h in contexts)
    trained = [texts[g].split() for g in (0, 100)]
    assert [sum(upper.column(c).to_pylist()) for c in ("c0", "c2")] == [sum(len(w) + 1 for w in t) for t in trained]


def test_index_finds_every_key_and_no_other():
    keys = np.unique(toxicity.mix(np.arange(5000, dtype=np.uint64)))
    index = toxicity.Index(keys)
    assert np.array_equal(index.find(keys), np.arange(len(keys)))
    assert (index.find(np.append(keys[:-1] + np.uint64(1), np.uint64((1 << 64) - 1))) == len(keys)).all()
    assert (toxicity.Index(keys[:0]).find(keys) == 0).all()
