"""Packing, token counts, sampled segmentations and quality rules."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from parsefold.llm import packing, rules, segmenting, tokencount
from parsefold.llm.queries import OP8_SQL, op7_sentencepiece_sampling, op8_quality_rules, op9_best_fit_packing, op10_token_counts
from parsefold.llm.tokenizing import byte_bpe
from tests.conftest import SF
from tests.test_queries import compare

ODD = ["", " ", "  ", "\n", " \n", "a", " a", "a ", "a\n\nb", "x  y", "foo\tbar baz", "l'été n't 's", "<|endoftext|> hi", "a <|endoftext|>b", "\xa0nbsp\xa0x y", "emoji 😀 x\ny", "123 45.6 a1b2", "\r\nq r", "a\x1fb c", "<s></s><unk><0x0A>", "a\x00b", " " * 300 + "a", "x" * 3000, "▁a▁▁b", "a \n b", "\n\n  a"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe(public_tokenizers.path(packing.JSON), public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)


def noise(n):
    random.seed(n)
    return ["".join(random.choice("ab the▁ \n\t  éß中😀xyz<s>'.,1") for _ in range(random.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library(bpe, duck):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.JSON))
    for t in ODD + noise(1500) + [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]:
        assert np.frombuffer(bpe.ids(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_counts_equal_the_library(duck):
    model, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL)), tokencount.merger(public_tokenizers.path(tokencount.MODEL))
    for t in ODD + noise(3000) + [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]:
        assert own.count(t) == len(model.encode(t)), t


def test_count_query(spark, duck):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op10_token_counts(spark, SF).collect()}
    want = {i: (len(t.encode()), len(model.encode(t))) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert got == {i: (b, n, n > 4096) for i, (b, n) in want.items()}


def test_counts_of_odd_rows(spark, odd_docs, no_docs):
    got = tokencount.with_token_counts(odd_docs)
    assert got.count() == odd_docs.count() and all((r.n_tokens == 0) == (not r.text) for r in got.collect())
    assert tokencount.with_token_counts(no_docs).count() == 0


def check_packing(rows, texts, bpe):
    """texts: (doc_id, text) in any order; equal ids only with equal texts."""
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        ids = bpe.ids(text or "") + b"\0\0\0\0"
        own = {(r.piece, r.start, r.length, r.ids_crc32) for r in by[doc_id]}
        assert own == {(p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(packing.cuts(len(ids) // 4))}
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= packing.CAPACITY
    return len(bins), -(-sum(r.length for r in rows) // packing.CAPACITY)


def test_packing_query(spark, duck, bpe):
    bins, least = check_packing(op9_best_fit_packing(spark, SF).collect(), duck.execute("SELECT doc_id, text FROM documents").fetchall(), bpe)
    assert bins <= least + 2


def test_packing_in_small_blocks(spark, odd_docs, no_docs, bpe):
    got = packing.pack(odd_docs, block=4).collect()
    check_packing(got, [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").collect()], bpe)
    assert sum(r.piece == 0 for r in got) == odd_docs.count()
    assert packing.pack(no_docs).count() == 0
    kept = packing.pack(odd_docs, keep_ids=True).where("doc_id = 5").first()
    assert bytes(kept.ids) == bpe.ids("a b c d e f g") + b"\0\0\0\0"


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)] and packing.cuts(2049) == [(0, 1), (1, 2048)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]


def test_local_search_empties_bins():
    sizes = np.array([6, 3, 3, 5, 4, 5, 4])  # first two bins hold 6+3 and 5+4; the rest can be shared out
    bins = packing.local_search([[0, 1], [2, 4], [3, 6], [5]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and all(sizes[b].sum() <= 10 for b in bins)
    assert len(bins) == 3
    # one-for-two: 7 goes where 3 and 3 stood
    bins = packing.local_search([[0], [1, 2, 3], [4]], np.array([7, 3, 3, 3, 4]), 10)
    assert len(bins) == 2


@pytest.mark.parametrize("seed", range(5))
def test_packing_never_loses_to_best_fit(seed):
    sizes = np.random.default_rng(seed).integers(1, 900, 300)
    where, offset, fill = packing.pack_block(sizes, 1000)
    assert where.max() + 1 <= len(packing.best_fit(sizes, 1000)) and fill.max() <= 1000
    for b in range(where.max() + 1):
        own = np.flatnonzero(where == b)
        order = own[np.argsort(offset[own])]
        assert offset[order].tolist() == np.cumsum(np.append(0, sizes[order]))[:-1].tolist()


# ---------------------------------------------------------------- sampled segmentations


@pytest.fixture(scope="module")
def vocabulary():
    return segmenting.vocabulary(public_tokenizers.path(tokencount.MODEL), 1.0)


def every_segmentation(v, text):
    known = {p: v.score[i] for i, p in enumerate(v.pieces) if np.isfinite(v.score[i])}

    def of(part):
        if not part:
            yield (), 0.0
        for n in range(1, len(part) + 1):
            if part[:n] in known or n == 1:
                for rest, w in of(part[n:]):
                    yield (part[:n], *rest), w + known.get(part[:n], segmenting._FALLBACK)

    found = {}
    for some in itertools.product(*[list(of(p)) for p in segmenting.parts_of(text)]):
        found[sum((s[0] for s in some), ())] = sum(s[1] for s in some)
    total = np.logaddexp.reduce(list(found.values()))
    return {k: math.exp(w - total) for k, w in found.items()}


def test_samples_follow_the_exact_distribution(vocabulary):
    text, n = "that one", 20_000
    chance = every_segmentation(vocabulary, text)
    got = segmenting.sample(vocabulary, np.arange(n), [text] * n, 3)
    names = lambda ids: tuple(vocabulary.pieces[i] for i in ids)
    first, second = {}, {}
    for r in got:
        p = [names(x[3]) for x in r]
        assert len(set(p)) == 3 and r[0][1] > r[1][1] > r[2][1]
        assert all(abs(x[0] - math.log(chance[q])) < 1e-6 for x, q in zip(r, p))
        first[p[0]] = first.get(p[0], 0) + 1
        second[p[1]] = second.get(p[1], 0) + 1
    for p in sorted(chance, key=chance.get)[-6:]:
        want = sum(chance[q] * chance[p] / (1 - chance[q]) for q in chance if q != p)
        assert abs(first.get(p, 0) / n - chance[p]) < 0.012 and abs(second.get(p, 0) / n - want) < 0.015
    assert abs(np.mean([sum(math.exp(x[0]) / x[2] for x in r) for r in got]) - 1) < 0.02


def test_few_segmentations_are_all_given(vocabulary):
    chance = every_segmentation(vocabulary, "é")
    (got,) = segmenting.sample(vocabulary, np.array([1]), ["é"], 9)
    assert len(got) == len(chance) and all(x[2] == 1 for x in got)


def test_samples_decode_and_do_not_depend_on_the_batch(vocabulary, duck):
    texts = ODD + [r[0] for r in duck.execute("SELECT text FROM documents LIMIT 60").fetchall()]
    keys = np.arange(len(texts))
    together = segmenting.sample(vocabulary, keys, texts, 3)
    for k, (t, some) in enumerate(zip(texts, together)):
        assert all(segmenting.decode(vocabulary, x[3]) == t.replace("▁", " ") for x in some)
        assert len({x[3].tobytes() for x in some}) == len(some)
        (alone,) = segmenting.sample(vocabulary, keys[k : k + 1], [t], 3)
        assert [(x[1], x[3].tolist()) for x in alone] == [(x[1], x[3].tolist()) for x in some]


def test_segment_query_and_odd_rows(spark, odd_docs, no_docs):
    got = op7_sentencepiece_sampling(spark, SF)
    assert got.where("NOT round_trip").count() == 0 and got.where("sample = 1").count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    odd = segmenting.segment(odd_docs, samples=2)
    assert odd.where("sample = 1").count() == odd_docs.count() and odd.where("NOT round_trip").count() == 0
    assert segmenting.segment(no_docs).count() == 0


# ---------------------------------------------------------------- rules


def test_rules_query_equals_sql(spark, duck, tmp_path):
    assert compare(spark, duck, op8_quality_rules, OP8_SQL, tmp_path) > 10


def plain_repeats(text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len(w), len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)})


def test_measures_of_odd_rows(spark, odd_docs, no_docs):
    random.seed(1)
    more = [" ".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(200)]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    for r in rules.with_measures(docs).collect():
        n, again = plain_repeats(r.text or "")
        assert (r.n_words, r.n_repeat_words) == (n, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n)
    assert rules.with_measures(no_docs).count() == 0


def test_lines_and_symbols(spark):
    df = spark.createDataFrame([("a\nb\na\n \n \na #$\n", 1)], "text string, n_words int")
    r = rules.with_measures(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (5, 6, 2, 1)


def test_order_of_rules_never_changes_the_verdict(spark, odd_docs, no_docs):
    want = None
    for order in itertools.permutations(rules.RULES):
        got = [r.v for r in odd_docs.select(rules.cascade(list(order), F.col("text")).alias("v")).collect()]
        want = got if want is None else want
        assert got == want
    assert [r.name for r in rules.ordered([(rules.Rule("dear", None), 4.0, 0.5), (rules.Rule("cheap", None), 1.0, 0.3), (rules.Rule("idle", None), 1.0, 0.0)])] == ["cheap", "dear", "idle"]
    assert rules.apply_rules(odd_docs).count() == odd_docs.count() and rules.apply_rules(no_docs).count() == 0


def test_byte_bpe_remembers_no_words():
    from parsefold.llm import packing, tokenizing

    bpe = tokenizing.ByteBpe(public_tokenizers.path(packing.JSON), public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)
    for text in ("", " ", "kelp and\nmoss", "  a\t b \n\n c", "é ü　x", "x" * 3000):
        assert bpe.ids(text) == np.array(bpe.slow.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
    assert not any(isinstance(x, dict) for x in vars(bpe).values())
