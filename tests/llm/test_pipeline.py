import math

import numpy as np
import public_tokenizers
import tokenizers
import xxhash

import corpus_pipeline
from parsefold.llm import packing, quality, simhash, toxicity
from parsefold.llm.common import crc_fold
from tests.conftest import SF
from tests.llm.test_classifiers import plain_word_scores


def test_stages_agree_with_their_operators(spark):
    """Each stage against its operator on the same input, and the last against run()."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "best-fit packing"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == columns and ids(good) == ids(quality.score(docs, labels).where("score >= 0.3"))
    good = spark.createDataFrame(good.collect(), docs.schema)
    clean = corpus_pipeline.drop_toxic(spark, good, SF)
    assert clean.columns == columns and ids(clean) == ids(toxicity.score(good, labels).where("score < 0.5"))
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    single = corpus_pipeline.one_of_each(spark, clean, SF)
    groups = simhash.components(clean).collect()
    assert single.columns == columns and ids(single) == sorted({r.component_id for r in groups}) and len(groups) > single.count()
    lengths = sorted((r.doc_id, r.piece, r.length) for r in packing.pack(single).collect())
    assert lengths == sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect())


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns
            at = spark.createDataFrame(at.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()


M = (1 << 64) - 1


def plain_mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & M
    return x ^ x >> 31


def plain_quality(net, text):
    """Pooling and network, word by word with plain integers."""
    a, b = int(quality._A), int(quality._B)
    words, hashes, triples = text.split(), [], []
    for w in words:
        v = [(ord(c) * b + 1) & M for c in f" {w.decode()} "]
        own = [plain_mix((v[i] + v[i + 1] * a + v[i + 2] * a * a) & M) for i in range(len(v) - 2)]
        hashes.append(plain_mix(sum(plain_mix(t ^ plain_mix(i ^ b)) for i, t in enumerate(own)) & M))
        triples += own
    x, n = np.zeros(quality.WIDTH), len(words)
    if n:
        x[: quality.DIM] = sum(net.table[h % quality.ROWS].astype(float) for h in hashes) / n
        for t in triples:
            x[quality.DIM + t % quality.TRIPLE_DIM] += (1 - 2 * (t >> 30 & 1)) / n
        x[-4], x[-3] = math.log1p(n), len(set(words)) / n
        pairs = list(zip(words, words[1:]))
        x[-2], x[-1] = len(set(pairs)) / max(n - 1, 1), sum(p == q for p, q in pairs) / max(n - 1, 1)
    w, c, v, d = net.layers
    z = float(np.tanh((x - net.mean) / net.scale @ w + c) @ v + d) / net.temperature
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_toxicity(model, text, score):
    """Features of one text from its words' scores, and the logistic curve."""
    s = [score[w] for w in text.lower().split()]
    worst = sorted(s, reverse=True)
    f = [sum(s) / max(len(s), 1)] + [sum(worst[:k]) / k for k in toxicity.WORST]
    f += [max((sum(s[i : i + toxicity.STRETCH]) / toxicity.STRETCH for i in range(len(s))), default=0.0), math.log1p(len(s))]
    z = float((np.array(f) - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_decisions_equal_plain_versions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    net = quality.fit(docs, labels)
    plain = {i: plain_quality(net, t.encode()) for i, t in texts.items()}
    assert all(abs(p - quality.KEEP_AT) > 1e-5 for p in plain.values())
    assert ids(corpus_pipeline.keep_good(spark, docs, SF)) == sorted(i for i, p in plain.items() if p >= quality.KEEP_AT)

    model = toxicity.fit(docs, labels)
    taken = {r.doc_id: r.toxic for r in labels.where(crc_fold(labels.doc_id) != 0).collect()}
    order = sorted(texts)
    words = sorted({w for t in texts.values() for w in t.encode().lower().split()})
    score = dict(zip(words, plain_word_scores([texts[i].encode() for i in order], [taken.get(i) for i in order], words)))
    plain = {i: plain_toxicity(model, t.encode(), score) for i, t in texts.items()}
    assert all(abs(p - corpus_pipeline.TOXIC_AT) > 1e-4 for p in plain.values())
    assert ids(corpus_pipeline.drop_toxic(spark, docs, SF)) == sorted(i for i, p in plain.items() if p < corpus_pipeline.TOXIC_AT)

    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in order}
    changed = True
    while changed:
        changed = False
        for i in order:
            for j in order:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    assert ids(corpus_pipeline.one_of_each(spark, docs, SF)) == sorted(set(least.values()))

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.JSON))
    got, bins = {}, {}
    for r in corpus_pipeline.packed(spark, docs, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        at = sorted(got[i])
        assert at[0][0] == 0 and sum(x for _, x in at) == n and all(s + x == u for (s, x), (u, _) in zip(at, at[1:])) and all(x == 2048 for _, x in at[1:])
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and sum(x for _, x in own) <= 2048 and all(s + x == u for (s, x), (u, _) in zip(own, own[1:]))
