"""How far sources of a language differ in their words, by joint count histograms.

1. Tasks count terms by (lang, source) in bounded dictionaries, so that what is shuffled
   is a row for each distinct term of a task, however hot a source or a term is.
2. A row for each kept term holds its count in every source that has it. Tasks lay such
   rows out as blocks and tally, for each pair of sources, how many terms have each
   (count, count) combination: never a row for a term and a pair.
3. Zero cells are implied: what a source's own histogram of counts holds beyond the joint
   one stands beside a count of zero. The difference of shares is evaluated once for each
   combination and taken as often as it occurs. All arithmetic is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsefold.llm.common import give_back, ship, table, utf8

LEAST_DOCUMENTS, TOP = 30, 50
ONE, PRIOR = 1_000_000_000, 5
#: Entries of a task's dictionaries before they are handed on; bytes of a text counted at
#: once; cells of a block of terms and sources.
ENTRIES, BLOCK_BYTES, CELLS = 1 << 17, 1 << 20, 1 << 21

# What is no term: ASCII but for letters; capitals become small ones.
_BARE = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in blocks: runs of letters and of all beyond ASCII, A-Z made
    small."""
    bare, at = text.translate(_BARE), 0
    while at < len(bare):
        end = at + BLOCK_BYTES
        if end < len(bare):
            end = bare.find(b" ", end)
            end = len(bare) if end < 0 else end
        yield bare[at:end].split()
        at = end


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def handed_on() -> pa.RecordBatch:
        rows = [(*group, t, c, documents[t]) for group, (counts, documents) in found.items() for t, c in counts.items()]
        lang, source, term, n, d = zip(*rows)
        found.clear()
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "documents"])

    for part in parts:
        langs, sources = part.column(0).to_pylist(), part.column(1).to_pylist()
        for lang, source, raw in zip(langs, sources, part.column(2)):
            counts, documents = found.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(counts), set()
            for block in terms(raw.as_buffer().to_pybytes()):
                counts.update(block)
                seen.update(block)
            documents.update(seen)
            held += len(counts) - before
            if held >= ENTRIES:
                yield handed_on()
                held = 0
    if held:
        yield handed_on()
    give_back()


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n, by): the terms in at least `least` documents of a language, their
    count there, and `by`, an array of (source, n) of the sources that have it."""
    ship(docs.sparkSession)
    rows = docs.select(_named(lang, "lang"), _named(source, "source"), utf8(F.col(text)).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, documents long")
    counts = counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("by"))
    return whole.where(F.col("documents") >= least).drop("documents")


def _named(column: str, name: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(name)


def _tallied(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, ca, cb, m): in how many terms source a has count ca and b, which comes
    after it, cb, none of them zero."""
    for part in parts:
        langs, lists = part.column(0).dictionary_encode(), part.column(1)
        sizes, cells = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
        row = np.repeat(np.arange(len(lists)), sizes)
        of, counts = langs.indices.to_numpy(zero_copy_only=False)[row], cells.field(1).to_numpy(zero_copy_only=False)
        names = cells.field(0).dictionary_encode()
        order = np.argsort(np.array([s.encode() for s in names.dictionary.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        source, ordered = place[names.indices.to_numpy(zero_copy_only=False)], names.dictionary.take(pa.array(order))
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(of == code)
            some, column = np.unique(source[own], return_inverse=True)
            terms_, line = np.unique(row[own], return_inverse=True)
            values, number = np.unique(counts[own], return_inverse=True)
            step = max(1, CELLS // len(some))
            for first in range(0, len(terms_), step):
                here = (line >= first) & (line < first + step)
                block = np.full((len(some), min(step, len(terms_) - first)), -1, np.int64)
                block[column[here], line[here] - first] = number[here]
                yield from _pairs(block, lang, ordered.take(pa.array(some)), values)
    give_back()


def _pairs(block: np.ndarray, lang: str, names: pa.Array, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Combinations of each line of a block with all lines below it."""
    k, there = len(values), block >= 0
    for a in range(len(block) - 1):
        at = np.flatnonzero(there[a])
        b, column = np.nonzero(there[a + 1 :][:, at])
        combos, m = np.unique((b * k + block[a][at[column]]) * k + block[a + 1 + b, at[column]], return_counts=True)
        if len(combos):
            other, ca, cb = combos // (k * k), combos // k % k, combos % k
            yield pa.record_batch(
                [pa.array([lang] * len(combos), pa.string()), names.take(pa.array(np.full(len(combos), a))), names.take(pa.array(a + 1 + other)), pa.array(values[ca]), pa.array(values[cb]), pa.array(m.astype(np.int64))],
                names=["lang", "a", "b", "ca", "cb", "m"],
            )


def share(count: str, total: str, terms_: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly; columns by name."""
    return F.expr(f"1 + (CAST({ONE} AS DECIMAL(38,0)) * ({count} + {PRIOR})) DIV ({total} + {PRIOR} * {terms_})")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part `pair`: item is another source of the language, value the sum over all kept terms
    of how much the shares of both differ (0 without kept terms), all ranks. Part `term`:
    item is a kept term that the source has more of than the language, value by how much,
    up to rank `top`. Ranks are from 1 by falling value, ties by item in order of bytes.

    Null texts, languages and sources count as ''. Sources without terms are compared all
    the same; a language with one source has no pairs. Repeated rows count each time; other
    columns are not read; a very long text is counted in blocks; an empty table gives no
    rows."""
    kept = table(kept_terms(docs, text, lang, source, least), "kept-terms")
    each = kept.select("lang", "term", F.col("n").alias("whole"), F.explode("by").alias("x")).select("lang", "term", "whole", "x.source", "x.n")
    totals = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(_named(lang, "lang"), _named(source, "source")).distinct()
    groups = table(named.join(sums, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]), "groups")

    p, q = share("n", "total", "terms"), share("whole", "lang_total", "terms")
    more = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)

    one = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "terms")
    pairs = one.join(groups.select("lang", F.col("source").alias("b"), F.col("total").alias("tb")), "lang").where("a < b")
    joint = kept.select("lang", "by").mapInArrow(_tallied, "lang string, a string, b string, ca long, cb long, m long").groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    own = each.groupBy("lang", "source", F.col("n").alias("c")).agg(F.count("*").alias("m"))

    def cells(rows: DataFrame, *of: tuple[str, str, str]) -> DataFrame:
        made = F.inline(F.array(*[F.struct(F.expr(a).cast("long").alias("ca"), F.expr(b).cast("long").alias("cb"), F.expr(m).cast("long").alias("m")) for a, b, m in of]))
        return rows.select("lang", "a", "b", made)

    both = pairs.select("lang", "a", "b", "terms")
    every = (
        cells(joint, ("ca", "cb", "m"), ("ca", "0", "-m"), ("0", "cb", "-m"), ("0", "0", "m"))
        .unionByName(cells(both.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), ("c", "0", "m"), ("0", "0", "-m")))
        .unionByName(cells(both.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), ("0", "c", "m"), ("0", "0", "-m")))
        .unionByName(cells(both, ("0", "0", "terms")))
    )
    tally = every.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    differ = F.abs(share("ca", "ta", "terms") - share("cb", "tb", "terms")) * F.col("m")
    summed = tally.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(differ).alias("value"))
    valued = both.drop("terms").join(summed, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ranked = valued.select("lang", "value", ways).withColumn("rank", F.row_number().over(falling))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))
