"""Quality rules as DataFrame expressions, applied as a short-circuit cascade.

A rule is a condition on which a document is rejected. On a bounded sample each rule's
cost (time to evaluate it) and selectivity (share it rejects) are measured; the rules
then stand in one CASE expression by falling rejection per cost, so that a document
stops at the first rule that rejects it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsefold.llm.common import SPACES, fresh, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Rows on which costs and selectivities are measured, about, and how often a cost is
#: measured: the least of its times counts.
SAMPLE_ROWS, TRIALS, SEED = 2000, 3, 5
_CAPITALS = "".join(map(chr, range(65, 91)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: runs of anything but the six ASCII spaces."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \x09-\x0D]+"))


def without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(whole(text), characters, ""))


def word_chars(text: Column) -> Column:
    return without(text, SPACES).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(whole(text)) - without(text, SYMBOLS)).cast("long")


def n_capitals(text: Column) -> Column:
    return (F.char_length(whole(text)) - without(text, _CAPITALS)).cast("long")


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(whole(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(split: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of `window` words found twice or more. Windows are
    compared by 64-bit hashes. Texts without a repeated window end after one distinct
    count; for the others, windows are sorted by hash, those with an equal neighbour
    kept, and the union of their spans measured in one pass."""

    def of(keys: Column) -> Column:
        marked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        again = let(marked, lambda s: F.filter(s, lambda x, i: x["k"].eqNullSafe(F.get(s, i - 1)["k"]) | x["k"].eqNullSafe(F.get(s, i + 1)["k"])))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end"))
        spans = F.aggregate(starts, first, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(spans)

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))

    hashes = F.transform(split, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: F.when(F.size(h) < window, F.lit(0)).otherwise(let(windows(h), of)))
    return counted.cast("long")


@dataclass(frozen=True)
class Rule:
    """reject is built from the text's column, so that its cost is that of the whole rule."""

    name: str
    reject: Callable[[Column], Column]


def base_rule(text: Column) -> Column:
    split = words(text)
    return let(split, lambda w: (F.size(w) < MIN_WORDS) | (100 * n_repeat_words(w) > MAX_REPEAT_PERCENT * F.size(w)))


RULES = [
    Rule("symbols", lambda t: 100 * n_symbols(t) > 6 * word_chars(t)),
    Rule("shouting", lambda t: 100 * n_capitals(t) > 50 * word_chars(t)),
    Rule("repeated lines", lambda t: 100 * n_dup_lines(t) > 40 * n_lines(t)),
    Rule("word length", lambda t: let(F.size(words(t)), lambda n: (word_chars(t) < 2 * n) | (word_chars(t) > 20 * n))),
]


def measured(df: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample of about sample_rows rows, each row drawn
    by itself, so that a text which many rows repeat counts as often as it stands there."""
    total = df.count()
    sample = table(df.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(1, total)), SEED), "rule-sample")

    def timed(*values: Column) -> tuple[float, list]:
        taken = []
        for _ in range(TRIALS):
            began = time.perf_counter()
            row = sample.agg(F.count("*"), *values).first()
            taken.append(time.perf_counter() - began)
        return min(taken), list(row)

    floor = timed(F.sum(F.char_length("text")))[0]
    out = []
    for r in rules:
        seconds, (rows, rejected) = timed(F.sum(r.reject(F.col("text")).cast("int")))
        out.append((r, max(seconds - floor, 1e-3), (rejected or 0) / max(rows, 1)))
    return out


def ordered(found: list[tuple[Rule, float, float]]) -> list[Rule]:
    return [r for r, cost, share in sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))]


def cascade(rules: list[Rule], text: Column) -> Column:
    """True for a document that no rule rejects; later rules are not evaluated for a
    document that an earlier one rejects."""
    verdict = F
    for r in rules:
        verdict = verdict.when(F.coalesce(r.reject(text), F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True)) if rules else F.lit(True)


def apply_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", out: str = "kept") -> DataFrame:
    """df with a boolean verdict in column `out`, which is replaced if it is there. Null text
    counts as empty; repeated rows are judged one by one, long texts whole; an empty table
    gives no rows, and other columns are kept as they are."""
    rules = RULES + [Rule("base", base_rule)] if rules is None else rules
    return df.withColumn(out, cascade(ordered(measured(df, rules, text)), F.col(text)))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and
    base_failed; columns of these names are replaced. Null text has no words; repeated
    rows are measured one by one; a very long text is measured whole, in its row; an empty
    table gives no rows."""
    t = F.col(text)
    both = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("again")))
    held = fresh(df, "__words")
    marked = df.withColumn(held, both)
    for name, value in (("n_words", F.col(f"{held}.n")), ("word_chars", word_chars(t)), ("n_symbols", n_symbols(t)), ("n_dup_lines", n_dup_lines(t)), ("n_repeat_words", F.col(f"{held}.again"))):
        marked = marked.withColumn(name, value)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return marked.withColumn("base_failed", failed).drop(held)
