"""All matches of a pattern with their offsets, as an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parsefold.functions.arrays import sums_before
from parsefold.functions.text import let


def match_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, match, g1..>> of all matches in order, start from 0. A text without
    any is passed over once; for others, what lies
    between matches comes from a split at the same pattern; its lengths and those of the
    matches add up to the offsets. The pattern must not match the empty string."""
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast("array<struct<start:int,match:string" + "".join(f",g{g}:string" for g in range(1, groups + 1)) + ">>")

    def rows(m: Column) -> Column:
        between = let(F.split(text, pattern, -1), lambda b: F.slice(b, 1, F.size(b) - 1))
        return F.arrays_zip(between.alias("b"), m.alias("m0"), *[all_of(g).alias(f"m{g}") for g in range(1, groups + 1)])

    def placed(x: Column) -> Column:
        def one(r: Column, at: Column) -> Column:
            return F.struct((at + F.char_length(r["b"])).alias("start"), r["m0"].alias("match"), *[r[f"m{g}"].alias(f"g{g}") for g in range(1, groups + 1)])

        return F.zip_with(x, sums_before(F.transform(x, lambda r: F.char_length(r["b"]) + F.char_length(r["m0"]))), one)

    return let(all_of(0), lambda m: F.when(F.size(m) == 0, none).otherwise(let(rows(m), placed)))
