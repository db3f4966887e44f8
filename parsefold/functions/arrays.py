"""Running folds over arrays, whose cost does not grow with the square of their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsefold.functions.text import let

#: Elements appended one by one before a new array is begun.
BLOCK = 256


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exploded(df: DataFrame, structs: Column, *keys: str) -> DataFrame:
    """A row for each element of an array of structs: keys and the struct's fields. An inner
    generator would have the optimiser filter on the array's size, which evaluates the
    whole expression of the array a second time; an outer one does not."""
    held = fresh(df, "__element")
    return df.select(*keys, F.explode_outer(structs).alias(held)).where(F.col(held).isNotNull()).select(*keys, f"{held}.*")


def numbered(df: DataFrame, values: Column, at: str, name: str, *keys: str) -> DataFrame:
    """A row for each element of an array, null ones too: keys, its place from 0 and the
    element. The generator is an outer one for the reason given at `exploded`."""
    return df.select(*keys, F.posexplode_outer(values).alias(at, name)).where(F.col(at).isNotNull())


def scan(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state after each element: array<kind> as long as values. An append copies its
    array, so states are gathered in blocks: a first fold finds the state that each block
    begins with, then each block is folded from there."""
    none = F.array().cast(f"array<{kind}>")

    def gathered(begin: Column, block: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            return let(step(a["s"], x), lambda s: F.struct(s.alias("s"), F.concat(a["out"], F.array(s)).alias("out")))

        return F.aggregate(block, F.struct(begin.cast(kind).alias("s"), none.alias("out")), add, lambda a: a["out"])

    def whole(blocks: Column) -> Column:
        def begin(a: Column, block: Column) -> Column:
            return F.struct(F.aggregate(block, a["s"], step).cast(kind).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out"))

        begins = F.aggregate(blocks, F.struct(zero.cast(kind).alias("s"), none.alias("out")), begin, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, begins, lambda block, s: gathered(s, block)))

    def cut(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        blocks = F.transform(at, lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(x) <= BLOCK, gathered(zero, x)).otherwise(let(blocks, whole))

    return let(values, cut)


def sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it."""
    return let(numbers, lambda n: F.zip_with(scan(n, F.lit(0), lambda a, x: a + x, "int"), n, lambda s, x: s - x))
