"""As-of join: for each left row the last right row of its key at or before its moment.

Both sides are one union, sorted by key and moment, in which right rows are carried forward
by a window. A key with a large share of all rows is cut into slices of its moments: each
slice is a window of its own, and what was last before it comes from a table with one row
for each slice, so that no task has to hold or sort a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parsefold.functions.arrays import fresh

#: A key with more than 1/HOT of all rows, and more than SLICE_ROWS, is cut into slices of
#: about SLICE_ROWS rows, at most MOST_SLICES. There are never more than HOT such keys.
HOT, SLICE_ROWS, MOST_SLICES = 64, 1 << 18, 4096


def as_of(left: DataFrame, right: DataFrame, key: str, moment: str, prefix: str = "last_", strict: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left with the columns of right (named with the prefix, the key not repeated) of the
    last row of right with the same key at or before (strict: before) its moment; null where
    there is none. Of right rows at one moment the greatest counts, its other columns
    compared in order; they must be of types that can be compared. A null key or moment
    finds nothing; repeated left rows stay repeated."""
    held = [c for c in right.columns if c != key]
    clash = {prefix + c for c in held} & set(left.columns)
    if clash:
        raise ValueError(f"left has columns named {', '.join(sorted(clash))}")
    side, carried, slot, l, r = (fresh(left, n) for n in ("__side", "__carried", "__slot", "__left", "__right"))
    # Right rows come first at a moment, unless only earlier ones count.
    first, second = (1, 0) if strict else (0, 1)
    ordered = F.struct(F.col(moment).alias("__at"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(held)])
    from_right = right.where(F.col(key).isNotNull() & F.col(moment).isNotNull()).select(F.col(key).alias("k"), F.col(moment).alias("t"), F.lit(first).alias(side), ordered.alias(r))
    from_left = left.select(F.col(key).alias("k"), F.col(moment).alias("t"), F.lit(second).alias(side), F.struct(*left.columns).alias(l))
    both = from_right.unionByName(from_left, allowMissingColumns=True)

    cuts = _cuts(both.select("k", "t"), slice_rows)
    both = both.withColumn(slot, _slot(cuts))
    # Right rows at one moment: the greatest struct comes last.
    run = Window.partitionBy("k", slot).orderBy(F.col("t").asc_nulls_first(), side, F.col(r).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn(carried, F.last(r, ignorenulls=True).over(run)).where(F.col(l).isNotNull())
    if cuts:
        ends = both.where((F.col(slot) >= 0) & F.col(r).isNotNull()).groupBy("k", slot).agg(F.max(r).alias("end"))
        # For each hot key: what was last before each of its slices, one row a slice.
        every = both.where(F.col(slot) >= 0).select("k", slot).distinct().join(ends, ["k", slot], "left")
        earlier = Window.partitionBy("k").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
        edges = every.select("k", slot, F.last("end", ignorenulls=True).over(earlier).alias("edge")).where("edge IS NOT NULL")
        last = last.join(F.broadcast(edges), ["k", slot], "left").withColumn(carried, F.coalesce(carried, "edge"))
    found = F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.col(carried))
    fields = [found.getField(f"__{i}").alias(prefix + c) for i, c in enumerate(held)]
    return last.select(F.col(f"{l}.*"), *fields)


def _cuts(rows: DataFrame, slice_rows: int) -> list[tuple[object, list]]:
    """For each hot key, the moments at which it is cut. Keys and cuts are bounded by HOT and
    MOST_SLICES together, so they may pass the driver and edges may be broadcast."""
    counts = rows.where("k IS NOT NULL").groupBy("k").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [(x["k"], x["count"]) for x in counts.where((F.col("count") * HOT > total) & (F.col("count") > slice_rows)).collect()]
    out = []
    for k, n in hot:
        slices = min(MOST_SLICES * n // total + 1, -(-n // slice_rows))
        bounds = rows.where((F.col("k") == k) & F.col("t").isNotNull()).repartitionByRange(slices, "t").groupBy(F.spark_partition_id()).agg(F.min("t").alias("t"))
        # Slices begin at these moments; the first begins with the key.
        out.append((k, sorted(x["t"] for x in bounds.collect())[1:]))
    return [c for c in out if c[1]]


def _slot(cuts: list[tuple[object, list]]) -> Column:
    """The slice of a row of a hot key, -1 for all others: found by halving."""

    def within(bounds: list, first: int) -> Column:
        if not bounds:
            return F.lit(first)
        middle = len(bounds) // 2
        return F.when(F.col("t") < F.lit(bounds[middle]), within(bounds[:middle], first)).otherwise(within(bounds[middle + 1 :], first + middle + 1))

    found = F.lit(-1)
    for k, bounds in cuts:
        found = F.when(F.col("k") == F.lit(k), F.when(F.col("t").isNull(), 0).otherwise(within(bounds, 0))).otherwise(found)
    return found
