"""Running values along time in slices, so that a key with most of the rows is many tasks.

A slice is a stretch of time of one key.  Each slice is scanned on its own; what it passes on (its
last value, its count) is one small row; these rows are scanned in turn, and what came before a
slice is added back to its rows.  The result is that of one scan over the whole key, whatever
the length of a slice.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a slice: a week of 15-minute bars is 672 rows.
SLICE_MINUTES = 7 * 24 * 60
#: Rows in all up to which a key is no burden for one task: one scan then costs less than slices.
ONE_SCAN_ROWS = 1_000_000


def running(rows: DataFrame, by: list[str], time: str, order: list[str], last: list[str] = (), sums: list[str] = (), backward: bool = False, slice_minutes: int = SLICE_MINUTES, one_scan_rows: int | None = None) -> DataFrame:
    """rows with each column of ``last`` replaced by the latest value that is not null, and each of
    ``sums`` by its sum, from the key's first row up to and including this one, in the order of
    (time, order...), or from its last row back with ``backward``.  Rows that are equal in that order
    stand in any order, so it should be total where that matters.  ``rows`` are looked at more than
    once: write them first where they are costly.  Up to ``one_scan_rows`` rows in all (ONE_SCAN_ROWS
    with the default slices, none with others) are scanned in one piece, with the same result."""
    turn = (lambda c: F.desc(c)) if backward else (lambda c: F.asc(c))
    few = (ONE_SCAN_ROWS if slice_minutes == SLICE_MINUTES else 0) if one_scan_rows is None else one_scan_rows
    if few and rows.select(time).count() <= few:
        over = Window.partitionBy(*by).orderBy(turn(time), *[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({c: F.last(c, ignorenulls=True).over(over) for c in last} | {c: F.sum(c).over(over) for c in sums})
    slot = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (slice_minutes * 60_000_000))
    cut = rows.withColumn("__slot", slot)
    within = Window.partitionBy(*by, "__slot").orderBy(turn(time), *[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in last} | {c: F.sum(c).over(within) for c in sums})
    place = F.struct(time, *order)
    pick = F.min_by if backward else F.max_by
    passed = {c: pick(c, F.when(F.col(c).isNotNull(), place)) for c in last} | {c: F.sum(c) for c in sums}
    slices = cut.groupBy(*by, "__slot").agg(*[v.alias(f"__{c}") for c, v in passed.items()])
    before = Window.partitionBy(*by).orderBy(turn("__slot")).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = slices.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__slot").alias("__at"),
        *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in last], *[F.sum(f"__{c}").over(before).alias(f"__{c}") for c in sums],
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col("__slot").eqNullSafe(F.col("__at")))
    both = local.join(carried, same)
    whole = {c: F.coalesce(c, f"__{c}") for c in last} | {c: F.coalesce(F.col(c) + F.col(f"__{c}"), c, f"__{c}") for c in sums}
    return both.withColumns(whole).select(*rows.columns)
