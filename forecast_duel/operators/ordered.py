"""Running totals and as-of joins over ordered rows, without a task that sees a whole group.

A window over a group puts all of its rows into one task, and a window without groups puts the whole table there. Here the
rows are dealt out by ranges of (group, order), so a group of any size is cut into ranges; each range is reduced to one
small row, the rows before a range are summed up from those, and that figure enters the range as a row ahead of its first
one. A window then runs within (group, range). No join is needed to hand the figure over.

The ranges come from a sample, so they are written to the shared folder before they are used: a task that is repeated finds
the same ranges. Both functions run that write when they are called.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.sources.scratch import written

# Columns of this module's own; an input cannot have them.
RANGE, IS_ROW, EARLIER = "__range", "__is_row", "__earlier"
AT, SIDE, FOUND = "__at", "__side", "__found"


def in_ranges(rows: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` dealt out by ranges of ``by`` and ``order``, stored, with the number of the range.

    Rows that tie in all of them share a range, so ``order`` should end in something that tells rows apart.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *(F.col(c) for c in by), *order)
    return written(placed.withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_carried(placed: DataFrame, carried: DataFrame) -> DataFrame:
    """The rows and, ahead of each range's rows, what earlier ranges of its group hand over."""
    return placed.withColumn(IS_ROW, F.lit(True)).unionByName(carried.withColumn(IS_ROW, F.lit(False)), allowMissingColumns=True)


def running_totals(
    rows: DataFrame, order: list[Column], totals: dict[str, str], by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """``rows`` with the running total of columns: ``totals`` names the new column of each summed one.

    A total covers the rows of the group ``by`` up to and with the own row in ``order``; null adds nothing, and a group's null
    key is a group. Sums of whole numbers and decimals are exact. Rows that tie in the whole order follow one another in any
    order. Without ``by`` there is one group, and one row a range passes the driver.
    """
    by = by or []
    placed = in_ranges(rows, by, order, ranges)
    sums = placed.groupBy(*by, RANGE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals))
    if by:
        before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(*by, RANGE, *(F.sum(c).over(before).alias(c) for c in totals)).where(F.col(next(iter(totals))).isNotNull())
    else:
        carried = carried_through_driver(sums, list(totals))
    within = Window.partitionBy(*by, RANGE).orderBy(IS_ROW, *order).rowsBetween(Window.unboundedPreceding, 0)
    kinds = dict(sums.dtypes)
    added = {name: F.coalesce(F.sum(c).over(within), F.lit(0)).cast(kinds[c]).alias(name) for c, name in totals.items()}
    full = with_carried(placed, carried).select("*", *added.values())
    return full.where(IS_ROW).select(*rows.columns, *added)


def carried_through_driver(sums: DataFrame, columns: list[str]) -> DataFrame:
    """Totals of all earlier ranges for each range of one group; there are as many rows as ranges."""
    known = {r[RANGE]: r for r in sums.collect()}
    numbers = sorted(known)
    before = {c: dict(zip(numbers, accumulate((known[n][c] for n in numbers), initial=0))) for c in columns}
    schema = sums.select(RANGE, *columns).schema
    kinds = {f.name: f.dataType for f in schema}
    as_kind = {c: (float if kinds[c].typeName() == "double" else lambda v: v) for c in columns}
    decimals = [c for c in columns if kinds[c].typeName() == "decimal"]
    plain = [(n, *(str(before[c][n]) if c in decimals else as_kind[c](before[c][n]) for c in columns)) for n in numbers]
    text = ", ".join(f"`{c}` {'string' if c in decimals else kinds[c].simpleString()}" for c in columns)
    made = sums.sparkSession.createDataFrame(plain, f"{RANGE} int, {text}")
    return made.select(RANGE, *(F.col(c).cast(kinds[c]).alias(c) for c in columns))


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], prefix: str = "PREV_",
    strict: bool = True, tie: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """``left`` with the latest row of ``right`` that has the same ``by`` and an earlier ``on`` (``strict``), or no later one.

    Keys are equal if both are null. ``on`` and ``values`` of the row found are added under ``prefix``, null where there is
    none; a row without ``on`` finds nothing and is found by nothing. Of right rows at the same time the one with the smallest
    ``tie`` (values themselves, if none is given) is taken. Every left row stays, once.
    """
    kept = F.struct(F.col(on), *(F.col(v) for v in values))
    first = F.min_by(kept, F.struct(tie, *values)) if tie else F.min(kept)
    offered = right.where(F.col(on).isNotNull()).groupBy(*by, F.col(on).alias(AT)).agg(first.alias(EARLIER))
    # At the same time a left row stands before the right one if it must not see it.
    asking = left.select("*", F.col(on).alias(AT), F.lit(0 if strict else 2).alias(SIDE))
    events = asking.unionByName(offered.withColumn(SIDE, F.lit(1)), allowMissingColumns=True)
    order = [F.col(AT), F.col(SIDE), F.xxhash64(*left.columns)]
    placed = in_ranges(events, by, order, ranges)
    last = placed.groupBy(*by, RANGE).agg(F.max_by(EARLIER, F.when(F.col(EARLIER).isNotNull(), F.col(AT))).alias(EARLIER))
    before = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn(EARLIER, F.last(EARLIER, ignorenulls=True).over(before)).where(F.col(EARLIER).isNotNull())
    within = Window.partitionBy(*by, RANGE).orderBy(IS_ROW, *order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col(on).isNotNull(), F.last(EARLIER, ignorenulls=True).over(within)).alias(FOUND)
    answered = with_carried(placed, carried).select("*", found).where(F.col(IS_ROW) & (F.col(SIDE) != 1))
    return answered.select(*left.columns, *(F.col(f"{FOUND}.{c}").alias(prefix + c) for c in (on, *values)))
