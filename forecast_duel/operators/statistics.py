"""Descriptive statistics with exact percentiles on any number of rows.

``percentile`` keeps every distinct value of a group in one task. Here the wanted ranks are found by counting: the
values are counted in coarse slots of a fixed monotone scale, a running total shows which slots hold the wanted
ranks, and only the rows of those slots are counted again, in equal parts of the slot's own range and at last by
value. Each count is summed on the map side and shuffled by slot; a running total sees the slots of a group, the
parts of a slot or the different values of a part.

TOTAL is the sum of the groups' counts. Rows are doubled for it only where they fall into one of its few wanted slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.operators.clients import client_label, on_spine
from forecast_duel.operators.universe import won_by
from forecast_duel.settings import TOTAL, Settings

# The statistics' names, in report order, and the percentiles' fractions.
STATISTICS = ["count", "mean", "median", "p10", "p25", "p75", "p90", "min", "max"]
FRACTIONS = {"median": 0.5, "p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}

GROUP = "GRUPO"
# Slots per unit of the logarithmic scale: at most 93,000 slots span all doubles. Parts of a slot's range.
COARSE, PARTS = 2**6, 2**16


def describe(values: DataFrame, approx: bool = False, total: bool = False) -> DataFrame:
    """Statistics of the non-null ``value`` per ``GRUPO``; a group without any has no row. NaN counts as missing.

    ``total`` adds a row TOTAL over all groups.
    """
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return in_one_pass(values, total) if approx else by_counting(values, total)


def in_one_pass(values: DataFrame, total: bool) -> DataFrame:
    """Approximate percentiles; their states are merged, so TOTAL is one more grouping set."""
    fractions = F.array(*(F.lit(f) for f in FRACTIONS.values()))
    grouped = values.groupingSets([[GROUP], []], GROUP) if total else values.groupBy(GROUP)
    label = F.when(F.grouping(GROUP) == 1, TOTAL).otherwise(F.col(GROUP)) if total else F.col(GROUP)
    return (
        grouped.agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile_approx("value", fractions).alias("q"),
            label.alias("label"),
        )
        .filter("count > 0")
        .drop(GROUP)
        .withColumnRenamed("label", GROUP)
        .withColumns({name: F.col("q")[i] for i, name in enumerate(FRACTIONS)})
        .select(GROUP, *STATISTICS)
    )


def by_counting(values: DataFrame, total: bool) -> DataFrame:
    slotted = values.select(F.struct(F.col(GROUP).alias("name"), F.lit(False).alias("all")).alias(GROUP), "value", coarse_slot().alias("coarse"))
    summed = [F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max")]
    counts = slotted.groupBy(GROUP, "coarse").agg(
        F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    if total:
        whole = F.struct(F.lit(TOTAL).alias("name"), F.lit(True).alias("all"))
        counts = counts.unionByName(counts.groupBy("coarse").agg(*summed).withColumn(GROUP, whole))
    group = Window.partitionBy(GROUP)
    summary = F.struct(
        F.sum("n").over(group).alias("count"),
        (F.sum("sum").over(group) / F.sum("n").over(group)).alias("mean"),
        F.min("min").over(group).alias("min"),
        F.max("max").over(group).alias("max"),
    )
    found = with_ranks(
        counts.withColumn("summary", summary).withColumn("ranks", wanted_ranks(F.col("summary.count"))),
        [GROUP],
        "coarse",
    ).select(GROUP, "summary", "coarse", "ranks", F.col("min").alias("lo"), F.col("max").alias("hi"))

    rows = slotted
    if total:
        slots = found.filter(f"{GROUP}.all").agg(F.collect_set("coarse")).scalar()  # ten slots at most
        also = F.when(F.array_contains(slots, F.col("coarse")), F.array(F.col(GROUP), whole)).otherwise(F.array(F.col(GROUP)))
        rows = slotted.select(F.explode(also).alias(GROUP), "value", "coarse")
    for known, finer in ((["coarse"], "part"), (["coarse", "part"], "value")):
        place = [GROUP, *known]
        if finer == "value":
            rows = rows.join(edges, [GROUP, "coarse"]).withColumn("part", part_of_range()).drop("lo", "hi")
        else:
            edges = found.select(GROUP, "coarse", "lo", "hi")
        inside = rows.join(found, place)
        if finer == "part":
            inside = inside.withColumn("part", part_of_range())
        counts = inside.groupBy(*place, "summary", "ranks", finer).agg(F.count("*").alias("n"))
        found = with_ranks(counts, place, finer).select(*place, finer, "summary", "ranks")

    picked = found.select(GROUP, "summary", "value", F.explode("ranks.rank").alias("rank"))
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "value")))  # ten ranks at most
    return (
        picked.groupBy(GROUP, "summary")
        .agg(by_rank.alias("at"))
        .select(F.col(f"{GROUP}.name").alias(GROUP), "summary.*", *(interpolated(f).alias(name) for name, f in FRACTIONS.items()))
        .select(GROUP, *STATISTICS)
    )


def coarse_slot() -> Column:
    """Infinite values have slots of their own."""
    value = F.col("value")
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * COARSE)


def part_of_range() -> Column:
    """The part of the range from ``lo`` to ``hi`` that holds ``value``; a range of one value is one part."""
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return F.when(F.col("lo") == F.col("hi"), F.lit(0).cast("long")).otherwise(F.floor(share * PARTS))


def wanted_ranks(count: Column) -> Column:
    """The 0-based ranks that the percentiles interpolate between; ``left`` counts down by level."""
    places = [fraction * (count - 1) for fraction in FRACTIONS.values()]
    ranks = F.array_distinct(F.array(*(f(p) for p in places for f in (F.floor, F.ceil))))
    return F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("left")))


def with_ranks(counts: DataFrame, place: list[str], finer: str) -> DataFrame:
    """Keep the slots that hold a wanted rank, and only those ranks."""
    running = Window.partitionBy(*place).orderBy(finer).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("upto")
    below = upto - F.col("n")
    inside = F.filter("ranks", lambda r: (r["left"] >= below) & (r["left"] < upto))
    shifted = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - below).alias("left")))
    return (
        counts.withColumn("upto", F.sum("n").over(running))
        .withColumn("ranks", shifted)
        .filter(F.size("ranks") > 0)
    )


def interpolated(fraction: float) -> Column:
    """The value itself where both neighbours agree: infinite ones have no difference."""
    place = fraction * (F.col("summary.count") - 1)
    low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
    return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))


# -- reports --------------------------------------------------------------------


def improvement_stats(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Statistics of the row improvement for TOTAL and each client."""
    label = client_label(F.col("ID_CLIENT"), F.lit(False))
    values = comparable_rows.select(label.alias(GROUP), F.col(s.improvement).alias("value"))
    stats = describe(values, s.approx, total=True)
    return on_spine(stats, s, label=GROUP).withColumn("count", F.coalesce("count", F.lit(0)))


def win_stats(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Statistics of the improvement where a method wins, one row for each method with wins.

    The challenger's wins are measured by the winner's improvement, the base's by the row
    improvement, which is negative there.
    """
    label = F.when(won_by(s, s.challenger), win_label(s.challenger)).when(won_by(s, s.base), win_label(s.base))
    value = F.when(won_by(s, s.challenger), F.col(s.winner_improvement)).otherwise(F.col(s.improvement))
    values = comparable_rows.filter(F.col(s.winner).isin(s.challenger, s.base)).select(label.alias(GROUP), value.alias("value"))
    return describe(values, s.approx)


def stats_of_wins(stats: DataFrame, method: str) -> DataFrame:
    """The row of one method of ``win_stats``, also without a win."""
    spine = stats.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(F.lit(win_label(method)))).alias(GROUP))
    return spine.join(F.broadcast(stats), GROUP, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def win_label(method: str) -> str:
    return f"TODAS (gana {method})"
