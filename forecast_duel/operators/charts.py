"""The numbers behind the report's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.operators.coverage import coverage_by_client
from forecast_duel.operators.metrics import weighted_wape
from forecast_duel.settings import TIE, TOTAL, Settings

# The histogram's clip and number of bins.
CLIP = 100.0
BINS = 40


def chart_winners(totals: DataFrame, s: Settings) -> DataFrame:
    """Bars in fixed order; a method without wins has none, series without winner do not count."""
    decided = F.col("comparable") - F.col("no_winner")
    bars = [
        F.struct(F.lit(i).alias("ORDEN"), F.lit(name).alias("METODO"), F.col(wins).alias("N"), decided.alias("whole"))
        for i, (name, wins) in enumerate(
            [(s.challenger, "won_by_challenger"), (s.base, "won_by_base"), (TIE, "tied")], start=1
        )
    ]
    return (
        totals.select(F.inline(F.array(*bars)))
        .filter(F.col("N") > 0)
        .select("ORDEN", "METODO", "N", percent(F.col("N"), F.col("whole")).alias("PCT"))
    )


def chart_wape(totals: DataFrame, s: Settings) -> DataFrame:
    base, challenger, _ = weighted_wape()
    bars = [
        F.struct(F.lit(i).alias("ORDEN"), F.lit(name).alias("METODO"), (value * 100).alias("WAPE_PCT"))
        for i, (name, value) in enumerate([(s.base, base), (s.challenger, challenger)], start=1)
    ]
    return totals.select(F.inline(F.array(*bars)))


def chart_coverage(by_label: DataFrame, s: Settings) -> DataFrame:
    return coverage_by_client(by_label, s).filter(F.col("ID_CLIENT") != TOTAL).select("ID_CLIENT", "PCT_COMPARABLES")


def improvement_histogram(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Row improvement clipped to +-100 in 40 equal bins; only the last bin includes its upper edge."""
    values = comparable_rows.filter(F.col(s.improvement).isNotNull()).select(
        F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(s.improvement))).alias("x")
    )
    # A single value gets a range of 1 around it, no value the range 0 to 1.
    flat = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    extent = (
        values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .select(F.coalesce(F.col("lo") - flat, F.lit(0.0)).alias("lo"), F.coalesce(F.col("hi") + flat, F.lit(1.0)).alias("hi"))
        .select(F.struct("lo", "hi", ((F.col("hi") - F.col("lo")) / BINS).alias("width")))
        .scalar()
    )

    def with_range(build) -> Column:
        """Bound to a lambda variable, the subquery stands once in the plan, however often it is used."""
        return F.transform(F.array("extent"), build)[0]

    placed = values.withColumn("extent", extent).select(with_range(lambda e: bin_of(F.col("x"), e)).alias("BIN"))
    counts = placed.groupBy("BIN").agg(F.count("*").alias("N"))
    bins = comparable_rows.sparkSession.range(1, BINS + 1, 1, 1).select(F.col("id").alias("BIN"))
    edges = with_range(lambda e: F.struct(edge(F.col("BIN") - 1, e).alias("DESDE"), edge(F.col("BIN"), e).alias("HASTA")))
    return (
        bins.withColumn("extent", extent)
        .join(F.broadcast(counts), "BIN", "left")
        .select("BIN", edges.alias("edges"), F.coalesce("N", F.lit(0)).alias("N"))
        .select("BIN", "edges.DESDE", "edges.HASTA", "N")
        .orderBy("BIN")
    )


def edge(i: Column, extent: Column) -> Column:
    return F.when(i == BINS, extent["hi"]).otherwise(extent["lo"] + i * extent["width"])


def bin_of(x: Column, extent: Column) -> Column:
    """1-based bin by the printed edges: a quotient next to an edge may round to the wrong side."""
    guess = F.least(F.floor((x - extent["lo"]) / extent["width"]), F.lit(BINS - 1))
    too_high = (x < edge(guess, extent)).cast("long")
    too_low = ((x >= edge(guess + 1, extent)) & (guess < BINS - 1)).cast("long")
    return guess - too_high + too_low + 1
