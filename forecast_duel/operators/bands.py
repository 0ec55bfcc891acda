"""Interval join of values with bands, and the results by band of volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import null_if_nan
from forecast_duel.operators.metrics import additive_metrics, share, weighted_wape
from forecast_duel.settings import Settings

BAND, LOW, HIGH = "BANDA", "DESDE", "HASTA"
# Bands of six months' volume: from (with) and to (without); None is open.
VOLUME_BANDS = [("A: menos de 1", None, 1.0), ("B: 1-49", 1.0, 50.0), ("C: 50-99", 50.0, 100.0), ("D: 100-199", 100.0, 200.0), ("E: desde 200", 200.0, None)]
# Buckets for each doubling, and for all doubles on either side of 0.
STEPS = 4
OUTERMOST = 1025 * STEPS
BUCKET = "__bucket"


def bucket_of(value: Column) -> Column:
    """A bucket on a scale that rises with the value, so that a band covers a run of buckets; infinite values have the outermost ones."""
    place = F.signum(value) * F.log2(1 + F.abs(value)) * STEPS
    clipped = F.greatest(F.lit(float(-OUTERMOST)), F.least(F.lit(float(OUTERMOST)), place))
    return F.when(value.isNotNull(), F.floor(clipped))  # greatest and least would pass over a null


def interval_join(rows: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """``rows`` with every band that holds ``value``; bands may overlap and leave gaps, and their number is free.

    A band is copied for each bucket that it covers, at most 8,201, and rows meet the bands of their own bucket only: an equi-join
    that adaptive execution broadcasts or splits by measured size. A row in no band, or without value, stays once, with null bands.
    """
    lowest, highest = F.lit(-OUTERMOST).cast("long"), F.lit(OUTERMOST).cast("long")
    first = F.coalesce(bucket_of(F.col(LOW)), lowest)
    last = F.coalesce(bucket_of(F.col(HIGH)), highest)
    dealt = bands.where(F.col(LOW).isNull() | F.col(HIGH).isNull() | (F.col(LOW) < F.col(HIGH))).withColumn(BUCKET, F.explode(F.sequence(first, last)))
    kept = rows.withColumn("__of", bucket_of(null_if_nan(F.col(value))))
    inside = (F.col("__of") == F.col(BUCKET)) & (F.col(LOW).isNull() | (F.col(value) >= F.col(LOW))) & (F.col(HIGH).isNull() | (F.col(value) < F.col(HIGH)))
    return kept.join(dealt, inside, "left").drop("__of", BUCKET)


def wins_by_volume_band(comparable_rows: DataFrame, s: Settings, bands: DataFrame | None = None) -> DataFrame:
    """Wins and weighted WAPE of the series in each band of volume; series without volume, or in no band, are the null band."""
    if bands is None:
        bands = comparable_rows.sparkSession.createDataFrame(VOLUME_BANDS, f"{BAND} string, {LOW} double, {HIGH} double")
    metrics = additive_metrics(s)
    used = ["comparable", "won_by_challenger", "won_by_base", "tied", "history", "base_error", "challenger_error"]
    sums = interval_join(comparable_rows, s.total_history, bands).groupBy(BAND, LOW, HIGH).agg(*(metrics[m].alias(m) for m in used))
    base, challenger, improvement = weighted_wape()
    return sums.select(
        BAND, LOW, HIGH, F.col("comparable").alias("N_SERIES"), F.col("won_by_challenger").alias(f"N_GANA_{s.challenger}"),
        F.col("won_by_base").alias(f"N_GANA_{s.base}"), F.col("tied").alias("N_TIE"), share("won_by_challenger", "comparable").alias(f"PCT_GANA_{s.challenger}"),
        base.alias(f"{s.base}_WAPE"), challenger.alias(f"{s.challenger}_WAPE"), improvement.alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}_PCT"),
    ).orderBy(F.col(LOW).asc_nulls_first(), BAND)
