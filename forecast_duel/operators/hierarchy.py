"""Coverage, wins and weighted WAPE at every level of the value hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.operators.metrics import additive_metrics, share, weighted_wape
from forecast_duel.schema import VALUE_LEVELS
from forecast_duel.settings import Settings

USED = ["candidates", "comparable", "won_by_challenger", "won_by_base", "tied", "history", "base_error", "challenger_error"]


def value_hierarchy(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    """One row for the whole table (NIVEL 0), for each value of the first level (1), and so on to the finest combinations (5).

    The rows are added up once, by the finest combination; the levels above are rolled up from those groups, so
    the table's rows are not multiplied. A null value is a value of its own: NIVEL, not null, tells whether a level is rolled up.
    """
    metrics = additive_metrics(s)
    finest = candidate_rows.groupBy(*VALUE_LEVELS).agg(*(metrics[m].alias(m) for m in USED))
    rolled = finest.rollup(*VALUE_LEVELS).agg(*(F.sum(m).alias(m) for m in USED), F.grouping_id().alias("above"))
    base, challenger, improvement = weighted_wape()
    return rolled.select(
        (len(VALUE_LEVELS) - F.bit_count("above")).alias("NIVEL"), *VALUE_LEVELS,
        F.col("candidates").alias("SERIES_CANDIDATAS"), F.col("comparable").alias("SERIES_COMPARABLES"),
        share("comparable", "candidates").alias("PCT_COMPARABLES"),
        F.col("won_by_challenger").alias(f"N_GANA_{s.challenger}"), F.col("won_by_base").alias(f"N_GANA_{s.base}"), F.col("tied").alias("N_TIE"),
        share("won_by_challenger", "comparable").alias(f"PCT_GANA_{s.challenger}"),
        base.alias(f"{s.base}_WAPE"), challenger.alias(f"{s.challenger}_WAPE"), improvement.alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}_PCT"),
    ).orderBy("NIVEL", *VALUE_LEVELS)
