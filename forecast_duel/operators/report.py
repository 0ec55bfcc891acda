"""Figures of the executive text: the verdict and rendered numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import format_count, format_percent
from forecast_duel.operators.metrics import share, weighted_wape, zero_if_absent
from forecast_duel.operators.statistics import GROUP, win_label
from forecast_duel.settings import Settings

IMPROVES, NOT_IMPROVED, UNDEFINED = "IMPROVES", "NOT_IMPROVED", "UNDEFINED"


def verdict(stats: DataFrame, totals: DataFrame, s: Settings) -> DataFrame:
    """Does the challenger improve the forecast? One row with the figures the answer quotes.

    ``stats`` are the statistics of both methods' wins.
    """
    base, challenger, improvement = weighted_wape()
    answer = (
        F.when(improvement.isNull(), UNDEFINED).when(improvement > 0, IMPROVES).otherwise(NOT_IMPROVED)
    )

    def quoted(method: str, name: str):
        return F.max(F.when(F.col(GROUP) == win_label(method), F.col(name))).alias(f"{method}_{name}")

    # One subquery for both methods, so that their percentiles share the scans.
    quotes = stats.agg(
        F.struct(*(quoted(s.challenger, n) for n in ("median", "mean", "p25", "p75")), quoted(s.base, "median"))
    ).scalar()
    return (
        totals.withColumn("quotes", quotes)
        .select(
            answer.alias("VEREDICTO"),
            (base * 100).alias(f"{s.base}_WAPE_PCT"),
            (challenger * 100).alias(f"{s.challenger}_WAPE_PCT"),
            improvement.alias("MEJORA_PCT"),
            F.col("won_by_challenger").alias(f"N_GANA_{s.challenger}"),
            share("won_by_challenger", "comparable").alias(f"PCT_GANA_{s.challenger}"),
            F.col("won_by_base").alias(f"N_GANA_{s.base}"),
            share("won_by_base", "comparable").alias(f"PCT_GANA_{s.base}"),
            F.col("tied").alias("N_TIE"),
            share("tied", "comparable").alias("PCT_TIE"),
            F.col(f"quotes.{s.challenger}_median").alias(f"MEDIANA_MEJORA_{s.challenger}"),
            F.col(f"quotes.{s.challenger}_mean").alias(f"MEDIA_MEJORA_{s.challenger}"),
            F.col(f"quotes.{s.challenger}_p25").alias(f"P25_MEJORA_{s.challenger}"),
            F.col(f"quotes.{s.challenger}_p75").alias(f"P75_MEJORA_{s.challenger}"),
            F.negative(F.col(f"quotes.{s.base}_median")).alias(f"MEDIANA_PERDIDA_{s.challenger}"),
        )
    )


def formatted_kpis(by_label: DataFrame, s: Settings) -> DataFrame:
    """Coverage and error figures per client as the report prints them."""
    candidates, comparable = zero_if_absent("candidates"), zero_if_absent("comparable")
    base, challenger, improvement = weighted_wape()
    return by_label.select(
        "ID_CLIENT",
        format_count(candidates).alias("SERIES_CANDIDATAS"),
        format_count(comparable).alias("SERIES_COMPARABLES"),
        format_percent(share("comparable", "candidates")).alias("PCT_COMPARABLES"),
        format_count(candidates - comparable).alias("SERIES_NO_COMPARABLES"),
        format_count(zero_if_absent("excluded")).alias(f"SERIES_{s.excluded_flag}"),
        format_percent(share("excluded", "candidates")).alias(f"PCT_{s.excluded_flag}"),
        format_percent(base * 100).alias(f"{s.base}_WAPE"),
        format_percent(challenger * 100).alias(f"{s.challenger}_WAPE"),
        format_percent(improvement).alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}"),
    )
