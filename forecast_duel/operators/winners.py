"""Performance: who wins, how often, and how much error is saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.operators.clients import on_spine
from forecast_duel.operators.distribution import (
    distribution_by_client, most_frequent, sum_of, value_counts,
)
from forecast_duel.operators.metrics import share, weighted_wape, zero_if_absent
from forecast_duel.operators.universe import won_by
from forecast_duel.settings import Settings


def wins_of(s: Settings, method: str) -> str:
    """Name of the metric that counts a method's wins."""
    return "won_by_challenger" if method == s.challenger else "won_by_base"


def winner_distribution(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    return distribution_by_client(comparable_rows, s.winner, s, "PCT_SOBRE_COMPARABLES")


def finalist_distribution(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    return value_counts(comparable_rows, s.finalist)


def win_summary(totals: DataFrame, s: Settings, method: str) -> DataFrame:
    wins = wins_of(s, method)
    return totals.select(
        F.col(wins).alias(f"N_SERIES_GANA_{method}"),
        share(wins, "comparable").alias("PCT_SOBRE_COMPARABLES"),
        F.col("comparable").alias("N_SERIES_COMPARABLES_TOTAL"),
    )


def wins_by_client(metrics: DataFrame, s: Settings, method: str) -> DataFrame:
    """Wins per configured client; the share is null for a client without series."""
    wins = wins_of(s, method)
    return on_spine(metrics.select("ID_CLIENT", "comparable", wins), s, total=False).select(
        "ID_CLIENT",
        zero_if_absent("comparable").alias("N_COMPARABLES"),
        zero_if_absent(wins).alias(f"N_GANA_{method}"),
        share(wins, "comparable").alias(f"PCT_GANA_{method}"),
    )


def wape_impact(by_label: DataFrame, s: Settings) -> DataFrame:
    base, challenger, improvement = weighted_wape()
    return by_label.select(
        "ID_CLIENT",
        zero_if_absent("comparable").alias("N_SERIES_COMPARABLES"),
        base.alias(f"{s.base}_WAPE_GLOBAL"),
        challenger.alias(f"{s.challenger}_WAPE_GLOBAL"),
        improvement.alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}_GLOBAL_PCT"),
    )


def global_summary(totals: DataFrame, s: Settings) -> DataFrame:
    """The executive row. A comparable series without winner counts in the shares."""
    base, challenger, improvement = weighted_wape()
    names = F.lit("*" if s.clients is None else ", ".join(str(c) for c in s.clients))
    return totals.select(
        names.alias("CLIENTES_ANALIZADOS"),
        F.col("candidates").alias("SERIES_CANDIDATAS_TOTAL"),
        F.col("comparable").alias("SERIES_COMPARABLES_TOTAL"),
        share("comparable", "candidates").alias("PCT_COMPARABLES"),
        base.alias(f"{s.base}_WAPE_GLOBAL"),
        challenger.alias(f"{s.challenger}_WAPE_GLOBAL"),
        improvement.alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}_GLOBAL_PCT"),
        share("won_by_challenger", "comparable").alias(f"PCT_SERIES_GANA_{s.challenger}"),
        share("won_by_base", "comparable").alias(f"PCT_SERIES_GANA_{s.base}"),
        share("tied", "comparable").alias("PCT_SERIES_TIE"),
    )


def top_winner_models(comparable_rows: DataFrame, s: Settings, n: int = 5) -> DataFrame:
    """Most frequent winner models where the challenger wins.

    A win without model is not listed but counts in the share.
    """
    counts = (
        comparable_rows.filter(won_by(s, s.challenger))
        .groupBy(s.winner_model)
        .agg(F.count("*").alias("N"))
    )
    order = most_frequent(s.winner_model)
    # The null model is one row, so the wanted ones are among the first n + 1.
    first = counts.orderBy(*order).limit(n + 1).filter(F.col(s.winner_model).isNotNull())
    return (
        first.select(s.winner_model, "N", percent(F.col("N"), sum_of(counts, "N")).alias("PCT"))
        .orderBy(*order)
        .limit(n)
    )
