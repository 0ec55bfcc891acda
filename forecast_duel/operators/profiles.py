"""Profiles of won and lost series by model and classification.

The profiled columns are unpivoted, so that one aggregate counts all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.operators.clients import in_report_order
from forecast_duel.operators.distribution import most_frequent, shown, sum_of
from forecast_duel.operators.metrics import summand, weighted_wape, zero_if_absent
from forecast_duel.operators.universe import won_by
from forecast_duel.settings import Settings

# A dimension of both methods' profiles.
COMMON_DIMENSION = "SERIES_CLASSIFICATION"


def profiled_columns(s: Settings, winner: str) -> list[str]:
    first = s.winner_model if winner == s.challenger else s.best_model(s.base)
    return [first, s.best_model(s.challenger), *s.series_dimensions]


def position_of(dimensions: list[str]) -> Column:
    return F.array_position(F.array(*(F.lit(d) for d in dimensions)), F.col("DIMENSION"))


def win_profile(comparable_rows: DataFrame, s: Settings, winner: str) -> DataFrame:
    """Count and share of each value of the five profiled columns among a method's wins."""
    dimensions = profiled_columns(s, winner)
    counts = (
        comparable_rows.filter(won_by(s, winner))
        .unpivot([], dimensions, "DIMENSION", "VALOR")
        .groupBy("DIMENSION", "VALOR")
        .agg(F.count("*").alias("N"))
    )
    # Every dimension counts every won series once, so this reuses the shuffle of the counts.
    wins = sum_of(counts, "N") / len(dimensions)
    shares = percent(F.col("N"), wins).alias("PCT")
    return counts.select("DIMENSION", shown("VALOR", s.null_label), "N", shares).orderBy(
        position_of(dimensions), *most_frequent("VALOR")
    )


def won_series(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Series won by either method, with the winner as GANADOR."""
    return comparable_rows.filter(F.col(s.winner).isin(s.challenger, s.base)).withColumn("GANADOR", F.col(s.winner))


def unpivoted_wins(comparable_rows: DataFrame, s: Settings, kept: list[str]) -> DataFrame:
    """Won series of both methods with their profiled columns as (DIMENSION, VALOR) rows."""
    of_challenger = profiled_columns(s, s.challenger)
    of_base = profiled_columns(s, s.base)
    applies = F.when(F.col("GANADOR") == s.challenger, F.col("DIMENSION").isin(of_challenger)).otherwise(
        F.col("DIMENSION").isin(of_base)
    )
    return (
        won_series(comparable_rows, s)
        .unpivot(["GANADOR", *kept], list(dict.fromkeys(of_challenger + of_base)), "DIMENSION", "VALOR")
        .filter(applies)
    )


def position_in_report(s: Settings) -> Column:
    return position_of(list(dict.fromkeys(profiled_columns(s, s.challenger) + profiled_columns(s, s.base))))


def win_profiles_by_client(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """The profiles of both methods within each client."""
    counts = (
        unpivoted_wins(comparable_rows, s, ["ID_CLIENT"])
        .groupBy("GANADOR", "ID_CLIENT", "DIMENSION", "VALOR")
        .agg(F.count("*").alias("N"))
    )
    # Every dimension counts each won series once, so the counts of any one add up to the wins.
    wins = F.sum(F.when(F.col("DIMENSION") == COMMON_DIMENSION, F.col("N"))).over(Window.partitionBy("GANADOR", "ID_CLIENT"))
    shares = counts.select(
        "GANADOR", "ID_CLIENT", "DIMENSION", shown("VALOR", s.null_label), "N",
        percent(F.col("N"), wins).alias("PCT"),
    )
    return in_report_order(shares, s, position_in_report(s), *most_frequent("VALOR"), first=("GANADOR",))


def value_by_dimension(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Error saved and weighted WAPE per model and classification, for either winner."""
    measures = {
        "history": s.total_history,
        "base_error": s.abs_error(s.base),
        "challenger_error": s.abs_error(s.challenger),
    }
    saved = zero_if_absent("base_error") - zero_if_absent("challenger_error")
    summed = [F.sum(summand(c, s)).alias(name) for name, c in measures.items()]
    sums = (
        unpivoted_wins(comparable_rows, s, list(measures.values()))
        .groupBy("GANADOR", "DIMENSION", "VALOR")
        .agg(F.count("*").alias("N"), *summed)
        .withColumn("saved", saved.cast("double"))
    )
    base, challenger, improvement = weighted_wape()
    # Every dimension covers the same series, so the sums of any one add up to the winner's.
    whole = F.sum(F.when(F.col("DIMENSION") == COMMON_DIMENSION, F.col("saved"))).over(Window.partitionBy("GANADOR"))
    return (
        sums.withColumn("whole", whole)
        .select(
            "GANADOR", "DIMENSION", "VALOR", "N",
            F.col("saved").alias("REDUCCION_ERROR"),
            percent(F.col("saved"), F.col("whole")).alias("PCT_REDUCCION_ERROR"),
            base.alias(f"{s.base}_WAPE"),
            challenger.alias(f"{s.challenger}_WAPE"),
            improvement.alias(f"{s.challenger}_IMPROVEMENT_VS_{s.base}_PCT"),
        )
        .orderBy("GANADOR", position_in_report(s), F.col("REDUCCION_ERROR").desc(), F.col("VALOR").asc_nulls_last())
    )
