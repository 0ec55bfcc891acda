"""The two universes of the evaluation: candidate series and comparable series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import relative_improvement
from forecast_duel.settings import COMPARABLE, Settings


def is_comparable() -> Column:
    return F.col("COMPARISON_STATUS") == COMPARABLE


def is_not_comparable() -> Column:
    """Also true for a series without status."""
    return ~F.col("COMPARISON_STATUS").eqNullSafe(COMPARABLE)


def is_excluded(s: Settings) -> Column:
    return F.col(s.excluded_flag) == 1


def won_by(s: Settings, method: str) -> Column:
    return F.col(s.winner) == method


def selected(series: DataFrame, s: Settings) -> DataFrame:
    """Rows of the configured batches and clients; the filters reach a Parquet scan."""
    if s.batches is not None:
        series = series.filter(F.col("ID_BATCH").isin(list(s.batches)))
    if s.clients is None:
        return series
    return series.filter(F.col("ID_CLIENT").isin(list(s.clients)))


def require_rows(series: DataFrame, s: Settings) -> None:
    """Raise if no row belongs to the configured clients, candidate or not."""
    if selected(series, s).isEmpty():
        raise ValueError(f"The client filter left no row; expected clients: {s.clients}")


def candidates(series: DataFrame, s: Settings) -> DataFrame:
    """Base candidates of the configured clients, with the row-level improvement."""
    improvement = relative_improvement(F.col(s.wape(s.base)), F.col(s.wape(s.challenger)))
    return (
        selected(series, s)
        .filter(F.col("HAS_BASE_CANDIDATE") == 1)
        .withColumn(s.improvement, improvement)
    )


def comparables(candidate_rows: DataFrame) -> DataFrame:
    return candidate_rows.filter(is_comparable())


def code_counts(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    """Number of candidates per combination of client and the codes that reports only count."""
    codes = ["ID_CLIENT", "COMPARISON_STATUS", s.excluded_flag, s.exclusion_reason, s.no_output_reason, s.winner, s.finalist]
    return candidate_rows.groupBy(*codes).agg(F.count("*").alias("ROWS"))


def improvement_by_series(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    """Both WAPE values and the improvement of every candidate."""
    return candidate_rows.select(
        "ID", "ID_CLIENT", "ID_CONFIGURATION", s.wape(s.base), s.wape(s.challenger), s.improvement
    )
