"""Data-quality checks on the analysed series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.schema import KEY
from forecast_duel.settings import Settings

# State of a check without and with affected rows.
PASSED, FAILED = "OK", "REVISAR"

# Check, metric that counts the affected rows, metric of the rows checked.
CHECKS = [
    ("duplicate_key", "duplicates", "candidates"),
    ("comparable_without_history", "no_history_values", "comparable"),
    ("comparable_without_base_forecast", "no_base_forecast", "comparable"),
    ("comparable_without_challenger_forecast", "no_challenger_forecast", "comparable"),
    ("comparable_without_winner", "no_winner", "comparable"),
    ("comparable_without_wape", "no_wape", "comparable"),
    ("excluded_without_reason", "no_exclusion_reason", "excluded"),
]


def duplicate_rows(candidate_rows: DataFrame) -> DataFrame:
    """Rows beyond the first of their key; nulls in a key are equal."""
    per_key = candidate_rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def data_quality_checks(candidate_rows: DataFrame, totals: DataFrame) -> DataFrame:
    figures = totals.withColumn("duplicates", duplicate_rows(candidate_rows).scalar())
    checks = [
        F.struct(F.lit(name).alias("CHECK"), F.col(count).alias("N_FILAS_AFECTADAS"), F.col(rows).alias("DENOMINADOR"))
        for name, count, rows in CHECKS
    ]
    affected = F.col("N_FILAS_AFECTADAS")
    return figures.select(F.inline(F.array(*checks))).select(
        "*",
        percent(affected, F.col("DENOMINADOR")).alias("PCT"),
        F.when(affected == 0, PASSED).otherwise(FAILED).alias("ESTADO"),
    )


def issue_count(candidate_rows: DataFrame, totals: DataFrame) -> DataFrame:
    return data_quality_checks(candidate_rows, totals).agg(F.count_if(F.col("ESTADO") == FAILED).alias("N_REVISAR"))
