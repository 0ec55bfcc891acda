"""Value counts with percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.operators.clients import add_total, in_report_order
from forecast_duel.settings import Settings


# Column of a pre-counted table: how many rows each of its rows stands for.
ROWS = "ROWS"


def number_of_rows(rows: DataFrame) -> Column:
    """Aggregate that counts rows, also those of a pre-counted table."""
    return F.sum(ROWS) if ROWS in rows.columns else F.count("*")


def value_counts(rows: DataFrame, column: str, null_label: str | None = None, drop_null: bool = False) -> DataFrame:
    """Count and share of each value, most frequent first; null is a value of its own.

    With ``drop_null`` the null rows leave the list and the denominator. ``null_label``
    only renders the null value.
    """
    if drop_null:
        rows = rows.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(number_of_rows(rows).alias("N"))
    return counts.select(
        shown(column, null_label), "N", percent(F.col("N"), sum_of(counts, "N")).alias("PCT")
    ).orderBy(*most_frequent(column))


def shown(column: str, null_label: str | None) -> Column:
    """The column as reported: null, or the text that stands for it."""
    if null_label is None:
        return F.col(column)
    return F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias(column)


def sum_of(counts: DataFrame, name: str) -> Column:
    """Grand total as a scalar subquery; it reuses the shuffle behind ``counts``."""
    return counts.agg(F.sum(name)).scalar()


def most_frequent(*values: str) -> list[Column]:
    return [F.col("N").desc(), *(F.col(v).asc_nulls_last() for v in values)]


def share_of_client(counts: DataFrame, s: Settings, name: str) -> DataFrame:
    """Add the share of ``N`` in its client; the client sums reuse the shuffle of the counts."""
    whole = counts.groupBy(F.col("ID_CLIENT").alias("client")).agg(F.sum("N").alias("whole"))
    return (
        counts.join(whole, F.col("ID_CLIENT").eqNullSafe(F.col("client")))
        .withColumn(name, percent(F.col("N"), F.col("whole")))
        .drop("client", "whole")
    )


def distribution_by_client(rows: DataFrame, column: str, s: Settings, share_name: str) -> DataFrame:
    """Distribution for TOTAL and each client; null values count only in the denominator."""
    counts = rows.groupBy("ID_CLIENT", column).agg(number_of_rows(rows).alias("N"))
    labelled = add_total(counts, [column], ["N"])
    shares = share_of_client(labelled, s, share_name).filter(F.col(column).isNotNull())
    return in_report_order(shares.select("ID_CLIENT", column, "N", share_name), s, *most_frequent(column))
