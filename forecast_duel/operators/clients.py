"""The report's rows: TOTAL first, then every configured client, present or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecast_duel.settings import TOTAL, Settings


def client_label(client: Column, is_total: Column) -> Column:
    return F.when(is_total, TOTAL).otherwise(client.cast("string"))


def add_total(by_client: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Roll already aggregated client rows up to a TOTAL; the label becomes text."""
    total = F.grouping("ID_CLIENT") == 1
    return (
        by_client.groupingSets([["ID_CLIENT", *keys], keys], "ID_CLIENT", *keys)
        .agg(*(F.sum(c).alias(c) for c in sums), client_label(F.col("ID_CLIENT"), total).alias("label"))
        .drop("ID_CLIENT")
        .withColumnRenamed("label", "ID_CLIENT")
    )


def on_spine(rows: DataFrame, s: Settings, label: str = "ID_CLIENT", total: bool = True) -> DataFrame:
    """One row per label, also for labels without data, in report order.

    ``rows`` has at most one row per label.
    """
    spark = rows.sparkSession
    if s.clients is not None:
        return spine_of(spark, s, label, total).join(rows, label, "left").orderBy("position").drop("position")
    if total:
        rows = spine_of(spark, Settings(clients=()), label, True).join(rows, label, "full").drop("position")
    return rows.orderBy(*label_order(s, label))


def spine_of(spark: SparkSession, s: Settings, label: str, total: bool) -> DataFrame:
    """The labels in one partition, so that sorting a join with them needs no shuffle."""
    names, kind = (s.labels, "string") if total else (list(s.clients), "bigint")
    listed = F.lit(names).cast(f"array<{kind}>") if names else F.array().cast(f"array<{kind}>")
    return spark.range(0, 1, 1, 1).select(F.posexplode(listed).alias("position", label))


def in_report_order(rows: DataFrame, s: Settings, *then: Column, first: tuple[str, ...] = ()) -> DataFrame:
    """Sort by ``first``, then by client as configured with TOTAL ahead, then by ``then``."""
    return rows.orderBy(*first, *label_order(s), *then)


def label_order(s: Settings, label: str = "ID_CLIENT") -> list[Column]:
    name = F.col(label).cast("string")
    if s.clients is None:
        return [~name.eqNullSafe(TOTAL), F.col(label).try_cast("long").asc_nulls_last()]
    return [F.array_position(F.lit(s.labels), name)]
