"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: below spark.checkpoint.dir, else below the warehouse."""
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/forecast-duel/{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once as Parquet and read back: its lineage ends there."""
    spark = table.sparkSession
    path = scratch_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
