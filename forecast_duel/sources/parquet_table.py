"""Parquet source and sink: the storage form for large tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.functions import null_if_nan
from forecast_duel.schema import require_columns, series_schema
from forecast_duel.settings import Settings


def read_parquet(
    spark: SparkSession,
    path: str | list[str],
    settings: Settings = Settings(),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read a comparison table; client, flag and status filters reach the scan.

    Give ``schema`` where the type of the batch directories must not be guessed.
    """
    paths = [path] if isinstance(path, str) else path
    reader = spark.read if schema is None else spark.read.schema(schema)
    return conform(reader.parquet(*paths), settings)


def conform(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Validate the columns, put them in declared order and leave NULL as the only missing value.

    Identifiers keep the type they are stored with.
    """
    require_columns(df, settings)
    stored = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return null_if_nan(c.cast("double")).alias(field.name)
        if isinstance(field.dataType, T.StringType) or stored[field.name] == field.dataType:
            return c
        return c.cast(field.dataType).alias(field.name)

    return df.select(*(column(f) for f in series_schema(settings)))


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", rebalance: bool = False
) -> None:
    """Store a comparison table so that later reads prune by batch, client and status.

    One directory per batch; rows of a file are sorted by client and status, which gives
    row groups narrow min/max ranges without another shuffle. Where the input mixes many
    batches, every task would write a small file for each: ``rebalance`` shuffles by
    batch first and leaves it to adaptive execution to split a large batch into several
    files and to put small ones together.
    """
    if rebalance:
        df = df.hint("rebalance", "ID_BATCH")
    order = ["ID_BATCH", "ID_CLIENT", "COMPARISON_STATUS"]
    df.sortWithinPartitions(*order).write.mode(mode).partitionBy("ID_BATCH").parquet(path)
