"""CSV source: columns matched by name, missing-value texts, declared types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.functions import null_if_nan, null_tokens
from forecast_duel.schema import require_columns, series_schema
from forecast_duel.settings import Settings


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    settings: Settings = Settings(),
    multi_line: bool = False,
) -> DataFrame:
    """Read the comparison table from UTF-8 CSV files with a header line.

    Every column is read as text under the header's own names and then selected by
    name, so column order and extra columns do not matter; files whose headers disagree
    are refused. Nothing is misread silently: a record with too few or too many fields
    fails the query, and so does a text that does not fit the declared type, with the
    column and the value, all in the same pass that reads the file.

    Spark splits each file. A record torn by a line break inside a quoted field is then one with too few
    fields and fails; ``multi_line=True`` reads such files, at the price of one task per file.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)  # a pruned parser does not count the fields
        .csv(path)
    )
    require_columns(raw, settings)
    return raw.select(*(typed(f.name, f.dataType) for f in series_schema(settings)))


def typed(name: str, kind: T.DataType) -> Column:
    text = null_tokens(F.col(f"`{name}`"))
    if isinstance(kind, T.StringType):
        return text.alias(name)
    number = text.try_cast("double")
    if isinstance(kind, T.DoubleType):
        value = null_if_nan(number)
        fits = number.isNotNull()
    else:
        # A nullable integer column is often written as 1.0, a flag as True.
        word = F.lower(text)
        flag = F.when(word == "true", 1).when(word == "false", 0)
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        value = F.coalesce(text.try_cast(kind), whole, flag)
        fits = value.isNotNull()
    complaint = F.concat(F.lit(f"Column {name} holds a value that is not {kind.simpleString()}: "), text)
    checked = F.when(fits, value).otherwise(F.raise_error(complaint).cast(kind))
    return F.when(text.isNotNull(), checked).alias(name)
