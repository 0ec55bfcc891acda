"""One missing value: NaN and the CSV's missing-value texts become NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecast_duel.schema import NA_TOKENS


def null_if_nan(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def null_tokens(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def all_null(columns: Iterable[str]) -> Column:
    return F.coalesce(*columns).isNull()
