"""Ratios that are NULL where they are undefined, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecast_duel.functions.nulls import null_if_nan


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def relative_improvement(base: Column, challenger: Column) -> Column:
    """Share of the base error the challenger saves, as a percentage; undefined for two infinite errors."""
    return null_if_nan(percent(base - challenger, base))
