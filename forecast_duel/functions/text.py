"""Number rendering of the executive report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text of an undefined figure, and the thousands separator.
UNDEFINED = "n/d"
THOUSANDS = "."


def format_percent(value: Column) -> Column:
    """One decimal and a percent sign, half to even, no thousands separator."""
    digits = F.translate(F.format_number(value, 1), ",", "")
    return F.coalesce(F.concat(digits, F.lit("%")), F.lit(UNDEFINED))


def format_count(value: Column) -> Column:
    return F.coalesce(F.translate(F.format_number(value, 0), ",", THOUSANDS), F.lit(UNDEFINED))
