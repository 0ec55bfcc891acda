"""Column expressions shared by the operators; all of them run inside the JVM."""

from forecast_duel.functions.nulls import all_null, null_if_nan, null_tokens
from forecast_duel.functions.ratios import percent, ratio, relative_improvement
from forecast_duel.functions.text import format_count, format_percent

__all__ = [
    "all_null", "format_count", "format_percent", "null_if_nan", "null_tokens",
    "percent", "ratio", "relative_improvement",
]
