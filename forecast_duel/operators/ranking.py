"""Best and worst series: a bounded top-n, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.operators.universe import won_by
from forecast_duel.schema import KEY, ranking_columns
from forecast_duel.settings import Settings


def first_rows(rows: DataFrame, order: Column, s: Settings) -> DataFrame:
    """The key and the surrogate id break ties."""
    return rows.orderBy(order, *KEY, "ID").limit(s.top_n).select(*ranking_columns(s))


def top_improvements(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    wins = comparable_rows.filter(won_by(s, s.challenger))
    return first_rows(wins, F.col(s.winner_improvement).desc_nulls_last(), s)


def top_underperformance(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    losses = comparable_rows.filter(won_by(s, s.base))
    return first_rows(losses, F.col(s.improvement).asc_nulls_last(), s)
