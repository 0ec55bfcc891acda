"""Every additive figure of the evaluation in one aggregate over the candidates.

The reports select from this table; Catalyst drops the aggregates and the input columns a
report does not use. Rows are summed on the map side first, so a client with most of the
rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import all_null, percent, ratio, relative_improvement
from forecast_duel.operators.clients import add_total, on_spine
from forecast_duel.operators.universe import is_comparable, is_excluded, won_by
from forecast_duel.settings import TIE, Settings


def additive_metrics(s: Settings) -> dict[str, Column]:
    comparable, status = is_comparable(), F.col("COMPARISON_STATUS")

    def over_comparable(condition: Column) -> Column:
        return F.count_if(comparable & condition)

    def volume(column: str) -> Column:
        return F.sum(F.when(comparable, summand(column, s)))

    either_wape_null = F.col(s.wape(s.base)).isNull() | F.col(s.wape(s.challenger)).isNull()
    return {
        "candidates": F.count("*"),
        "comparable": F.count_if(comparable),
        "excluded": F.count_if(is_excluded(s)),
        "status_excluded": F.count_if(status == s.status_excluded),
        "status_missing_base": F.count_if(status == s.status_missing(s.base)),
        "status_missing_challenger": F.count_if(status == s.status_missing(s.challenger)),
        "status_missing_both": F.count_if(status == s.status_missing_both),
        "status_no_history": F.count_if(status == "NOT_COMPARABLE_NO_HISTORY"),
        "won_by_challenger": over_comparable(won_by(s, s.challenger)),
        "won_by_base": over_comparable(won_by(s, s.base)),
        "tied": over_comparable(won_by(s, TIE)),
        "history": volume(s.total_history),
        "base_error": volume(s.abs_error(s.base)),
        "challenger_error": volume(s.abs_error(s.challenger)),
        "no_history_values": over_comparable(all_null(s.history)),
        "no_base_forecast": over_comparable(all_null(s.forecasts(s.base))),
        "no_challenger_forecast": over_comparable(all_null(s.forecasts(s.challenger))),
        "no_winner": over_comparable(F.col(s.winner).isNull()),
        "no_wape": over_comparable(either_wape_null),
        "no_exclusion_reason": F.count_if(is_excluded(s) & F.col(s.exclusion_reason).isNull()),
    }


def summand(column: str, s: Settings) -> Column:
    value = F.col(column)
    return value if s.sum_scale is None else value.cast(f"decimal(28,{s.sum_scale})")


def metrics_by_client(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    return candidate_rows.groupBy("ID_CLIENT").agg(
        *(column.alias(name) for name, column in additive_metrics(s).items())
    )


def metrics_by_label(metrics: DataFrame, s: Settings) -> DataFrame:
    """The metrics of TOTAL and each configured client; TOTAL sums the client rows."""
    return on_spine(add_total(metrics, [], metric_names(metrics)), s)


def metric_names(metrics: DataFrame) -> list[str]:
    return [c for c in metrics.columns if c != "ID_CLIENT"]


def zero_if_absent(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def metric_totals(metrics: DataFrame) -> DataFrame:
    """One row, also for no input; counts and sums of nothing are 0."""
    return metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in metric_names(metrics)))


def weighted_wape() -> tuple[Column, Column, Column]:
    """Volume-weighted WAPE of both methods and the relative improvement.

    The three sums skip nulls independently; an error that is null in every row counts as
    0, a history of 0 leaves all three undefined.
    """
    history = zero_if_absent("history")
    base = ratio(zero_if_absent("base_error"), history)
    challenger = ratio(zero_if_absent("challenger_error"), history)
    return base, challenger, relative_improvement(base, challenger)


def share(part: str, whole: str) -> Column:
    return percent(zero_if_absent(part), zero_if_absent(whole))
