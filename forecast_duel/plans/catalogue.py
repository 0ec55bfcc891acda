"""Every report by name, and the blocks of the published document."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from forecast_duel.operators import charts, coverage, profiles, quality, ranking, report, statistics, universe, winners
from forecast_duel.plans.comparison import Comparison

Report = Callable[[Comparison], DataFrame]


def over_candidates(build) -> Report:
    return lambda c: build(c.candidates, c.settings)


def over_codes(build) -> Report:
    return lambda c: build(c.codes, c.settings)


def over_comparable_codes(build) -> Report:
    return lambda c: build(universe.comparables(c.codes), c.settings)


def over_comparables(build) -> Report:
    return lambda c: build(c.comparables, c.settings)


def over_labels(build) -> Report:
    return lambda c: build(c.by_label, c.settings)


def over_totals(build) -> Report:
    return lambda c: build(c.totals, c.settings)


REPORTS: dict[str, Report] = {
    # universes
    "candidates": lambda c: c.candidates,
    "comparables": lambda c: c.comparables,
    "ml_improvement_by_series": over_candidates(universe.improvement_by_series),
    # coverage
    "coverage_by_client": over_labels(coverage.coverage_by_client),
    "coverage_wide": over_labels(coverage.coverage_wide),
    "status_distribution": over_codes(coverage.status_distribution),
    "status_with_meaning": over_codes(coverage.status_with_meaning),
    "exclusion_reasons": over_codes(coverage.exclusion_reasons),
    "exclusion_reasons_by_client": over_codes(coverage.exclusion_reasons_by_client),
    "scp_no_output_reasons": over_codes(coverage.no_output_reasons),
    "excluded_flag_distribution": over_codes(coverage.excluded_flag_distribution),
    "exclusion_reconciliation": over_totals(coverage.exclusion_reconciliation),
    # performance
    "global_summary": over_totals(winners.global_summary),
    "winner_distribution": over_comparable_codes(winners.winner_distribution),
    "finalist_distribution": over_comparable_codes(winners.finalist_distribution),
    "wape_impact": over_labels(winners.wape_impact),
    "ml_improvement_stats": over_comparables(statistics.improvement_stats),
    "ml_win_summary": lambda c: winners.win_summary(c.totals, c.settings, c.settings.challenger),
    "ml_win_improvement_stats": lambda c: statistics.stats_of_wins(c.win_stats, c.settings.challenger),
    "ml_wins_by_client": lambda c: winners.wins_by_client(c.metrics, c.settings, c.settings.challenger),
    "ml_win_profiles": lambda c: profiles.win_profile(c.comparables, c.settings, c.settings.challenger),
    "scp_win_summary": lambda c: winners.win_summary(c.totals, c.settings, c.settings.base),
    "scp_win_improvement_stats": lambda c: statistics.stats_of_wins(c.win_stats, c.settings.base),
    "scp_wins_by_client": lambda c: winners.wins_by_client(c.metrics, c.settings, c.settings.base),
    "scp_win_profiles": lambda c: profiles.win_profile(c.comparables, c.settings, c.settings.base),
    "win_profiles_by_client": over_comparables(profiles.win_profiles_by_client),
    "value_by_dimension": over_comparables(profiles.value_by_dimension),
    "top_winner_models": over_comparables(winners.top_winner_models),
    "top_ml_improvements": over_comparables(ranking.top_improvements),
    "top_ml_underperformance": over_comparables(ranking.top_underperformance),
    # data quality
    "data_quality_checks": lambda c: quality.data_quality_checks(c.candidates, c.totals),
    "dq_issue_count": lambda c: quality.issue_count(c.candidates, c.totals),
    # figures and text
    "chart_winners": over_totals(charts.chart_winners),
    "chart_wape": over_totals(charts.chart_wape),
    "chart_coverage": over_labels(charts.chart_coverage),
    "improvement_histogram": over_comparables(charts.improvement_histogram),
    "verdict": lambda c: report.verdict(c.win_stats, c.totals, c.settings),
    "formatted_kpis": over_labels(report.formatted_kpis),
}


class Block(NamedTuple):
    sheet: str
    report: str
    title: str


# The published document. The sheet names.
BLOCKS = [
    Block("01_global_summary", "global_summary", "Executive summary"),
    Block("02_client_coverage", "coverage_by_client", "Coverage by client"),
    Block("03_status_distribution", "status_distribution", "Comparison status, total and by client"),
    Block("03_status_distribution", "exclusion_reasons", "Exclusion reasons of the challenger"),
    Block("03_status_distribution", "scp_no_output_reasons", "Reasons for missing base output"),
    Block("04_winner_distribution", "winner_distribution", "Winners, total and by client"),
    Block("05_wape_impact", "wape_impact", "Volume-weighted WAPE, total and by client"),
    Block("06_ml_improvement_stats", "ml_improvement_stats", "Improvement by series, total and by client"),
    Block("07_ml_winning_models", "ml_win_summary", "Series won by the challenger"),
    Block("07_ml_winning_models", "ml_win_improvement_stats", "Improvement where the challenger wins"),
    Block("07_ml_winning_models", "ml_wins_by_client", "Challenger wins by client"),
    Block("07_ml_winning_models", "ml_win_profiles", "Models and classes where the challenger wins"),
    Block("08_scp_wins_analysis", "scp_win_summary", "Series won by the base method"),
    Block("08_scp_wins_analysis", "scp_win_improvement_stats", "Improvement where the base wins (negative)"),
    Block("08_scp_wins_analysis", "scp_wins_by_client", "Base wins by client"),
    Block("08_scp_wins_analysis", "scp_win_profiles", "Models and classes where the base wins"),
    Block("09_exclusions", "status_distribution", "Comparison status, total and by client"),
    Block("09_exclusions", "exclusion_reconciliation", "Exclusions by status and by flag"),
    Block("09_exclusions", "exclusion_reasons", "Exclusion reasons of the challenger"),
    Block("09_exclusions", "exclusion_reasons_by_client", "Exclusion reasons by client"),
    Block("09_exclusions", "scp_no_output_reasons", "Reasons for missing base output"),
    Block("10_top_ml_improvements", "top_ml_improvements", "Largest improvements of the challenger"),
    Block("11_top_ml_underperformance", "top_ml_underperformance", "Worst series of the challenger"),
    Block("12_data_quality_checks", "data_quality_checks", "Data-quality checks"),
]
