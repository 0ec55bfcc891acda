"""The evaluation of one comparison table: universes, shared aggregate and reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from forecast_duel.operators import metrics as m
from forecast_duel.operators import statistics, universe
from forecast_duel.settings import Settings
from forecast_duel.sources.parquet_table import conform


class Comparison:
    """Lazy view on a series-comparison table.

    Nothing runs before a report is read, except for ``require_rows``. Every report scans
    the table for its own columns only, so keep the table in Parquet.
    """

    def __init__(self, series: DataFrame, settings: Settings = Settings()):
        self.series = series
        self.settings = settings
        self._codes: DataFrame | None = None

    def require_rows(self) -> Comparison:
        """Fail early if the configured clients have no row at all; runs one limited job."""
        universe.require_rows(self.series, self.settings)
        return self

    @classmethod
    def of(cls, table: DataFrame, settings: Settings = Settings()) -> Comparison:
        """Evaluate a table that does not come from this package's sources: validate it first."""
        return cls(conform(table, settings), settings)

    @cached_property
    def candidates(self) -> DataFrame:
        return universe.candidates(self.series, self.settings)

    @cached_property
    def comparables(self) -> DataFrame:
        return universe.comparables(self.candidates)

    @property
    def codes(self) -> DataFrame:
        """Rows for the reports that only count codes: the candidates, or their shared counts."""
        return self.candidates if self._codes is None else self._codes

    def sharing_codes(self) -> Comparison:
        """The same evaluation with one count of all codes behind those reports.

        It pays off if several of them are read and the counts are cached meanwhile; a
        single report is cheaper without.
        """
        shared = Comparison(self.series, self.settings)
        shared._codes = universe.code_counts(shared.candidates, self.settings)
        return shared

    @cached_property
    def metrics(self) -> DataFrame:
        """One row of additive figures per client present."""
        return m.metrics_by_client(self.candidates, self.settings)

    @cached_property
    def by_label(self) -> DataFrame:
        """The same figures for TOTAL and each configured client, in report order."""
        return m.metrics_by_label(self.metrics, self.settings)

    @cached_property
    def totals(self) -> DataFrame:
        """The same figures over all clients, one row."""
        return m.metric_totals(self.metrics)

    @cached_property
    def win_stats(self) -> DataFrame:
        """Statistics of both methods' wins, at most two rows."""
        return statistics.win_stats(self.comparables, self.settings)

    def create_views(self, prefix: str = "") -> None:
        """Make every report a temporary view, so that SQL can query it by name."""
        from forecast_duel.plans.catalogue import REPORTS

        for name in REPORTS:
            self.report(name).createOrReplaceTempView(prefix + name)

    def report(self, name: str) -> DataFrame:
        from forecast_duel.plans.catalogue import REPORTS

        return REPORTS[name](self)
