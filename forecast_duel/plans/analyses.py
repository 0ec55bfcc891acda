"""Analyses beyond the published document, by name.

Those that run over ordered rows write their ranges to the shared folder when they are called; the other ones are plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from forecast_duel.operators import bands, bootstrap, concentration, difference, hierarchy, months, runs, sketches
from forecast_duel.plans.comparison import Comparison
from forecast_duel.sources.scratch import scratch_path

# Analyses of one evaluation.
ANALYSES: dict[str, Callable[[Comparison], DataFrame]] = {
    "value_hierarchy": lambda c: hierarchy.value_hierarchy(c.candidates, c.settings),
    "error_concentration": lambda c: concentration.error_concentration(c.comparables, c.settings),
    "concentration_by_client": lambda c: concentration.concentration_by_client(c.comparables, c.settings),
    "wins_by_volume_band": lambda c: bands.wins_by_volume_band(c.comparables, c.settings),
    "monthly_accuracy": lambda c: months.monthly_accuracy(c.comparables, c.settings),
    "error_reconciliation": lambda c: months.error_reconciliation(c.comparables, c.settings),
    "improvement_interval": lambda c: bootstrap.improvement_interval(c.comparables, c.settings),
}

# Analyses of a table with several batches.
RUN_ANALYSES: dict[str, Callable[[Comparison], DataFrame]] = {
    "previous_runs": lambda c: runs.previous_runs(c.candidates, c.settings),
    "run_changes_by_client": lambda c: runs.run_changes_by_client(c.candidates, c.settings),
    "sketch_audit": lambda c: sketches.sketch_audit(c.comparables, stored_sketches(c), c.settings),
}


def stored_sketches(c: Comparison, folder: str | None = None) -> DataFrame:
    """The states of each batch and client, added to ``folder`` (a new one in the shared folder by default) and read back."""
    states = sketches.sketch_states(c.comparables, c.settings)
    folder = folder or scratch_path(c.series.sparkSession, "sketches")
    sketches.store_states(states, folder)
    return sketches.read_states(states, folder)


def batch_difference(c: Comparison, old: object, new: object) -> DataFrame:
    """What became of each configuration between two batches, see ``operators.difference``."""
    return difference.batch_difference(c.candidates, c.settings, old, new)


def batch_changes_by_client(c: Comparison, old: object, new: object) -> DataFrame:
    return difference.batch_changes_by_client(c.candidates, c.settings, old, new)
