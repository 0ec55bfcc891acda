"""From a comparison table to named reports, stored tables and published blocks."""

from forecast_duel.plans.analyses import ANALYSES, RUN_ANALYSES, batch_changes_by_client, batch_difference, stored_sketches
from forecast_duel.plans.blocks import write_blocks
from forecast_duel.plans.catalogue import BLOCKS, REPORTS
from forecast_duel.plans.comparison import Comparison
from forecast_duel.plans.sql_functions import create_functions
from forecast_duel.plans.stored_tables import StoredTables, scratch_path

__all__ = [
    "ANALYSES", "BLOCKS", "REPORTS", "RUN_ANALYSES", "Comparison", "StoredTables", "batch_changes_by_client", "batch_difference",
    "create_functions", "scratch_path", "stored_sketches", "write_blocks",
]
