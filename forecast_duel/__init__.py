"""Evaluation of two competing forecasting methods over large collections of series."""

from forecast_duel.plans import BLOCKS, REPORTS, Comparison, write_blocks
from forecast_duel.settings import Settings

__all__ = ["BLOCKS", "REPORTS", "Comparison", "Settings", "write_blocks"]
