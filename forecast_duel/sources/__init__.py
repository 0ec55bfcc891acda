"""Readers that deliver a validated series-comparison table."""

from forecast_duel.sources.csv_table import read_csv
from forecast_duel.sources.parquet_table import read_parquet, write_parquet

__all__ = ["read_csv", "read_parquet", "write_parquet"]
