"""spark-submit run_comparison.py INPUT OUTPUT [CLIENT ...]: evaluate a comparison table and write the document.

INPUT is a folder or file of CSV (by its ending) or Parquet. Without clients every row is taken. An error is printed and
the exit code is 1.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from forecast_duel import Comparison, Settings, write_blocks
from forecast_duel.plans import StoredTables
from forecast_duel.sources import read_csv, read_parquet


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__)
        return 1
    source, target, *clients = arguments
    try:
        settings = Settings(clients=tuple(map(int, clients)) or None)
        spark = SparkSession.builder.appName("forecast comparison").getOrCreate()
        if source.rstrip("/").endswith(".csv"):  # parsed once; the blocks read the Parquet copy
            series = StoredTables.write(read_csv(spark, source, settings), settings)
        else:
            series = read_parquet(spark, source, settings)
        write_blocks(Comparison(series, settings), target).show(100, truncate=False)
    except Exception as error:  # noqa: BLE001
        print(f"ERROR: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
