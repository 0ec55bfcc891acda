"""Sink: every block of the document as a table of its own, with an index."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from forecast_duel.plans.catalogue import BLOCKS, Block
from forecast_duel.plans.comparison import Comparison
from forecast_duel.settings import Settings

# Fixed value: note of a block without rows.
NO_DATA = "(sin datos)"
INDEX_SCHEMA = "ORDEN int, HOJA string, BLOQUE string, TITULO string, N_FILAS long, NOTA string"


def note_of(block: Block, rows: int, settings: Settings) -> str | None:
    if not rows:
        return NO_DATA
    if block.report == "exclusion_reconciliation":
        return (f"{settings.status_excluded} solo cuenta las series sin un estado de mayor precedencia; "
                f"{settings.excluded_flag} = 1 cuenta todas las exclusiones.")
    return None


def write_blocks(
    comparison: Comparison, folder: str, file_format: str = "parquet", parallel: int = 8
) -> DataFrame:
    """Write the document's blocks to ``folder/NAME`` and its index to ``folder/index``; return the index.

    A selection without any row fails before anything is written. A block that stands in
    two sheets is written once. A block without rows is written with its schema and marked in the index. Rows are
    counted while they are written. The aggregates that most blocks share, figures
    per client, counts of all codes and statistics of the wins, stay cached meanwhile. Blocks do not depend on
    each other, so ``parallel`` of them run at a time and fill the cluster while the last
    tasks of another finish.
    """
    comparison = comparison.require_rows().sharing_codes()

    def save(table: DataFrame, name: str) -> None:
        writer = table.write.mode("overwrite")
        if file_format == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(file_format).save(f"{folder}/{name}")

    def write(name: str) -> int:
        written = Observation()
        save(comparison.report(name).observe(written, F.count("*").alias("n")), name)
        return written.get["n"]

    shared = [comparison.metrics.persist(), comparison.codes.persist(), comparison.win_stats.persist()]
    names = list(dict.fromkeys(block.report for block in BLOCKS))
    try:
        with ThreadPoolExecutor(parallel) as pool:
            list(pool.map(DataFrame.count, shared))
            rows = dict(zip(names, pool.map(write, names)))
    finally:
        for cached in shared:
            cached.unpersist()
    index = [
        (i, b.sheet, b.report, b.title, rows[b.report], note_of(b, rows[b.report], comparison.settings))
        for i, b in enumerate(BLOCKS, start=1)
    ]
    table = comparison.series.sparkSession.createDataFrame(index, INDEX_SCHEMA)
    save(table.coalesce(1), "index")
    return table
