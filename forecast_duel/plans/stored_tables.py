"""Intermediate tables in the shared folder of the cluster.

A table that many reports read is computed once, written as Parquet and read back: the
file keeps column pruning and filter pushdown, survives the loss of executors and cuts
the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forecast_duel.settings import Settings
from forecast_duel.sources.parquet_table import read_parquet, write_parquet
from forecast_duel.sources.scratch import CHECKPOINT_SETTING, scratch_path

__all__ = ["CHECKPOINT_SETTING", "StoredTables", "file_states", "scratch_path"]


def file_states(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and time of every file at or below ``paths``: two equal states mean unchanged input."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(conf).listFiles(place, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class StoredTables:
    """Comparison tables that were written once; the owner of this object decides how long they are kept.

    A table is found again by its plan, or by its name, and only while the files it was made from are the same in path,
    length and time. So another folder, query or setting is another table, and a rewritten folder is read again.
    """

    def __init__(self):
        self._tables: list[tuple[str, DataFrame, tuple, DataFrame]] = []
        self._named: dict[tuple, tuple[tuple, DataFrame]] = {}

    def get(self, series: DataFrame, settings: Settings = Settings()) -> DataFrame:
        """``series`` from a written table, written on first use."""
        app = series.sparkSession.sparkContext.applicationId
        state = file_states(series.sparkSession, series.inputFiles())
        for owner, plan, known, table in self._tables:
            if owner == app and known == state and plan.sameSemantics(series):
                return table
        table = self.write(series, settings)
        self._tables.append((app, series, state, table))
        return table

    def of_files(
        self, spark: SparkSession, name: str, paths: list[str], make: Callable[[], DataFrame], settings: Settings = Settings()
    ) -> DataFrame:
        """What ``make`` builds from the files at ``paths``, built and written on first use; a later call only looks at the files."""
        key, state = (spark.sparkContext.applicationId, name, tuple(paths)), file_states(spark, paths)
        if key not in self._named or self._named[key][0] != state:
            self._named[key] = state, self.write(make(), settings)
        return self._named[key][1]

    @staticmethod
    def write(series: DataFrame, settings: Settings) -> DataFrame:
        spark = series.sparkSession
        path = scratch_path(spark, "series")
        write_parquet(series, path)
        return read_parquet(spark, path, settings, schema=series.schema)
