"""Mergeable sketches of the improvement: states stored per batch and client, quantiles of any set of batches without the rows.

A state is a few kilobytes however many rows it stands for: a KLL sketch of the row improvements and a HyperLogLog sketch
of the configurations. States are made by one map-side combined aggregate and merged by another one over the states alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import null_if_nan
from forecast_duel.operators.clients import add_total
from forecast_duel.settings import TOTAL, Settings

VALUES, CONFIGURATIONS, ROWS = "IMPROVEMENT_STATE", "CONFIGURATION_STATE", "N_ROWS"
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.95)
# Sizes of the sketches: values kept on a level, and the logarithm of the number of registers.
KLL_K, HLL_LOG_K = 800, 12


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of an estimated quantile may lie from the wanted one, as a share of the rows.

    Twice the bound that the sketch's authors give for 99 % of the answers (fixed values 2.296 and 0.9021), about five standard deviations.
    """
    return 2 * 2.296 / k**0.9021


def count_error(log_k: int = HLL_LOG_K) -> float:
    """Five relative standard deviations of an estimated number of configurations."""
    return 5 * 1.04 / 2 ** (log_k / 2)


def sketch_states(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """One row of states for each batch and client; rows without improvement count as rows and configurations only."""
    return comparable_rows.groupBy("ID_BATCH", "ID_CLIENT").agg(
        F.count("*").alias(ROWS),
        F.kll_sketch_agg_double(null_if_nan(F.col(s.improvement)), F.lit(KLL_K)).alias(VALUES),
        F.hll_sketch_agg(F.col("ID_CONFIGURATION").cast("string"), F.lit(HLL_LOG_K)).alias(CONFIGURATIONS))


def store_states(states: DataFrame, folder: str) -> None:
    """Add the states to ``folder``; a batch that is there already is replaced, the other ones stay, so a run can be repeated."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ID_BATCH").parquet(folder)


def read_states(like: DataFrame, folder: str) -> DataFrame:
    """Stored states, with the columns and types of ``like``; a filter on the batch reads the folders of those batches only."""
    return like.sparkSession.read.schema(like.schema).parquet(folder).select(*like.columns)


def merged_states(states: DataFrame, batches: tuple | None = None) -> DataFrame:
    """One row of states for each client and for TOTAL, of the given batches or of all."""
    if batches is not None:
        states = states.where(F.col("ID_BATCH").isin(*batches))

    def merge(rows: DataFrame, *by) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.sum(ROWS).alias(ROWS), F.kll_merge_agg_double(VALUES, F.lit(KLL_K)).alias(VALUES), F.hll_union_agg(CONFIGURATIONS).alias(CONFIGURATIONS))

    by_client = merge(states, F.col("ID_CLIENT").cast("string").alias("ID_CLIENT"))
    total = merge(by_client, F.lit(TOTAL).alias("ID_CLIENT"))
    return total.unionByName(by_client)


def sketch_quantiles(states: DataFrame, batches: tuple | None = None) -> DataFrame:
    """Quantiles of the improvement and number of configurations of each client and TOTAL, read from states alone.

    A client without a single improvement has null quantiles.
    """
    n = F.kll_sketch_get_n_double(VALUES)
    return merged_states(states, batches).select(
        "ID_CLIENT", F.col(ROWS).alias("N_SERIES"), n.alias("N"), F.hll_sketch_estimate(CONFIGURATIONS).alias("N_CONFIGURACIONES"),
        *(F.when(n > 0, F.kll_sketch_get_quantile_double(VALUES, F.lit(p))).alias(f"P{round(100 * p):02d}") for p in PROBABILITIES),
        F.lit(rank_error()).alias("ERROR_DE_RANGO"),
    )


def sketch_audit(comparable_rows: DataFrame, states: DataFrame, s: Settings, batches: tuple | None = None) -> DataFrame:
    """Estimates held against the rows: N_DENTRO of the quantiles have a rank within the stated error, CONFIGURACIONES_DENTRO the number.

    Reads the rows once, twice each (for the client and TOTAL), and counts in one combined aggregate; distinct configurations
    are counted in a second one. It is a test of the states, their readers need no rows.
    """
    if batches is not None:
        comparable_rows = comparable_rows.where(F.col("ID_BATCH").isin(*batches))
    labels = F.explode(F.array(F.lit(TOTAL), F.col("ID_CLIENT").cast("string"))).alias("ID_CLIENT")
    value = null_if_nan(F.col(s.improvement)).alias("value")
    quantiles = sketch_quantiles(states, batches)
    names = [f"P{round(100 * p):02d}" for p in PROBABILITIES]
    rows = comparable_rows.select(labels, value, F.col("ID_CONFIGURATION").alias("configuration")).alias("r")
    sides = rows.join(quantiles.alias("q"), F.col("r.ID_CLIENT").eqNullSafe(F.col("q.ID_CLIENT")))
    counted = sides.groupBy(F.col("r.ID_CLIENT").alias("ID_CLIENT")).agg(
        F.count("*").alias("N_SERIES"), F.count("value").alias("N"),
        *(F.count_if(F.col("value") < F.col(c)).alias(f"below_{c}") for c in names), *(F.count_if(F.col("value") <= F.col(c)).alias(f"upto_{c}") for c in names),
        F.max("N_CONFIGURACIONES").alias("estimate"))
    distinct = rows.groupBy("ID_CLIENT").agg(F.count_distinct("configuration").alias("N_CONFIGURACIONES")).withColumnRenamed("ID_CLIENT", "label")
    inside = [
        (F.col(f"below_{c}") <= (p + rank_error()) * F.col("N")) & (F.col(f"upto_{c}") >= (p - rank_error()) * F.col("N"))
        for c, p in zip(names, PROBABILITIES)]
    return counted.join(distinct, F.col("ID_CLIENT").eqNullSafe(F.col("label"))).select(
        "ID_CLIENT", "N_SERIES", "N", "N_CONFIGURACIONES", sum((i.cast("long") for i in inside), F.lit(0).cast("long")).alias("N_DENTRO"),
        (F.abs(F.col("estimate") - F.col("N_CONFIGURACIONES")) <= count_error() * F.col("N_CONFIGURACIONES")).alias("CONFIGURACIONES_DENTRO"))
