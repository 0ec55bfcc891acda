"""What changed between two batches, by key, without a join.

Both batches are added up by key in one aggregate: rows on either side and the sums of the rows' 64-bit fingerprints under two seeds. Sums do not depend
on the order of rows, so repeated keys are compared as collections; they are combined before the shuffle, so a key with very many
rows costs no more than another; and grouping takes null keys as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.operators.clients import add_total
from forecast_duel.operators.runs import CONFIGURATION, RUN, compared_values
from forecast_duel.schema import KEY, series_schema
from forecast_duel.settings import Settings

# The kinds of change.
ENTERED, LEFT, SAME, STATUS, VALUES = "ENTRA", "SALE", "IGUAL", "CAMBIA_ESTADO", "CAMBIAN_VALORES"
KINDS = [ENTERED, LEFT, SAME, STATUS, VALUES]


def fingerprint(columns: list[str], seed: int) -> Column:
    """Null and every value of every column count; names and their order are the same on both sides."""
    # A hash passes over nulls, so whether a value is there is hashed as well.
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c).isNull(), F.col(c)))).cast("decimal(38,0)")


def keyed_difference(old: DataFrame, new: DataFrame, key: list[str], values: list[str], status: str, watched: list[str]) -> DataFrame:
    """(key, CAMBIO, N_ANTES, N_AHORA, COLUMNAS) for every key of either table.

    A key entered or left if only one side has it; else its rows are the same, or the collection of its ``status`` values differs,
    or other ``values`` do. COLUMNAS names the ``watched`` columns whose collections of values differ, in that order.
    """
    prints = {"row_1": fingerprint(values, 1), "row_2": fingerprint(values, 2), "status": fingerprint([status], 3)}
    prints |= {f"watched_{i}": fingerprint([c], 4 + i) for i, c in enumerate(watched)}

    def side(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*key, F.lit(sign).alias("sign"), *((c * sign).cast("decimal(38,0)").alias(n) for n, c in prints.items()))

    both = side(old, -1).unionByName(side(new, 1))
    sums = both.groupBy(*key).agg(
        F.count_if(F.col("sign") < 0).alias("N_ANTES"), F.count_if(F.col("sign") > 0).alias("N_AHORA"), *(F.sum(n).alias(n) for n in prints))
    kind = (
        F.when(F.col("N_ANTES") == 0, ENTERED).when(F.col("N_AHORA") == 0, LEFT).when(F.col("status") != 0, STATUS)
        .when((F.col("row_1") != 0) | (F.col("row_2") != 0) | (F.col("N_ANTES") != F.col("N_AHORA")), VALUES).otherwise(SAME))
    there = (F.col("N_ANTES") > 0) & (F.col("N_AHORA") > 0)
    changed = F.concat_ws(", ", *(F.when(there & (F.col(f"watched_{i}") != 0), c) for i, c in enumerate(watched)))
    return sums.select(*key, kind.alias("CAMBIO"), "N_ANTES", "N_AHORA", changed.alias("COLUMNAS"))


def batch_difference(rows: DataFrame, s: Settings, old: object, new: object) -> DataFrame:
    """The configurations of two batches of one table; all columns but the identifiers are compared."""
    values = [c for c in series_schema(s).names if c not in ("ID", *KEY)]
    one, other = (rows.where(F.col(RUN) == b) for b in (old, new))
    return keyed_difference(one, other, CONFIGURATION, values, "COMPARISON_STATUS", compared_values(s))


def batch_changes_by_client(rows: DataFrame, s: Settings, old: object, new: object) -> DataFrame:
    """Number of configurations of each kind of change per client, TOTAL first."""
    found = batch_difference(rows, s, old, new)
    counts = found.groupBy("ID_CLIENT").agg(*(F.count_if(F.col("CAMBIO") == k).alias(f"N_{k}") for k in KINDS))
    return add_total(counts, [], [f"N_{k}" for k in KINDS]).select(
        "ID_CLIENT", *(f"N_{k}" for k in KINDS)).orderBy(F.col("ID_CLIENT").try_cast("long").asc_nulls_first(), "ID_CLIENT")
