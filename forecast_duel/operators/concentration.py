"""How few series hold most of the error: running totals from the largest error down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import percent
from forecast_duel.operators.ordered import running_totals
from forecast_duel.schema import KEY
from forecast_duel.settings import TOTAL, Settings

# Fixed value: the share of the error that the listed series hold, as a fraction.
SHARE = (8, 10)
# Errors are added up as decimals, so the set is exact and the same for any partitioning.
ERROR_TYPE = "decimal(28,6)"


def errors_by_method(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """(METODO, ERROR) of every comparable series and method; series without error, or with an infinite one, hold no share."""
    errors = {m: F.col(s.abs_error(m)).try_cast(ERROR_TYPE) for m in (s.base, s.challenger)}
    both = F.inline(F.array(*(F.struct(F.lit(m).alias("METODO"), e.alias("ERROR")) for m, e in errors.items())))
    return comparable_rows.select(both, "ID", *KEY).where("ERROR > 0")


def accumulated(errors: DataFrame, by: list[str], share: tuple[int, int]) -> DataFrame:
    """Rows with ACUMULADO, the group's whole error and whether the row belongs to the smallest set with ``share`` of it.

    Ties of error are broken by the key. The wholes are a row a group, methods or methods and clients: adaptive execution broadcasts them if
    their measured size allows, and splits the rows of a hot group if not.
    """
    order = [F.col("ERROR").desc(), *(F.col(c).asc_nulls_first() for c in (*KEY, "ID"))]
    running = running_totals(errors, order, {"ERROR": "ACUMULADO"}, by)
    whole = errors.groupBy(*(F.col(c).alias(f"g_{c}") for c in by)).agg(F.sum("ERROR").alias("whole"))
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in by]
    joined = running.join(whole, same).drop(*(f"g_{c}" for c in by))
    above, below = share
    return joined.withColumn("within", (F.col("ACUMULADO") - F.col("ERROR")) * below < F.col("whole") * above)


def error_concentration(comparable_rows: DataFrame, s: Settings, share: tuple[int, int] = SHARE) -> DataFrame:
    """The smallest set of series that holds ``share`` of each method's error, largest error first."""
    kept = accumulated(errors_by_method(comparable_rows, s), ["METODO"], share).where("within")
    return kept.select(
        "METODO", "ID_CLIENT", "ID_CONFIGURATION", "ID", number("ERROR"), number("ACUMULADO"),
        percent(F.col("ACUMULADO"), F.col("whole")).alias("PCT_ACUMULADO"),
    ).orderBy("METODO", "ACUMULADO", "ID")


def number(column: str) -> Column:
    return F.col(column).cast("double").alias(column)


def concentration_by_client(comparable_rows: DataFrame, s: Settings, share: tuple[int, int] = SHARE) -> DataFrame:
    """How many series hold ``share`` of the error, per method for all clients together and within each client."""
    errors = errors_by_method(comparable_rows, s)
    figures = [F.count("*").alias("N_SERIES"), F.count_if("within").alias("N_CONCENTRAN"), F.first("whole").alias("whole")]
    total = accumulated(errors, ["METODO"], share).groupBy("METODO").agg(*figures).withColumn("ID_CLIENT", F.lit(TOTAL))
    own = accumulated(errors, ["METODO", "ID_CLIENT"], share).groupBy("METODO", "ID_CLIENT").agg(*figures)
    both = total.unionByName(own.withColumn("ID_CLIENT", F.col("ID_CLIENT").cast("string")))
    return both.select(
        "METODO", "ID_CLIENT", F.col("whole").cast("double").alias("ERROR_TOTAL"), "N_SERIES", "N_CONCENTRAN",
        percent(F.col("N_CONCENTRAN"), F.col("N_SERIES")).alias("PCT_SERIES"),
    ).orderBy("METODO", F.col("ID_CLIENT").try_cast("long").asc_nulls_first(), "ID_CLIENT")
