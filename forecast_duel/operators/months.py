"""Month by month: bias, worst month and recomputed error of each series, from arrays of history and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import ratio
from forecast_duel.operators.clients import add_total
from forecast_duel.settings import Settings

# The outcomes of the reconciliation.
OK, REVIEW, UNDEFINED = "OK", "REVISAR", "SIN_DATOS"
TOLERANCE = 1e-6


def month_errors(s: Settings, method: str) -> Column:
    """Forecast less history of every month; a month without history has sold nothing, one without forecast has no error."""
    return F.zip_with(F.array(*s.forecasts(method)), F.array(*s.history), lambda f, h: f - F.coalesce(h, F.lit(0.0)))


def summed(values: Column) -> Column:
    """Sum of the values that are there, in the order of the months; null if there is none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(F.exists(values, lambda x: x.isNotNull()), total)


def worst_month(errors: Column) -> Column:
    """Number of the month with the largest absolute error, the newest one of equals."""
    sizes = F.transform(errors, lambda e: F.abs(e))
    return F.when(F.array_max(sizes).isNotNull(), F.array_position(sizes, F.array_max(sizes)).cast("int"))


def monthly_accuracy(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Bias, worst month, recomputed absolute error and its difference from the given one, per series and method.

    The bias is the summed error over the summed history, null without history. The recomputed error is ``REVISAR`` if it is off
    the given one by more than a millionth, and ``SIN_DATOS`` if either is missing. No row is multiplied: all of it is array functions.
    """
    history = summed(F.array(*s.history))
    figures = []
    for m in (s.base, s.challenger):
        errors = month_errors(s, m)
        again = summed(F.transform(errors, lambda e: F.abs(e)))
        off = again - F.col(s.abs_error(m))
        state = F.when(off.isNull(), UNDEFINED).when(F.abs(off) > TOLERANCE, REVIEW).otherwise(OK)
        figures += [
            ratio(summed(errors), history).alias(f"{m}_SESGO"), worst_month(errors).alias(f"{m}_PEOR_MES"),
            again.alias(f"{m}_ERROR_RECALCULADO"), off.alias(f"{m}_DIFERENCIA"), state.alias(f"{m}_ESTADO")]
    return comparable_rows.select("ID", "ID_CLIENT", "ID_CONFIGURATION", *figures)


def error_reconciliation(comparable_rows: DataFrame, s: Settings) -> DataFrame:
    """Series by outcome of the recomputed error, TOTAL and per client, for both methods."""
    found = monthly_accuracy(comparable_rows, s)
    names = {f"{m}_{state}": F.count_if(F.col(f"{m}_ESTADO") == state) for m in (s.base, s.challenger) for state in (OK, REVIEW, UNDEFINED)}
    counts = found.groupBy("ID_CLIENT").agg(*(c.alias(n) for n, c in names.items()))
    return add_total(counts, [], list(names)).select("ID_CLIENT", *names).orderBy(F.col("ID_CLIENT").try_cast("long").asc_nulls_first(), "ID_CLIENT")
