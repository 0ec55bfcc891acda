"""How the evaluation of a configuration changes from one run to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import ratio
from forecast_duel.operators.clients import add_total
from forecast_duel.operators.ordered import asof_join
from forecast_duel.settings import COMPARABLE, Settings

# A configuration keeps its client and its number through all runs; runs are ordered by their batch.
CONFIGURATION, RUN, BEFORE = ["ID_CLIENT", "ID_CONFIGURATION"], "ID_BATCH", "ANTERIOR_"


def compared_values(s: Settings) -> list[str]:
    return ["COMPARISON_STATUS", s.winner, s.wape(s.base), s.wape(s.challenger), s.total_history, s.abs_error(s.base), s.abs_error(s.challenger)]


def with_previous_run(rows: DataFrame, s: Settings) -> DataFrame:
    """Every series of every run beside the latest earlier run of its configuration; ``rows`` holds several batches.

    A run may have been left out of any number of batches in between. Repeated series of one run all stand beside the same
    earlier one; of repeated series of an earlier run the one with the smallest surrogate id is taken. A configuration with very many
    runs, or many rows without a number, is cut into ranges of runs, see ``asof_join``.
    """
    values = compared_values(s)
    narrow = rows.select("ID", RUN, *CONFIGURATION, *values)
    return asof_join(narrow, narrow, CONFIGURATION, RUN, values, BEFORE, tie="ID")


def previous_runs(rows: DataFrame, s: Settings) -> DataFrame:
    """Status, winner and errors of each series with those of the run before, and how the WAPE of both methods moved."""
    beside = with_previous_run(rows, s)
    shown = ["COMPARISON_STATUS", s.winner, s.wape(s.base), s.wape(s.challenger)]
    moves = [(F.col(c) - F.col(BEFORE + c)).alias(f"CAMBIO_{c}") for c in (s.wape(s.base), s.wape(s.challenger))]
    return beside.select("ID", RUN, *CONFIGURATION, BEFORE + RUN, *(c for v in shown for c in (v, BEFORE + v)), *moves)


def run_changes_by_client(rows: DataFrame, s: Settings) -> DataFrame:
    """Per run and client, and per run over all clients: kept and changed winners, and the weighted WAPE now and before.

    Winners and WAPE are compared over the series that are comparable in both runs; a series without winner has neither kept nor
    changed it. Null where nothing was compared.
    """
    beside = with_previous_run(rows, s)
    both = (F.col("COMPARISON_STATUS") == COMPARABLE) & (F.col(f"{BEFORE}COMPARISON_STATUS") == COMPARABLE)
    now, then = F.col(s.winner), F.col(BEFORE + s.winner)

    def volume(column: str) -> Column:
        return F.coalesce(F.sum(F.when(both, F.col(column))), F.lit(0.0))

    sums = {
        "N_SERIES": F.count("*"),
        "N_CON_ANTERIOR": F.count(BEFORE + RUN),
        "N_COMPARABLES_AMBAS": F.count_if(both),
        "N_MISMO_GANADOR": F.count_if(both & (now == then)),
        f"N_PASA_A_{s.challenger}": F.count_if(both & (now != then) & (now == s.challenger)),
        f"N_PASA_A_{s.base}": F.count_if(both & (now != then) & (now == s.base)),
        "N_OTRO_CAMBIO": F.count_if(both & (now != then) & ~now.isin(s.base, s.challenger)),
    }
    measures = {"history": s.total_history, "base": s.abs_error(s.base), "challenger": s.abs_error(s.challenger)}
    hidden = {f"{when}_{m}": volume(prefix + c) for when, prefix in (("now", ""), ("then", BEFORE)) for m, c in measures.items()}
    by_client = beside.groupBy(RUN, "ID_CLIENT").agg(*(c.alias(n) for n, c in (sums | hidden).items()))
    rolled = add_total(by_client, [RUN], [*sums, *hidden])

    def wape(when: str, method: str) -> Column:
        return ratio(F.col(f"{when}_{method}"), F.col(f"{when}_history"))

    figures = []
    for method, name in (("base", s.base), ("challenger", s.challenger)):
        figures += [wape("then", method).alias(f"{BEFORE}{name}_WAPE"), wape("now", method).alias(f"{name}_WAPE"),
                    (wape("now", method) - wape("then", method)).alias(f"CAMBIO_{name}_WAPE")]
    return rolled.select(RUN, "ID_CLIENT", *sums, *figures).orderBy(RUN, F.col("ID_CLIENT").try_cast("long").asc_nulls_first(), "ID_CLIENT")
