"""The evaluation as table functions of Spark SQL, with the clients and the two methods as arguments.

``create_functions`` registers a view of the rows and functions over it for the session; a query then is SQL text alone:

    SELECT * FROM duel_wape('SCP', 'ML', array(10, 20)) WHERE IMPROVEMENT_PCT < 0

The functions are SQL themselves: Catalyst inlines them, drops what a query does not use and pushes its filters down.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from forecast_duel.operators.universe import is_comparable
from forecast_duel.plans.comparison import Comparison
from forecast_duel.settings import TIE, TOTAL

# One row a client first, then TOTAL from those few rows. A null list takes every client, also rows without one.
SELECTED = "SELECT * FROM {rows} WHERE clients IS NULL OR array_contains(clients, CAST(ID_CLIENT AS BIGINT))"
WITH_TOTAL = "SELECT if(grouping(ID_CLIENT) = 1, '{total}', CAST(ID_CLIENT AS STRING)) AS ID_CLIENT"

COVERAGE = f"""CREATE OR REPLACE TEMPORARY FUNCTION {{prefix}}coverage(clients ARRAY<BIGINT> DEFAULT NULL)
RETURNS TABLE (ID_CLIENT STRING, SERIES_CANDIDATAS BIGINT, SERIES_COMPARABLES BIGINT, PCT_COMPARABLES DOUBLE)
RETURN WITH chosen AS ({SELECTED}),
  by_client AS (SELECT ID_CLIENT, count(*) AS n, count_if(comparable) AS m FROM chosen GROUP BY ID_CLIENT)
  {WITH_TOTAL}, sum(n), sum(m), try_divide(CAST(sum(m) AS DOUBLE), CAST(sum(n) AS DOUBLE)) * 100
  FROM by_client GROUP BY ROLLUP (ID_CLIENT)"""

WAPE = f"""CREATE OR REPLACE TEMPORARY FUNCTION {{prefix}}wape(base STRING, challenger STRING, clients ARRAY<BIGINT> DEFAULT NULL)
RETURNS TABLE (ID_CLIENT STRING, N_SERIES BIGINT, N_GANA_BASE BIGINT, N_GANA_CHALLENGER BIGINT, N_TIE BIGINT,
  BASE_WAPE DOUBLE, CHALLENGER_WAPE DOUBLE, IMPROVEMENT_PCT DOUBLE)
RETURN WITH chosen AS ({SELECTED}),
  used AS (SELECT ID_CLIENT, history, winner = base AS b, winner = challenger AS c, winner = '{TIE}' AS t,
    if(map_contains_key(errors, base), errors[base], raise_error(concat('unknown method: ', base))) AS base_error,
    if(map_contains_key(errors, challenger), errors[challenger], raise_error(concat('unknown method: ', challenger))) AS challenger_error
    FROM chosen WHERE comparable),
  by_client AS (SELECT ID_CLIENT, count(*) AS n, count_if(b) AS b, count_if(c) AS c, count_if(t) AS t, sum(history) AS history,
    sum(base_error) AS base_error, sum(challenger_error) AS challenger_error FROM used GROUP BY ID_CLIENT),
  labelled AS ({WITH_TOTAL}, sum(n) AS n, sum(b) AS b, sum(c) AS c, sum(t) AS t,
    try_divide(coalesce(sum(base_error), 0D), coalesce(sum(history), 0D)) AS base_wape,
    try_divide(coalesce(sum(challenger_error), 0D), coalesce(sum(history), 0D)) AS challenger_wape
    FROM by_client GROUP BY ROLLUP (ID_CLIENT))
  SELECT ID_CLIENT, n, b, c, t, base_wape, challenger_wape, nanvl(try_divide(base_wape - challenger_wape, base_wape) * 100, NULL)
  FROM labelled"""


def create_functions(comparison: Comparison, prefix: str = "duel_") -> None:
    """Register ``{prefix}coverage`` and ``{prefix}wape`` over all rows of the comparison, whatever clients it has been set to.

    The batches of its settings stay. A client list is compared row by row and does not skip files; a condition on ID_CLIENT in
    the view's own query does. An unknown method name is an error.
    """
    s = replace(comparison.settings, clients=None)
    errors = F.create_map(*(part for m in (s.base, s.challenger) for part in (F.lit(m), F.col(s.abs_error(m)))))
    view = f"{prefix}series"
    Comparison(comparison.series, s).candidates.select(
        "ID_CLIENT", is_comparable().alias("comparable"), F.col(s.winner).alias("winner"), F.col(s.total_history).alias("history"), errors.alias("errors"),
    ).createOrReplaceTempView(view)
    for text in (COVERAGE, WAPE):
        comparison.series.sparkSession.sql(text.format(prefix=prefix, rows=view, total=TOTAL))
