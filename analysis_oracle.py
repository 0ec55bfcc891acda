"""SQL for the analyses beyond the document, run by DuckDB on the same tables."""

from __future__ import annotations

from math import exp

from duel_oracle import CLIENTS, KEY, KEY_ORDER, UNIVERSES, series, universes

RUNS = 3


def run(back: int) -> str:
    return f"""(WITH {series(back)} SELECT * REPLACE (CAST({RUNS - back} AS BIGINT) AS "ID_BATCH") FROM series WHERE "ID_CONFIGURATION" % 7 <> {back})"""


RUN_UNIVERSES = universes(CLIENTS, "series AS (" + " UNION ALL ".join(f"SELECT * FROM {run(b)}" for b in range(RUNS)) + ")")

LEVELS = [f'"VALUE_LEVEL_{i}"' for i in range(1, 6)]


def ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


HIERARCHY = f"""SELECT 5 - bit_count(CAST(GROUPING({", ".join(LEVELS)}) AS BIGINT)) AS nivel, {", ".join(LEVELS)}, count(*) AS n, count(*) FILTER (WHERE c) AS comparable,
    count(*) FILTER (WHERE c AND "WINNER_METHOD_6M" = 'ML') AS ml, count(*) FILTER (WHERE c AND "WINNER_METHOD_6M" = 'SCP') AS scp,
    count(*) FILTER (WHERE c AND "WINNER_METHOD_6M" = 'TIE') AS tie, coalesce(sum("TOTAL_HISTORY_6M") FILTER (WHERE c), 0) AS history,
    coalesce(sum("SCP_TOTAL_ABS_ERROR_6M") FILTER (WHERE c), 0) AS base, coalesce(sum("ML_TOTAL_ABS_ERROR_6M") FILTER (WHERE c), 0) AS challenger
    FROM (SELECT *, coalesce("COMPARISON_STATUS" = 'COMPARABLE', false) AS c FROM sub) GROUP BY ROLLUP ({", ".join(LEVELS)})"""

VALUE_HIERARCHY = f"""SELECT CAST(nivel AS INTEGER) AS "NIVEL", {", ".join(LEVELS)}, n AS "SERIES_CANDIDATAS", comparable AS "SERIES_COMPARABLES",
    {ratio("comparable", "n")} * 100 AS "PCT_COMPARABLES", ml AS "N_GANA_ML", scp AS "N_GANA_SCP", tie AS "N_TIE",
    {ratio("ml", "comparable")} * 100 AS "PCT_GANA_ML", {ratio("base", "history")} AS "SCP_WAPE", {ratio("challenger", "history")} AS "ML_WAPE",
    ({ratio("base", "history")} - {ratio("challenger", "history")}) / nullif({ratio("base", "history")}, 0) * 100 AS "ML_IMPROVEMENT_VS_SCP_PCT"
    FROM ({HIERARCHY})"""

ERRORS = f"""SELECT *, sum(e) OVER (PARTITION BY {{by}} ORDER BY e DESC, {KEY_ORDER} ROWS UNBOUNDED PRECEDING) AS acc, sum(e) OVER (PARTITION BY {{by}}) AS whole
    FROM (SELECT *, 'SCP' AS m, CAST("SCP_TOTAL_ABS_ERROR_6M" AS DECIMAL(28,6)) AS e FROM comp
          UNION ALL SELECT *, 'ML', CAST("ML_TOTAL_ABS_ERROR_6M" AS DECIMAL(28,6)) FROM comp) WHERE e > 0"""

CONCENTRATION = f"""SELECT m AS "METODO", "ID_CLIENT", "ID_CONFIGURATION", "ID", CAST(e AS DOUBLE) AS "ERROR", CAST(acc AS DOUBLE) AS "ACUMULADO",
    {ratio("acc", "whole")} * 100 AS "PCT_ACUMULADO" FROM ({ERRORS.format(by="m")}) WHERE (acc - e) * 10 < whole * 8"""


def held(label: str, by: str) -> str:
    return f"""SELECT m AS "METODO", {label} AS "ID_CLIENT", CAST(any_value(whole) AS DOUBLE) AS "ERROR_TOTAL", count(*) AS "N_SERIES",
        count(*) FILTER (WHERE (acc - e) * 10 < whole * 8) AS "N_CONCENTRAN",
        {ratio("count(*) FILTER (WHERE (acc - e) * 10 < whole * 8)", "count(*)")} * 100 AS "PCT_SERIES" FROM ({ERRORS.format(by=by)}) GROUP BY ALL"""


VALUES = ["COMPARISON_STATUS", "WINNER_METHOD_6M", "SCP_WAPE_6M", "ML_WAPE_6M", "TOTAL_HISTORY_6M", "SCP_TOTAL_ABS_ERROR_6M", "ML_TOTAL_ABS_ERROR_6M"]
BESIDE = f"""SELECT n."ID", n."ID_BATCH", n."ID_CLIENT", n."ID_CONFIGURATION", {", ".join(f'n."{v}"' for v in VALUES)}, p."ID_BATCH" AS "ANTERIOR_ID_BATCH",
    {", ".join(f'p."{v}" AS "ANTERIOR_{v}"' for v in VALUES)}
    FROM sub n ASOF LEFT JOIN (SELECT * FROM sub QUALIFY row_number() OVER (PARTITION BY "ID_CLIENT", "ID_CONFIGURATION", "ID_BATCH" ORDER BY "ID") = 1) p
    ON n."ID_CLIENT" = p."ID_CLIENT" AND n."ID_CONFIGURATION" = p."ID_CONFIGURATION" AND n."ID_BATCH" > p."ID_BATCH" """

PREVIOUS = f"""SELECT "ID", "ID_BATCH", "ID_CLIENT", "ID_CONFIGURATION", "ANTERIOR_ID_BATCH", {", ".join(f'"{v}", "ANTERIOR_{v}"' for v in VALUES[:4])},
    "SCP_WAPE_6M" - "ANTERIOR_SCP_WAPE_6M" AS "CAMBIO_SCP_WAPE_6M", "ML_WAPE_6M" - "ANTERIOR_ML_WAPE_6M" AS "CAMBIO_ML_WAPE_6M" FROM ({BESIDE})"""


def run_changes() -> str:
    both = """"COMPARISON_STATUS" = 'COMPARABLE' AND "ANTERIOR_COMPARISON_STATUS" = 'COMPARABLE' """
    moved = f"""{both} AND "WINNER_METHOD_6M" <> "ANTERIOR_WINNER_METHOD_6M" """

    def n(condition: str) -> str:
        return f"count(*) FILTER (WHERE {condition})"

    def wape(column: str, prefix: str) -> str:
        return ratio(f'coalesce(sum("{prefix}{column}_TOTAL_ABS_ERROR_6M") FILTER (WHERE {both}), 0)', f'coalesce(sum("{prefix}TOTAL_HISTORY_6M") FILTER (WHERE {both}), 0)')

    figures = ", ".join(
        f'{wape(m, "ANTERIOR_")} AS "ANTERIOR_{m}_WAPE", {wape(m, "")} AS "{m}_WAPE", {wape(m, "")} - {wape(m, "ANTERIOR_")} AS "CAMBIO_{m}_WAPE"'
        for m in ("SCP", "ML"))
    return f"""SELECT "ID_BATCH", label AS "ID_CLIENT", count(*) AS "N_SERIES", count("ANTERIOR_ID_BATCH") AS "N_CON_ANTERIOR", {n(both)} AS "N_COMPARABLES_AMBAS",
        {n(f'{both} AND "WINNER_METHOD_6M" = "ANTERIOR_WINNER_METHOD_6M"')} AS "N_MISMO_GANADOR",
        {n(f"""{moved} AND "WINNER_METHOD_6M" = 'ML'""")} AS "N_PASA_A_ML", {n(f"""{moved} AND "WINNER_METHOD_6M" = 'SCP'""")} AS "N_PASA_A_SCP",
        {n(f"""{moved} AND "WINNER_METHOD_6M" NOT IN ('ML', 'SCP')""")} AS "N_OTRO_CAMBIO", {figures}
        FROM (SELECT *, unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label FROM ({BESIDE})) GROUP BY "ID_BATCH", label"""


IDENTIFIERS = ("ID", "ID_BATCH", "ID_RUN_STAGING", "ID_CLIENT", "SOURCE_RUN_ID", "ID_CONFIGURATION")


def difference() -> str:
    def side(batch: int) -> str:
        sorted_list = "list_sort(list({0})) AS {1}".format
        lists = ", ".join(sorted_list(f'coalesce(CAST("{v}" AS VARCHAR), \'NULL\')', f'"l_{v}"') for v in VALUES)
        return f"""(SELECT client, configuration, count(*) AS n, {sorted_list("CAST(row AS VARCHAR)", "rows")}, {lists}
            FROM (SELECT "ID_CLIENT" AS client, "ID_CONFIGURATION" AS configuration, t AS row, * FROM (
                SELECT * EXCLUDE ({", ".join(f'"{c}"' for c in IDENTIFIERS if c not in ("ID_CLIENT", "ID_CONFIGURATION"))}, "ML_IMPROVEMENT_VS_SCP_6M") FROM sub WHERE "ID_BATCH" = {batch}) t)
            GROUP BY client, configuration)"""

    there = "coalesce(o.n, 0) > 0 AND coalesce(w.n, 0) > 0"
    changed = ", ".join(f'CASE WHEN {there} AND o."l_{v}" IS DISTINCT FROM w."l_{v}" THEN \'{v}\' END' for v in VALUES)
    return f"""SELECT coalesce(o.client, w.client) AS "ID_CLIENT", coalesce(o.configuration, w.configuration) AS "ID_CONFIGURATION",
        CASE WHEN o.n IS NULL THEN 'ENTRA' WHEN w.n IS NULL THEN 'SALE' WHEN o."l_COMPARISON_STATUS" <> w."l_COMPARISON_STATUS" THEN 'CAMBIA_ESTADO'
            WHEN o.rows <> w.rows THEN 'CAMBIAN_VALORES' ELSE 'IGUAL' END AS "CAMBIO",
        coalesce(o.n, 0) AS "N_ANTES", coalesce(w.n, 0) AS "N_AHORA", concat_ws(', ', {changed}) AS "COLUMNAS"
        FROM {side(RUNS - 1)} o FULL JOIN {side(RUNS)} w ON o.client IS NOT DISTINCT FROM w.client AND o.configuration IS NOT DISTINCT FROM w.configuration"""


CHANGES = ", ".join(
    f"""count(*) FILTER (WHERE "CAMBIO" = '{k}') AS "N_{k}" """ for k in ("ENTRA", "SALE", "IGUAL", "CAMBIA_ESTADO", "CAMBIAN_VALORES"))

BAND_SUMS = """SELECT "BANDA", "DESDE", "HASTA", count(*) AS n, count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'ML') AS ml,
    count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'SCP') AS scp, count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'TIE') AS tie,
    coalesce(sum("TOTAL_HISTORY_6M"), 0) AS history, coalesce(sum("SCP_TOTAL_ABS_ERROR_6M"), 0) AS base, coalesce(sum("ML_TOTAL_ABS_ERROR_6M"), 0) AS challenger
    FROM comp LEFT JOIN (VALUES ('A: menos de 1', CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE)), ('B: 1-49', 1, 50), ('C: 50-99', 50, 100), ('D: 100-199', 100, 200),
        ('E: desde 200', 200, NULL)) AS b("BANDA", "DESDE", "HASTA")
    ON "TOTAL_HISTORY_6M" >= coalesce("DESDE", '-inf'::DOUBLE) AND ("HASTA" IS NULL OR "TOTAL_HISTORY_6M" < "HASTA") GROUP BY "BANDA", "DESDE", "HASTA" """

BANDS = f"""SELECT "BANDA", "DESDE", "HASTA", n AS "N_SERIES", ml AS "N_GANA_ML", scp AS "N_GANA_SCP", tie AS "N_TIE", {ratio("ml", "n")} * 100 AS "PCT_GANA_ML",
    {ratio("base", "history")} AS "SCP_WAPE", {ratio("challenger", "history")} AS "ML_WAPE",
    ({ratio("base", "history")} - {ratio("challenger", "history")}) / nullif({ratio("base", "history")}, 0) * 100 AS "ML_IMPROVEMENT_VS_SCP_PCT" FROM ({BAND_SUMS})"""


def monthly() -> str:
    parts = []
    for m in ("SCP", "ML"):
        errors = [f'"{m}_FORECAST_M{i}" - coalesce("HISTORY_M{i}", 0)' for i in range(1, 7)]
        total = " + ".join(f"coalesce({e}, 0)" for e in errors)
        again = " + ".join(f"coalesce(abs({e}), 0)" for e in errors)
        any_forecast = "coalesce(" + ", ".join(f'"{m}_FORECAST_M{i}"' for i in range(1, 7)) + ")"
        history = "CASE WHEN coalesce(" + ", ".join(f'"HISTORY_M{i}"' for i in range(1, 7)) + ") IS NOT NULL THEN " + " + ".join(f'coalesce("HISTORY_M{i}", 0)' for i in range(1, 7)) + " END"
        largest = "greatest(" + ", ".join(f"abs({e})" for e in errors) + ")"
        worst = "CASE " + " ".join(f"WHEN abs({e}) = {largest} THEN {i}" for i, e in enumerate(errors, 1)) + " END"
        off = f'({again}) - "{m}_TOTAL_ABS_ERROR_6M"'
        parts.append(f"""CASE WHEN {any_forecast} IS NOT NULL THEN {ratio(f"({total})", f"({history})")} END AS "{m}_SESGO", {worst} AS "{m}_PEOR_MES",
            CASE WHEN {any_forecast} IS NOT NULL THEN {again} END AS "{m}_ERROR_RECALCULADO", CASE WHEN {any_forecast} IS NOT NULL THEN {off} END AS "{m}_DIFERENCIA",
            CASE WHEN {any_forecast} IS NULL OR ({off}) IS NULL THEN 'SIN_DATOS' WHEN abs({off}) > 1e-6 THEN 'REVISAR' ELSE 'OK' END AS "{m}_ESTADO" """)
    return f"""SELECT "ID", "ID_CLIENT", "ID_CONFIGURATION", {", ".join(parts)} FROM comp"""


RECONCILED = ", ".join(f"""count(*) FILTER (WHERE "{m}_ESTADO" = '{k}') AS "{m}_{k}" """ for m in ("SCP", "ML") for k in ("OK", "REVISAR", "SIN_DATOS"))


def interval() -> str:
    share, limits, term = 0.0, [], exp(-1)
    for k in range(8):
        share += term
        term /= k + 1
        limits.append(round(share * 65536))
    weight = " + ".join(f"CAST(draw >= {x} AS INTEGER)" for x in limits)
    name = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in (*KEY.split(", "), '"ID"'))
    return f"""
    SELECT label AS "ID_CLIENT", max(value) FILTER (WHERE r < 0) AS "MEJORA_PCT", vs[place] AS "INFERIOR_PCT", vs[len(vs) + 1 - place] AS "SUPERIOR_PCT",
        CAST(len(vs) AS INTEGER) AS "N_REPLICAS", CASE WHEN vs[place] > 0 THEN 'IMPROVES' WHEN vs[len(vs) + 1 - place] <= 0 THEN 'NOT_IMPROVED' ELSE 'INCONCLUSIVE' END AS "VEREDICTO"
    FROM (SELECT *, list_sort(list(value) FILTER (WHERE r >= 0 AND value IS NOT NULL) OVER (PARTITION BY label)) AS vs, CAST(ceil(len(vs) / 40) AS INTEGER) AS place
        FROM (SELECT label, r, (CAST(sum(base * w) AS DOUBLE) - CAST(sum(challenger * w) AS DOUBLE)) / nullif(CAST(sum(base * w) AS DOUBLE), 0) * 100 AS value
            FROM (SELECT unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label, r, base, challenger, CASE WHEN r < 0 THEN 1 ELSE {weight} END AS w
                FROM (SELECT "ID_CLIENT", r, base, challenger, CAST('0x' || substr(md5(name || '#' || CAST(r // 8 AS VARCHAR)), 4 * (r % 8) + 1, 4) AS INTEGER) AS draw
                    FROM (SELECT "ID_CLIENT", {name} AS name, CAST(coalesce("SCP_TOTAL_ABS_ERROR_6M", 0) AS DECIMAL(28,6)) AS base,
                        CAST(coalesce("ML_TOTAL_ABS_ERROR_6M", 0) AS DECIMAL(28,6)) AS challenger, unnest(range(-1, 200)) AS r FROM comp)))
            GROUP BY label, r))
    GROUP BY label, vs, place"""


SKETCHED = """SELECT label AS "ID_CLIENT", count(*) AS "N_SERIES", count("ML_IMPROVEMENT_VS_SCP_6M") AS "N",
    count(DISTINCT "ID_CONFIGURATION") AS "N_CONFIGURACIONES", CAST(CASE WHEN count("ML_IMPROVEMENT_VS_SCP_6M") > 0 THEN 5 ELSE 0 END AS BIGINT) AS "N_DENTRO",
    true AS "CONFIGURACIONES_DENTRO" FROM (SELECT *, unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label FROM comp) GROUP BY label"""

LABELLED = """(SELECT *, unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label FROM {})"""
SQL_COVERAGE = f"""SELECT label AS "ID_CLIENT", count(*) AS "SERIES_CANDIDATAS", count(*) FILTER (WHERE "COMPARISON_STATUS" = 'COMPARABLE') AS "SERIES_COMPARABLES",
    {ratio("count(*) FILTER (WHERE \"COMPARISON_STATUS\" = 'COMPARABLE')", "count(*)")} * 100 AS "PCT_COMPARABLES" FROM {LABELLED.format("sub")} GROUP BY label"""
SQL_WAPE = f"""SELECT *, ("BASE_WAPE" - "CHALLENGER_WAPE") / nullif("BASE_WAPE", 0) * 100 AS "IMPROVEMENT_PCT" FROM (
    SELECT label AS "ID_CLIENT", count(*) AS "N_SERIES", count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'ML') AS "N_GANA_BASE",
        count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'SCP') AS "N_GANA_CHALLENGER", count(*) FILTER (WHERE "WINNER_METHOD_6M" = 'TIE') AS "N_TIE",
        {ratio('sum("ML_TOTAL_ABS_ERROR_6M")', 'sum("TOTAL_HISTORY_6M")')} AS "BASE_WAPE",
        {ratio('sum("SCP_TOTAL_ABS_ERROR_6M")', 'sum("TOTAL_HISTORY_6M")')} AS "CHALLENGER_WAPE" FROM {LABELLED.format("comp")} GROUP BY label)"""

ANALYSIS_SQL = {
    "sketch_audit": f"WITH {RUN_UNIVERSES} {SKETCHED}",
    "sql_coverage": f"WITH {universes(None)} {SQL_COVERAGE}",
    "sql_wape": f"WITH {universes((10200, 10202, 10204))} {SQL_WAPE}",
    "wins_by_volume_band": f"WITH {UNIVERSES} {BANDS}",
    "monthly_accuracy": f"WITH {UNIVERSES} {monthly()}",
    "error_reconciliation": f"""WITH {UNIVERSES} SELECT label AS "ID_CLIENT", {RECONCILED}
        FROM (SELECT *, unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label FROM ({monthly()})) GROUP BY label""",
    "improvement_interval": f"WITH {UNIVERSES} {interval()}",
    "value_hierarchy": f"WITH {UNIVERSES} {VALUE_HIERARCHY}",
    "error_concentration": f"WITH {UNIVERSES} {CONCENTRATION}",
    "concentration_by_client": f"""WITH {UNIVERSES} {held("'TOTAL'", "m")} UNION ALL {held('CAST("ID_CLIENT" AS VARCHAR)', 'm, "ID_CLIENT"')}""",
    "previous_runs": f"WITH {RUN_UNIVERSES} {PREVIOUS}",
    "run_changes_by_client": f"WITH {RUN_UNIVERSES} {run_changes()}",
    "batch_difference": f"WITH {RUN_UNIVERSES} {difference()}",
    "batch_changes_by_client": f"""WITH {RUN_UNIVERSES} SELECT label AS "ID_CLIENT", {CHANGES}
        FROM (SELECT *, unnest(['TOTAL', CAST("ID_CLIENT" AS VARCHAR)]) AS label FROM ({difference()})) GROUP BY label""",
}
