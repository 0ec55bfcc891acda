"""SQL that every query must agree with, run by DuckDB on the same tables."""

from __future__ import annotations

MONTHS = range(1, 7)
CLIENTS = (10200, 10201, 10202, 10203, 10299)


def each(template: str, separator: str, values=MONTHS) -> str:
    return separator.join(template.format(i=i, j=i + 12) for i in values)


def series(back: int = 0) -> str:
    """The derived table as of some months ago."""
    shift = f"CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE {back} END"
    return f"""
newest AS (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) AS m FROM lineitem),
lines AS (
  SELECT o_custkey AS k, (SELECT m FROM newest) - (year(l_shipdate) * 12 + month(l_shipdate)) - {shift} AS m,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
monthly AS (SELECT k, m, CAST(sum(q) AS BIGINT) AS q FROM lines GROUP BY k, m),
wide AS (
  SELECT k, {each("CAST(sum(q) FILTER (WHERE m = {i}) AS BIGINT) AS q{i}", ", ", range(1, 19))},
         CAST(coalesce(sum(q) FILTER (WHERE m BETWEEN 1 AND 6), 0) AS BIGINT) AS total,
         CAST(sum(q) FILTER (WHERE m BETWEEN 7 AND 9) AS BIGINT) // 3 AS base_fc,
         CAST(coalesce(sum(q) FILTER (WHERE m BETWEEN 7 AND 18), 0) AS BIGINT) // 12 AS year_fc,
         count(*) FILTER (WHERE m BETWEEN 7 AND 18) AS year_months,
         count(*) FILTER (WHERE m BETWEEN 13 AND 18) AS seasonal_months,
         count(*) FILTER (WHERE m > 18) AS older_months
  FROM monthly GROUP BY k
),
fc AS (
  SELECT *, year_months < 2 AS excluded,
         {each("CASE WHEN year_months >= 2 AND k % 71 <> 0 THEN coalesce(q{j}, year_fc) END AS c{i}", ", ")}
  FROM wide
),
err AS (
  SELECT *, CASE WHEN base_fc IS NULL THEN NULL WHEN k % 43 = 0 THEN 0
                 ELSE {each("abs(coalesce(q{i}, 0) - base_fc)", " + ")} END AS base_err,
         {each("abs(coalesce(q{i}, 0) - c{i})", " + ")} AS ch_err
  FROM fc
),
won AS (
  SELECT *, CASE WHEN k % 53 = 0 OR base_err IS NULL OR ch_err IS NULL THEN NULL
                 WHEN ch_err < base_err THEN 'ML' WHEN base_err < ch_err THEN 'SCP' ELSE 'TIE' END AS winner,
         CASE WHEN base_fc IS NULL THEN NULL WHEN k % 3 = 0 THEN 'MovingAverage3M'
              WHEN k % 3 = 1 THEN 'Croston' ELSE 'Naive' END AS base_model,
         CASE WHEN c1 IS NULL OR k % 29 = 0 THEN NULL
              WHEN seasonal_months > 0 THEN 'SeasonalNaive' ELSE 'HistoricAverage' END AS ch_model
  FROM err
),
once AS (
  SELECT k AS "ID", CAST(1 AS BIGINT) AS "ID_BATCH", CAST(10 + n_nationkey AS BIGINT) AS "ID_RUN_STAGING",
    CAST(10200 + r_regionkey AS BIGINT) AS "ID_CLIENT",
    CAST(CASE WHEN k % 13 <> 0 THEN 500 + k % 3 END AS BIGINT) AS "SOURCE_RUN_ID", k AS "ID_CONFIGURATION",
    r_name AS "VALUE_LEVEL_1", n_name AS "VALUE_LEVEL_2", c_mktsegment AS "VALUE_LEVEL_3",
    c_name AS "VALUE_LEVEL_4", CAST(NULL AS VARCHAR) AS "VALUE_LEVEL_5",
    ch_model AS "ML_BEST_MODEL", c_mktsegment AS "ML_CLASSIFICATION",
    CASE WHEN year_months >= 6 THEN 'Smooth' ELSE 'Intermittent' END AS "ML_TYPE",
    CASE WHEN ch_err IS NOT NULL THEN 'OK' ELSE 'NO_OUTPUT' END AS "ML_STATUS",
    base_model AS "SCP_BEST_MODEL", c_mktsegment AS "SCP_CLASSIFICATION",
    CASE WHEN base_err IS NOT NULL THEN 'OK' ELSE 'NO_OUTPUT' END AS "SCP_STATUS",
    CASE WHEN total >= 100 THEN 'High' ELSE 'Low' END AS "SERIES_CLASSIFICATION",
    CASE WHEN k % 101 = 0 THEN NULL
         WHEN total = 0 THEN 'NOT_COMPARABLE_NO_HISTORY'
         WHEN base_err IS NULL AND ch_err IS NULL THEN 'NOT_COMPARABLE_MISSING_SCP_AND_ML'
         WHEN excluded THEN 'NOT_COMPARABLE_ML_EXCLUDED'
         WHEN base_err IS NULL THEN 'NOT_COMPARABLE_MISSING_SCP'
         WHEN ch_err IS NULL THEN 'NOT_COMPARABLE_MISSING_ML'
         ELSE 'COMPARABLE' END AS "COMPARISON_STATUS",
    CASE WHEN k % 19 = 0 THEN 0 ELSE 1 END AS "HAS_BASE_CANDIDATE",
    CASE WHEN base_err IS NULL THEN 0 ELSE 1 END AS "HAS_SCP_CALCULATED",
    CASE WHEN ch_err IS NULL THEN 0 ELSE 1 END AS "HAS_ML_CALCULATED",
    CASE WHEN excluded THEN 1 ELSE 0 END AS "HAS_ML_EXCLUDED",
    CASE WHEN NOT excluded OR k % 11 = 0 THEN NULL WHEN year_months = 1 THEN 'ShortSeries'
         WHEN older_months > 0 THEN 'MissingHistory' ELSE 'NewRelease' END AS "ML_EXCLUSION_REASON",
    CASE WHEN base_fc IS NULL THEN 'NoRecentHistory' END AS "SCP_NO_OUTPUT_REASON",
    {each('CAST(CASE WHEN k % 59 <> 0 THEN q{i} END AS DOUBLE) AS "HISTORY_M{i}"', ", ")},
    {each('CAST(CASE WHEN k % 61 <> 0 THEN base_fc END AS DOUBLE) AS "SCP_FORECAST_M{i}"', ", ")},
    {each('CAST(CASE WHEN k % 67 <> 0 THEN c{i} END AS DOUBLE) AS "ML_FORECAST_M{i}"', ", ")},
    CAST(total AS DOUBLE) AS "TOTAL_HISTORY_6M",
    CAST(base_err AS DOUBLE) AS "SCP_TOTAL_ABS_ERROR_6M", CAST(ch_err AS DOUBLE) AS "ML_TOTAL_ABS_ERROR_6M",
    CAST(base_err AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) AS "SCP_WAPE_6M",
    CASE WHEN k % 79 <> 0 THEN CAST(ch_err AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) END AS "ML_WAPE_6M",
    winner AS "WINNER_METHOD_6M",
    CASE WHEN winner = 'ML' THEN ch_model WHEN winner IS NOT NULL THEN base_model END AS "WINNER_MODEL_6M",
    CASE WHEN winner = 'TIE' THEN 'SCP' ELSE winner END AS "FINALIST_METHOD_6M",
    CASE WHEN winner = 'ML' THEN ch_model WHEN winner IS NOT NULL THEN base_model END AS "FINALIST_MODEL_6M",
    CASE winner WHEN 'TIE' THEN 0.0
      WHEN 'ML' THEN CAST(base_err - ch_err AS DOUBLE) / nullif(CAST(base_err AS DOUBLE), 0) * 100
      WHEN 'SCP' THEN CAST(ch_err - base_err AS DOUBLE) / nullif(CAST(ch_err AS DOUBLE), 0) * 100
    END AS "WINNER_IMPROVEMENT_PCT_6M"
  FROM won JOIN customer ON k = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
series AS (
  SELECT * FROM once
  UNION ALL
  SELECT * REPLACE ("ID" + 1000000000 AS "ID") FROM once WHERE "ID_CONFIGURATION" % 97 = 0
)"""


SERIES = series()


def universes(clients: tuple[int, ...] | None, source: str = SERIES) -> str:
    """Candidates and comparables of the listed clients, or of all."""
    if clients is None:
        chosen = "true"
        labels = """SELECT 'TOTAL' AS label UNION SELECT CAST("ID_CLIENT" AS VARCHAR) FROM sub"""
        present = """SELECT DISTINCT "ID_CLIENT" AS client FROM sub"""
    else:
        chosen = f'"ID_CLIENT" IN {clients}'
        labels = "SELECT * FROM (VALUES ('TOTAL'), " + ", ".join(f"('{c}')" for c in clients) + ") AS t(label)"
        present = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({c} AS BIGINT))" for c in clients) + ") AS t(client)"
    return f"""{source},
sub AS (
  SELECT *, ("SCP_WAPE_6M" - "ML_WAPE_6M") / nullif("SCP_WAPE_6M", 0) * 100 AS "ML_IMPROVEMENT_VS_SCP_6M"
  FROM series WHERE {chosen} AND "HAS_BASE_CANDIDATE" = 1
),
comp AS (SELECT * FROM sub WHERE "COMPARISON_STATUS" = 'COMPARABLE'),
labels AS ({labels}),
clients AS ({present}),
sub_labelled AS (
  SELECT 'TOTAL' AS label, * FROM sub UNION ALL SELECT CAST("ID_CLIENT" AS VARCHAR) AS label, * FROM sub
),
comp_labelled AS (SELECT * FROM sub_labelled WHERE "COMPARISON_STATUS" = 'COMPARABLE'),
wape AS (
  SELECT label, n, scp_wape, ml_wape, (scp_wape - ml_wape) / nullif(scp_wape, 0) * 100 AS improvement
  FROM (
    SELECT l.label, count(c.label) AS n,
      coalesce(sum("SCP_TOTAL_ABS_ERROR_6M"), 0) / nullif(sum("TOTAL_HISTORY_6M"), 0) AS scp_wape,
      coalesce(sum("ML_TOTAL_ABS_ERROR_6M"), 0) / nullif(sum("TOTAL_HISTORY_6M"), 0) AS ml_wape
    FROM labels l LEFT JOIN comp_labelled c ON l.label = c.label GROUP BY l.label
  )
)"""


UNIVERSES, ALL_CLIENTS = universes(CLIENTS), universes(None)


def value_counts(column: str, source: str) -> str:
    return f"""SELECT "{column}", count(*) AS "N", count(*) / sum(count(*)) OVER () * 100 AS "PCT"
        FROM {source} GROUP BY "{column}" """


def statistics(column: str) -> str:
    quantiles = "".join(
        f'round(quantile_cont("{column}", {q}), 6) AS {name}, '
        for name, q in [("median", 0.5), ("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9)]
    )
    return f"""count("{column}") AS count, round(avg("{column}"), 6) AS mean, {quantiles}
        round(min("{column}"), 6) AS min, round(max("{column}"), 6) AS max"""


def distribution(column: str, source: str, pct: str) -> str:
    return f"""SELECT "ID_CLIENT", "{column}", "N", "{pct}" FROM (
        SELECT label AS "ID_CLIENT", "{column}", count(*) AS "N",
               count(*) / sum(count(*)) OVER (PARTITION BY label) * 100 AS "{pct}"
        FROM {source} GROUP BY label, "{column}") WHERE "{column}" IS NOT NULL"""


def win_summary(method: str) -> str:
    wins = f"""count(*) FILTER (WHERE "WINNER_METHOD_6M" = '{method}')"""
    return f"""SELECT {wins} AS "N_SERIES_GANA_{method}", {wins} / nullif(count(*), 0) * 100 AS "PCT_SOBRE_COMPARABLES",
        count(*) AS "N_SERIES_COMPARABLES_TOTAL" FROM comp"""


def wins_by_client(method: str) -> str:
    wins = f"""count("ID_CLIENT") FILTER (WHERE "WINNER_METHOD_6M" = '{method}')"""
    return f"""SELECT client AS "ID_CLIENT", count("ID_CLIENT") AS "N_COMPARABLES", {wins} AS "N_GANA_{method}",
        {wins} / nullif(count("ID_CLIENT"), 0) * 100 AS "PCT_GANA_{method}"
        FROM clients LEFT JOIN comp ON client = "ID_CLIENT" GROUP BY client"""


DIMENSIONS = {
    "ML": ["WINNER_MODEL_6M", "ML_BEST_MODEL", "ML_CLASSIFICATION", "ML_TYPE", "SERIES_CLASSIFICATION"],
    "SCP": ["SCP_BEST_MODEL", "ML_BEST_MODEL", "ML_CLASSIFICATION", "ML_TYPE", "SERIES_CLASSIFICATION"],
}


def win_profile(method: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS "DIMENSION", "{d}" AS "VALOR", count(*) AS "N",
            count(*) / sum(count(*)) OVER () * 100 AS "PCT"
            FROM comp WHERE "WINNER_METHOD_6M" = '{method}' GROUP BY "{d}" """
        for d in DIMENSIONS[method]
    )


def win_profiles_by_client() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS "GANADOR", "ID_CLIENT", '{d}' AS "DIMENSION", "{d}" AS "VALOR", count(*) AS "N",
            count(*) / sum(count(*)) OVER (PARTITION BY "ID_CLIENT") * 100 AS "PCT"
            FROM comp WHERE "WINNER_METHOD_6M" = '{m}' GROUP BY "ID_CLIENT", "{d}" """
        for m, dimensions in DIMENSIONS.items()
        for d in dimensions
    )


def value_by_dimension() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{m}' AS "GANADOR", '{d}' AS "DIMENSION", "{d}" AS "VALOR", count(*) AS "N",
            coalesce(sum("SCP_TOTAL_ABS_ERROR_6M"), 0) AS scp, coalesce(sum("ML_TOTAL_ABS_ERROR_6M"), 0) AS ml,
            coalesce(sum("TOTAL_HISTORY_6M"), 0) AS history
            FROM comp WHERE "WINNER_METHOD_6M" = '{m}' GROUP BY "{d}" """
        for m, dimensions in DIMENSIONS.items()
        for d in dimensions
    )
    return f"""SELECT "GANADOR", "DIMENSION", "VALOR", "N", scp - ml AS "REDUCCION_ERROR",
        (scp - ml) / nullif(sum(scp - ml) OVER (PARTITION BY "GANADOR", "DIMENSION"), 0) * 100
          AS "PCT_REDUCCION_ERROR",
        scp / nullif(history, 0) AS "SCP_WAPE", ml / nullif(history, 0) AS "ML_WAPE",
        (scp / nullif(history, 0) - ml / nullif(history, 0)) / nullif(scp / nullif(history, 0), 0) * 100
          AS "ML_IMPROVEMENT_VS_SCP_PCT"
        FROM ({parts})"""


# The columns of the rankings.
RANKING = ", ".join(
    f'"{c}"'
    for c in [
        "ID_CLIENT", "ID_CONFIGURATION", *(f"VALUE_LEVEL_{i}" for i in range(1, 6)), "TOTAL_HISTORY_6M",
        "SCP_WAPE_6M", "ML_WAPE_6M", "ML_IMPROVEMENT_VS_SCP_6M", "WINNER_IMPROVEMENT_PCT_6M",
        "WINNER_METHOD_6M", "WINNER_MODEL_6M", "FINALIST_METHOD_6M", "FINALIST_MODEL_6M",
        "SCP_BEST_MODEL", "ML_BEST_MODEL", "ML_CLASSIFICATION", "ML_TYPE", "SERIES_CLASSIFICATION",
    ]
)
KEY = '"ID_BATCH", "ID_RUN_STAGING", "ID_CLIENT", "SOURCE_RUN_ID", "ID_CONFIGURATION"'
KEY_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in (*KEY.split(", "), '"ID"'))


def ranking(method: str, order: str) -> str:
    return f"""SELECT {RANKING} FROM comp WHERE "WINNER_METHOD_6M" = '{method}'
        ORDER BY {order} NULLS LAST, {KEY_ORDER} LIMIT 20"""


def all_null(prefix: str) -> str:
    return "coalesce(" + each(f'"{prefix}_M{{i}}"', ", ") + ") IS NULL"


def quality() -> str:
    checks = [
        ("duplicate_key",
         f"(SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM sub GROUP BY {KEY}))",
         "(SELECT count(*) FROM sub)"),
        *(
            (name, f"(SELECT count(*) FROM comp WHERE {condition})", "(SELECT count(*) FROM comp)")
            for name, condition in [
                ("comparable_without_history", all_null("HISTORY")),
                ("comparable_without_base_forecast", all_null("SCP_FORECAST")),
                ("comparable_without_challenger_forecast", all_null("ML_FORECAST")),
                ("comparable_without_winner", '"WINNER_METHOD_6M" IS NULL'),
                ("comparable_without_wape", '"SCP_WAPE_6M" IS NULL OR "ML_WAPE_6M" IS NULL'),
            ]
        ),
        ("excluded_without_reason",
         """(SELECT count(*) FROM sub WHERE "HAS_ML_EXCLUDED" = 1 AND "ML_EXCLUSION_REASON" IS NULL)""",
         """(SELECT count(*) FROM sub WHERE "HAS_ML_EXCLUDED" = 1)"""),
    ]
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "CHECK", CAST({n} AS BIGINT) AS "N_FILAS_AFECTADAS", {whole} AS "DENOMINADOR",
            {n} / nullif({whole}, 0) * 100 AS "PCT", CASE WHEN {n} = 0 THEN 'OK' ELSE 'REVISAR' END AS "ESTADO" """
        for name, n, whole in checks
    )


COVERAGE = """SELECT l.label AS "ID_CLIENT", count(s.label) AS "SERIES_CANDIDATAS",
    count(s.label) FILTER (WHERE "COMPARISON_STATUS" = 'COMPARABLE') AS "SERIES_COMPARABLES",
    count(s.label) FILTER (WHERE "COMPARISON_STATUS" = 'COMPARABLE') / nullif(count(s.label), 0) * 100
      AS "PCT_COMPARABLES",
    count(s.label) FILTER (WHERE "COMPARISON_STATUS" IS DISTINCT FROM 'COMPARABLE') AS "SERIES_NO_COMPARABLES",
    count(s.label) FILTER (WHERE "HAS_ML_EXCLUDED" = 1) AS "SERIES_HAS_ML_EXCLUDED",
    count(s.label) FILTER (WHERE "HAS_ML_EXCLUDED" = 1) / nullif(count(s.label), 0) * 100 AS "PCT_HAS_ML_EXCLUDED"
    FROM labels l LEFT JOIN sub_labelled s ON l.label = s.label GROUP BY l.label"""


def status_share(status: str, alias: str) -> str:
    return f"""count(s.label) FILTER (WHERE "COMPARISON_STATUS" = '{status}') / nullif(count(s.label), 0) * 100
        AS "{alias}" """


COVERAGE_WIDE = f"""SELECT l.label AS "ID_CLIENT", count(s.label) AS "SERIES_CANDIDATAS",
    count(s.label) FILTER (WHERE "COMPARISON_STATUS" = 'COMPARABLE') AS "SERIES_COMPARABLES",
    {status_share("COMPARABLE", "PCT_COMPARABLES")},
    {status_share("NOT_COMPARABLE_ML_EXCLUDED", "PCT_ML_EXCLUDED")},
    {status_share("NOT_COMPARABLE_MISSING_SCP", "PCT_MISSING_SCP")},
    {status_share("NOT_COMPARABLE_MISSING_ML", "PCT_MISSING_ML")},
    {status_share("NOT_COMPARABLE_MISSING_SCP_AND_ML", "PCT_MISSING_SCP_AND_ML")},
    {status_share("NOT_COMPARABLE_NO_HISTORY", "PCT_NO_HISTORY")}
    FROM labels l LEFT JOIN sub_labelled s ON l.label = s.label GROUP BY l.label"""

# The texts.
STATUS_WITH_MEANING = """SELECT "COMPARISON_STATUS", count(*) AS "N",
    count(*) / (SELECT count(*) FROM sub) * 100 AS "PCT_SOBRE_CANDIDATAS",
    CASE "COMPARISON_STATUS"
      WHEN 'NOT_COMPARABLE_MISSING_SCP_AND_ML' THEN 'Faltan ambos forecasts (SCP y ML).'
      WHEN 'NOT_COMPARABLE_ML_EXCLUDED' THEN 'ML excluyó explícitamente la serie (ver más abajo).'
      WHEN 'NOT_COMPARABLE_NO_HISTORY' THEN 'No hay histórico útil para evaluar la serie.'
      WHEN 'NOT_COMPARABLE_MISSING_SCP' THEN 'Falta el forecast de SCP.'
      WHEN 'NOT_COMPARABLE_MISSING_ML' THEN 'Falta el forecast de ML.'
      WHEN 'NOT_COMPARABLE_MISSING_VALIDATION' THEN 'No hay datos de validación disponibles.'
      WHEN 'NOT_COMPARABLE_RUN_FAILED' THEN 'El run de cálculo falló.'
      ELSE '' END AS "SIGNIFICADO"
    FROM sub WHERE "COMPARISON_STATUS" <> 'COMPARABLE' GROUP BY "COMPARISON_STATUS" """


def wins(method: str) -> str:
    return f"""count(*) FILTER (WHERE "WINNER_METHOD_6M" = '{method}')"""


GLOBAL_SUMMARY = f"""SELECT '{", ".join(str(c) for c in CLIENTS)}' AS "CLIENTES_ANALIZADOS",
    (SELECT count(*) FROM sub) AS "SERIES_CANDIDATAS_TOTAL", count(*) AS "SERIES_COMPARABLES_TOTAL",
    count(*) / nullif((SELECT count(*) FROM sub), 0) * 100 AS "PCT_COMPARABLES",
    (SELECT scp_wape FROM wape WHERE label = 'TOTAL') AS "SCP_WAPE_GLOBAL",
    (SELECT ml_wape FROM wape WHERE label = 'TOTAL') AS "ML_WAPE_GLOBAL",
    (SELECT improvement FROM wape WHERE label = 'TOTAL') AS "ML_IMPROVEMENT_VS_SCP_GLOBAL_PCT",
    {wins("ML")} / nullif(count(*), 0) * 100 AS "PCT_SERIES_GANA_ML",
    {wins("SCP")} / nullif(count(*), 0) * 100 AS "PCT_SERIES_GANA_SCP",
    {wins("TIE")} / nullif(count(*), 0) * 100 AS "PCT_SERIES_TIE" FROM comp"""

ML_QUANTILE = """round(quantile_cont("WINNER_IMPROVEMENT_PCT_6M", {q}) FILTER (WHERE "WINNER_METHOD_6M" = 'ML'), 6)"""

VERDICT = f"""SELECT
    (SELECT CASE WHEN improvement IS NULL THEN 'UNDEFINED' WHEN improvement > 0 THEN 'IMPROVES'
            ELSE 'NOT_IMPROVED' END FROM wape WHERE label = 'TOTAL') AS "VEREDICTO",
    (SELECT round(scp_wape * 100, 6) FROM wape WHERE label = 'TOTAL') AS "SCP_WAPE_PCT",
    (SELECT round(ml_wape * 100, 6) FROM wape WHERE label = 'TOTAL') AS "ML_WAPE_PCT",
    (SELECT round(improvement, 6) FROM wape WHERE label = 'TOTAL') AS "MEJORA_PCT",
    {wins("ML")} AS "N_GANA_ML", round({wins("ML")} / nullif(count(*), 0) * 100, 6) AS "PCT_GANA_ML",
    {wins("SCP")} AS "N_GANA_SCP", round({wins("SCP")} / nullif(count(*), 0) * 100, 6) AS "PCT_GANA_SCP",
    {wins("TIE")} AS "N_TIE", round({wins("TIE")} / nullif(count(*), 0) * 100, 6) AS "PCT_TIE",
    {ML_QUANTILE.format(q=0.5)} AS "MEDIANA_MEJORA_ML",
    round(avg("WINNER_IMPROVEMENT_PCT_6M") FILTER (WHERE "WINNER_METHOD_6M" = 'ML'), 6) AS "MEDIA_MEJORA_ML",
    {ML_QUANTILE.format(q=0.25)} AS "P25_MEJORA_ML", {ML_QUANTILE.format(q=0.75)} AS "P75_MEJORA_ML",
    round(-quantile_cont("ML_IMPROVEMENT_VS_SCP_6M", 0.5) FILTER (WHERE "WINNER_METHOD_6M" = 'SCP'), 6)
      AS "MEDIANA_PERDIDA_ML"
    FROM comp"""

HISTOGRAM = """SELECT bin AS "BIN", lo + (bin - 1) * width AS "DESDE",
    CASE WHEN bin = 40 THEN hi ELSE lo + bin * width END AS "HASTA", count(x) AS "N"
    FROM (
      SELECT lo, hi, (hi - lo) / 40 AS width FROM (
        SELECT coalesce(CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END, CAST(0 AS DOUBLE)) AS lo,
               coalesce(CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END, CAST(1 AS DOUBLE)) AS hi
        FROM (SELECT greatest(-100, least(100, "ML_IMPROVEMENT_VS_SCP_6M")) AS x
              FROM comp WHERE "ML_IMPROVEMENT_VS_SCP_6M" IS NOT NULL))
    )
    CROSS JOIN (SELECT unnest(range(1, 41)) AS bin)
    LEFT JOIN (
      SELECT greatest(-100, least(100, "ML_IMPROVEMENT_VS_SCP_6M")) AS x
      FROM comp WHERE "ML_IMPROVEMENT_VS_SCP_6M" IS NOT NULL
    ) ON (bin = 1 OR x >= lo + (bin - 1) * width) AND (bin = 40 OR x < lo + bin * width)
    GROUP BY bin, lo, hi, width"""

CHART_WINNERS = """SELECT CASE "WINNER_METHOD_6M" WHEN 'ML' THEN 1 WHEN 'SCP' THEN 2 ELSE 3 END AS "ORDEN",
    "WINNER_METHOD_6M" AS "METODO", count(*) AS "N",
    count(*) / (SELECT count("WINNER_METHOD_6M") FROM comp) * 100 AS "PCT"
    FROM comp WHERE "WINNER_METHOD_6M" IN ('ML', 'SCP', 'TIE') GROUP BY "WINNER_METHOD_6M" """


def printed_percent(value: str) -> str:
    return f"coalesce(format('{{:.1f}}%', {value}), 'n/d')"


def printed_count(value: str) -> str:
    return f"coalesce(replace(format('{{:,}}', {value}), ',', '.'), 'n/d')"


FORMATTED = f"""SELECT "ID_CLIENT", {printed_count('"SERIES_CANDIDATAS"')} AS "SERIES_CANDIDATAS",
    {printed_count('"SERIES_COMPARABLES"')} AS "SERIES_COMPARABLES",
    {printed_percent('"PCT_COMPARABLES"')} AS "PCT_COMPARABLES",
    {printed_count('"SERIES_NO_COMPARABLES"')} AS "SERIES_NO_COMPARABLES",
    {printed_count('"SERIES_HAS_ML_EXCLUDED"')} AS "SERIES_HAS_ML_EXCLUDED",
    {printed_percent('"PCT_HAS_ML_EXCLUDED"')} AS "PCT_HAS_ML_EXCLUDED",
    {printed_percent("scp_wape * 100")} AS "SCP_WAPE", {printed_percent("ml_wape * 100")} AS "ML_WAPE",
    {printed_percent("improvement")} AS "ML_IMPROVEMENT_VS_SCP"
    FROM ({COVERAGE}) JOIN wape ON label = "ID_CLIENT" """

BODIES = {
    "candidates": "SELECT * FROM sub",
    "comparables": "SELECT * FROM comp",
    "ml_improvement_by_series": """SELECT "ID", "ID_CLIENT", "ID_CONFIGURATION", "SCP_WAPE_6M", "ML_WAPE_6M",
        "ML_IMPROVEMENT_VS_SCP_6M" FROM sub""",
    "coverage_by_client": COVERAGE,
    "coverage_wide": COVERAGE_WIDE,
    "status_distribution": distribution("COMPARISON_STATUS", "sub_labelled", "PCT_SOBRE_CANDIDATAS"),
    "status_with_meaning": STATUS_WITH_MEANING,
    "exclusion_reasons": value_counts("ML_EXCLUSION_REASON", """sub WHERE "HAS_ML_EXCLUDED" = 1"""),
    "exclusion_reasons_by_client": """SELECT "ID_CLIENT", "ML_EXCLUSION_REASON", count(*) AS "N",
        count(*) / sum(count(*)) OVER (PARTITION BY "ID_CLIENT") * 100 AS "PCT"
        FROM sub WHERE "HAS_ML_EXCLUDED" = 1 GROUP BY "ID_CLIENT", "ML_EXCLUSION_REASON" """,
    "scp_no_output_reasons": value_counts(
        "SCP_NO_OUTPUT_REASON", """sub WHERE "COMPARISON_STATUS" IS DISTINCT FROM 'COMPARABLE'"""
    ),
    "excluded_flag_distribution": value_counts("HAS_ML_EXCLUDED", "sub"),
    "exclusion_reconciliation": """SELECT status AS "N_COMPARISON_STATUS_ML_EXCLUDED", flag AS "N_HAS_ML_EXCLUDED_1",
        flag - status AS "DIFERENCIA" FROM (
          SELECT count(*) FILTER (WHERE "COMPARISON_STATUS" = 'NOT_COMPARABLE_ML_EXCLUDED') AS status,
                 count(*) FILTER (WHERE "HAS_ML_EXCLUDED" = 1) AS flag FROM sub)""",
    "global_summary": GLOBAL_SUMMARY,
    "winner_distribution": distribution("WINNER_METHOD_6M", "comp_labelled", "PCT_SOBRE_COMPARABLES"),
    "finalist_distribution": value_counts("FINALIST_METHOD_6M", "comp"),
    "wape_impact": """SELECT label AS "ID_CLIENT", n AS "N_SERIES_COMPARABLES", scp_wape AS "SCP_WAPE_GLOBAL",
        ml_wape AS "ML_WAPE_GLOBAL", improvement AS "ML_IMPROVEMENT_VS_SCP_GLOBAL_PCT" FROM wape""",
    "ml_improvement_stats": f"""SELECT l.label AS "GRUPO", {statistics("ML_IMPROVEMENT_VS_SCP_6M")}
        FROM labels l LEFT JOIN comp_labelled c ON l.label = c.label GROUP BY l.label""",
    "ml_win_summary": win_summary("ML"),
    "ml_win_improvement_stats": f"""SELECT 'TODAS (gana ML)' AS "GRUPO", {statistics("WINNER_IMPROVEMENT_PCT_6M")}
        FROM comp WHERE "WINNER_METHOD_6M" = 'ML'""",
    "ml_wins_by_client": wins_by_client("ML"),
    "ml_win_profiles": win_profile("ML"),
    "scp_win_summary": win_summary("SCP"),
    "scp_win_improvement_stats": f"""SELECT 'TODAS (gana SCP)' AS "GRUPO", {statistics("ML_IMPROVEMENT_VS_SCP_6M")}
        FROM comp WHERE "WINNER_METHOD_6M" = 'SCP'""",
    "scp_wins_by_client": wins_by_client("SCP"),
    "scp_win_profiles": win_profile("SCP"),
    "win_profiles_by_client": win_profiles_by_client(),
    "value_by_dimension": value_by_dimension(),
    "top_winner_models": f"""SELECT * FROM (
        {value_counts("WINNER_MODEL_6M", '''comp WHERE "WINNER_METHOD_6M" = 'ML' ''')})
        WHERE "WINNER_MODEL_6M" IS NOT NULL ORDER BY "N" DESC, "WINNER_MODEL_6M" LIMIT 5""",
    "top_ml_improvements": ranking("ML", '"WINNER_IMPROVEMENT_PCT_6M" DESC'),
    "top_ml_underperformance": ranking("SCP", '"ML_IMPROVEMENT_VS_SCP_6M" ASC'),
    "data_quality_checks": quality(),
    "dq_issue_count": f"""SELECT count(*) AS "N_REVISAR" FROM ({quality()}) WHERE "ESTADO" = 'REVISAR'""",
    "chart_winners": CHART_WINNERS,
    "chart_wape": """SELECT 1 AS "ORDEN", 'SCP' AS "METODO", scp_wape * 100 AS "WAPE_PCT" FROM wape
        WHERE label = 'TOTAL' UNION ALL SELECT 2, 'ML', ml_wape * 100 FROM wape WHERE label = 'TOTAL'""",
    "chart_coverage": f"""SELECT "ID_CLIENT", "PCT_COMPARABLES" FROM ({COVERAGE}) WHERE "ID_CLIENT" <> 'TOTAL'""",
    "improvement_histogram": HISTOGRAM,
    "verdict": VERDICT,
    "formatted_kpis": FORMATTED,
}

# Sheet, block and title in document order. The sheet names.
RECONCILED = """NOT_COMPARABLE_ML_EXCLUDED solo cuenta las series sin un estado de mayor precedencia; HAS_ML_EXCLUDED = 1 cuenta todas las exclusiones."""
DOCUMENT = [
    ("01_global_summary", "global_summary", "Executive summary"),
    ("02_client_coverage", "coverage_by_client", "Coverage by client"),
    ("03_status_distribution", "status_distribution", "Comparison status, total and by client"),
    ("03_status_distribution", "exclusion_reasons", "Exclusion reasons of the challenger"),
    ("03_status_distribution", "scp_no_output_reasons", "Reasons for missing base output"),
    ("04_winner_distribution", "winner_distribution", "Winners, total and by client"),
    ("05_wape_impact", "wape_impact", "Volume-weighted WAPE, total and by client"),
    ("06_ml_improvement_stats", "ml_improvement_stats", "Improvement by series, total and by client"),
    ("07_ml_winning_models", "ml_win_summary", "Series won by the challenger"),
    ("07_ml_winning_models", "ml_win_improvement_stats", "Improvement where the challenger wins"),
    ("07_ml_winning_models", "ml_wins_by_client", "Challenger wins by client"),
    ("07_ml_winning_models", "ml_win_profiles", "Models and classes where the challenger wins"),
    ("08_scp_wins_analysis", "scp_win_summary", "Series won by the base method"),
    ("08_scp_wins_analysis", "scp_win_improvement_stats", "Improvement where the base wins (negative)"),
    ("08_scp_wins_analysis", "scp_wins_by_client", "Base wins by client"),
    ("08_scp_wins_analysis", "scp_win_profiles", "Models and classes where the base wins"),
    ("09_exclusions", "status_distribution", "Comparison status, total and by client"),
    ("09_exclusions", "exclusion_reconciliation", "Exclusions by status and by flag"),
    ("09_exclusions", "exclusion_reasons", "Exclusion reasons of the challenger"),
    ("09_exclusions", "exclusion_reasons_by_client", "Exclusion reasons by client"),
    ("09_exclusions", "scp_no_output_reasons", "Reasons for missing base output"),
    ("10_top_ml_improvements", "top_ml_improvements", "Largest improvements of the challenger"),
    ("11_top_ml_underperformance", "top_ml_underperformance", "Worst series of the challenger"),
    ("12_data_quality_checks", "data_quality_checks", "Data-quality checks"),
]


def block_index() -> str:
    counts = " UNION ALL ".join(
        f"""SELECT {i} AS "ORDEN", '{sheet}' AS "HOJA", '{block}' AS "BLOQUE", '{title}' AS "TITULO",
            count(*) AS "N_FILAS", CASE WHEN count(*) = 0 THEN '(sin datos)' WHEN '{block}' = 'exclusion_reconciliation' THEN '{RECONCILED}' END AS "NOTA" FROM ({BODIES[block]})"""
        for i, (sheet, block, title) in enumerate(DOCUMENT, start=1)
    )
    return counts


IDS = ("ID", "ID_BATCH", "ID_RUN_STAGING", "SOURCE_RUN_ID", "ID_CONFIGURATION")
AS_TEXT = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in IDS)

# Reports that are also checked without a client list.
ALL_CLIENT_REPORTS = (
    "coverage_by_client", "status_distribution", "exclusion_reasons_by_client", "winner_distribution", "wape_impact",
    "ml_improvement_stats", "win_profiles_by_client", "value_by_dimension", "ml_wins_by_client")

ORACLE_SQL = {
    "series_table": f"WITH {SERIES} SELECT * FROM series",
    "load_comparison": f"WITH {SERIES} SELECT * REPLACE ({AS_TEXT}) FROM series",
    **{name: f"WITH {UNIVERSES} {body}" for name, body in BODIES.items()},
    "block_index": f"WITH {UNIVERSES} {block_index()}",
    "stored_block": f"WITH {UNIVERSES} {BODIES['coverage_by_client']}",
    "one_batch_coverage": f"WITH {UNIVERSES} {BODIES['coverage_by_client']}",
    "other_methods_status": f"""WITH {UNIVERSES}
        SELECT replace(replace("COMPARISON_STATUS", 'SCP', 'AAA'), 'ML', 'BBB') AS "COMPARISON_STATUS", "N", "PCT_SOBRE_CANDIDATAS",
            replace(replace("SIGNIFICADO", 'SCP', 'AAA'), 'ML', 'BBB') AS "SIGNIFICADO" FROM ({STATUS_WITH_MEANING})""",
    **{f"all_clients_{name}": f"WITH {ALL_CLIENTS} {BODIES[name]}" for name in ALL_CLIENT_REPORTS},
}
