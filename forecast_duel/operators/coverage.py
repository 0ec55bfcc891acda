"""Coverage: how many candidates can be compared, and why the others cannot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.operators.clients import in_report_order
from forecast_duel.operators.distribution import (
    distribution_by_client, most_frequent, number_of_rows, share_of_client, shown, value_counts,
)
from forecast_duel.operators.metrics import share, zero_if_absent
from forecast_duel.operators.universe import is_excluded, is_not_comparable
from forecast_duel.settings import COMPARABLE, TOTAL, Settings


def status_meanings(s: Settings) -> list[tuple[str, str]]:
    """Each status with its meaning in the report. The texts, but for the methods' names."""
    return [
        (COMPARABLE, "Serie comparable (incluida en el análisis de performance)."),
        (s.status_missing_both, f"Faltan ambos forecasts ({s.base} y {s.challenger})."),
        (s.status_excluded, f"{s.challenger} excluyó explícitamente la serie (ver más abajo)."),
        ("NOT_COMPARABLE_NO_HISTORY", "No hay histórico útil para evaluar la serie."),
        (s.status_missing(s.base), f"Falta el forecast de {s.base}."),
        (s.status_missing(s.challenger), f"Falta el forecast de {s.challenger}."),
        ("NOT_COMPARABLE_MISSING_VALIDATION", "No hay datos de validación disponibles."),
        ("NOT_COMPARABLE_RUN_FAILED", "El run de cálculo falló."),
    ]


def coverage_by_client(by_label: DataFrame, s: Settings) -> DataFrame:
    candidates, comparable = zero_if_absent("candidates"), zero_if_absent("comparable")
    return by_label.select(
        "ID_CLIENT",
        candidates.alias("SERIES_CANDIDATAS"),
        comparable.alias("SERIES_COMPARABLES"),
        share("comparable", "candidates").alias("PCT_COMPARABLES"),
        (candidates - comparable).alias("SERIES_NO_COMPARABLES"),
        zero_if_absent("excluded").alias(f"SERIES_{s.excluded_flag}"),
        share("excluded", "candidates").alias(f"PCT_{s.excluded_flag}"),
    )


def coverage_wide(by_label: DataFrame, s: Settings) -> DataFrame:
    """Share of the candidates in each state, one row per client."""
    return by_label.select(
        "ID_CLIENT",
        zero_if_absent("candidates").alias("SERIES_CANDIDATAS"),
        zero_if_absent("comparable").alias("SERIES_COMPARABLES"),
        share("comparable", "candidates").alias("PCT_COMPARABLES"),
        share("status_excluded", "candidates").alias(f"PCT_{s.challenger}_EXCLUDED"),
        share("status_missing_base", "candidates").alias(f"PCT_MISSING_{s.base}"),
        share("status_missing_challenger", "candidates").alias(f"PCT_MISSING_{s.challenger}"),
        share("status_missing_both", "candidates").alias(f"PCT_MISSING_{s.base}_AND_{s.challenger}"),
        share("status_no_history", "candidates").alias("PCT_NO_HISTORY"),
    )


def status_distribution(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    return distribution_by_client(candidate_rows, "COMPARISON_STATUS", s, "PCT_SOBRE_CANDIDATAS")


def status_with_meaning(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    """Why candidates are not comparable, over all clients, with an explanation."""
    texts = F.array(*(
        F.struct(F.lit(code).alias("COMPARISON_STATUS"), F.lit(text).alias("SIGNIFICADO"))
        for code, text in status_meanings(s)
    ))
    meaning = candidate_rows.sparkSession.range(0, 1, 1, 1).select(F.inline(texts))
    return (
        status_distribution(candidate_rows, s)
        .filter((F.col("ID_CLIENT") == TOTAL) & (F.col("COMPARISON_STATUS") != COMPARABLE))
        .join(F.broadcast(meaning), "COMPARISON_STATUS", "left")
        .select(
            "COMPARISON_STATUS", "N", "PCT_SOBRE_CANDIDATAS",
            F.coalesce("SIGNIFICADO", F.lit("")).alias("SIGNIFICADO"),
        )
        .orderBy(*most_frequent("COMPARISON_STATUS"))
    )


def exclusion_reasons(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    return value_counts(candidate_rows.filter(is_excluded(s)), s.exclusion_reason, s.null_label)


def exclusion_reasons_by_client(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    counts = (
        candidate_rows.filter(is_excluded(s))
        .groupBy("ID_CLIENT", s.exclusion_reason)
        .agg(number_of_rows(candidate_rows).alias("N"))
    )
    shares = share_of_client(counts, s, "PCT").select(
        "ID_CLIENT", shown(s.exclusion_reason, s.null_label), "N", "PCT"
    )
    return in_report_order(shares, s, *most_frequent(s.exclusion_reason))


def no_output_reasons(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    return value_counts(candidate_rows.filter(is_not_comparable()), s.no_output_reason, s.null_label)


def excluded_flag_distribution(candidate_rows: DataFrame, s: Settings) -> DataFrame:
    return value_counts(candidate_rows, s.excluded_flag)


def exclusion_reconciliation(totals: DataFrame, s: Settings) -> DataFrame:
    """Exclusions by status and by flag; the gap is hidden behind a status of higher rank."""
    by_status, by_flag = F.col("status_excluded"), F.col("excluded")
    return totals.select(
        by_status.alias(f"N_COMPARISON_STATUS_{s.challenger}_EXCLUDED"),
        by_flag.alias(f"N_{s.excluded_flag}_1"),
        (by_flag - by_status).alias("DIFERENCIA"),
    )
