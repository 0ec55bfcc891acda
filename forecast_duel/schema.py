"""The series-comparison table: columns, types, key and report projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from forecast_duel.settings import Settings

KEY = ["ID_BATCH", "ID_RUN_STAGING", "ID_CLIENT", "SOURCE_RUN_ID", "ID_CONFIGURATION"]
VALUE_LEVELS = [f"VALUE_LEVEL_{i}" for i in range(1, 6)]

# Texts that mean "missing" in the CSV input.
NA_TOKENS = [
    "", "NA", "N/A", "n/a", "null", "NULL", "None", "nan", "NaN", "-nan", "-NaN", "<NA>",
    "#NA", "#N/A", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]


def series_schema(settings: Settings = Settings(), id_type: T.DataType | None = None) -> T.StructType:
    """Declared schema of the input, in the order of the data dictionary.

    Identifiers other than the client are only compared for equality; they are text
    unless ``id_type`` says otherwise.
    """
    s, ident = settings, id_type or T.StringType()
    text, flag, number = T.StringType(), T.IntegerType(), T.DoubleType()
    base, challenger = s.base, s.challenger
    columns = [
        *((c, T.LongType() if c == "ID_CLIENT" else ident) for c in ["ID", *KEY]),
        *((c, text) for c in VALUE_LEVELS),
        *((f"{challenger}_{c}", text) for c in ("BEST_MODEL", "CLASSIFICATION", "TYPE", "STATUS")),
        *((f"{base}_{c}", text) for c in ("BEST_MODEL", "CLASSIFICATION", "STATUS")),
        ("SERIES_CLASSIFICATION", text),
        ("COMPARISON_STATUS", text),
        ("HAS_BASE_CANDIDATE", flag),
        (f"HAS_{base}_CALCULATED", flag),
        (f"HAS_{challenger}_CALCULATED", flag),
        (s.excluded_flag, flag),
        (s.exclusion_reason, text),
        (s.no_output_reason, text),
        *((c, number) for c in s.history + s.forecasts(base) + s.forecasts(challenger)),
        (s.total_history, number),
        *((s.abs_error(m), number) for m in (base, challenger)),
        *((s.wape(m), number) for m in (base, challenger)),
        *((c, text) for c in (s.winner, s.winner_model, s.finalist, s.finalist_model)),
        (s.winner_improvement, number),
    ]
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


def ranking_columns(s: Settings = Settings()) -> list[str]:
    """The 21 columns shown for the best and worst series."""
    return [
        "ID_CLIENT", "ID_CONFIGURATION", *VALUE_LEVELS,
        s.total_history, s.wape(s.base), s.wape(s.challenger),
        s.improvement, s.winner_improvement,
        s.winner, s.winner_model, s.finalist, s.finalist_model,
        s.best_model(s.base), s.best_model(s.challenger), *s.series_dimensions,
    ]


def require_columns(df: DataFrame, settings: Settings = Settings()) -> None:
    """Raise one error that names every missing column; runs no job."""
    present = set(df.columns)
    missing = [c for c in series_schema(settings).names if c not in present]
    if missing:
        raise ValueError("Required columns missing from the input: " + ", ".join(missing))
