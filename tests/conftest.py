from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from forecast_duel import Comparison, Settings  # noqa: E402
from forecast_duel.schema import series_schema  # noqa: E402
from forecast_duel.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"
CLIENTS = (1, 2, 3)

# A comparable series in which the challenger saves a quarter of the base error.
DEFAULT = {
    "ID_BATCH": "1", "ID_RUN_STAGING": "10", "ID_CLIENT": 1, "SOURCE_RUN_ID": "500",
    "COMPARISON_STATUS": "COMPARABLE", "HAS_BASE_CANDIDATE": 1, "HAS_SCP_CALCULATED": 1,
    "HAS_ML_CALCULATED": 1, "HAS_ML_EXCLUDED": 0, "HISTORY_M1": 100.0, "SCP_FORECAST_M1": 80.0,
    "ML_FORECAST_M1": 85.0, "TOTAL_HISTORY_6M": 100.0, "SCP_TOTAL_ABS_ERROR_6M": 20.0,
    "ML_TOTAL_ABS_ERROR_6M": 15.0, "SCP_WAPE_6M": 0.20, "ML_WAPE_6M": 0.15, "WINNER_METHOD_6M": "ML",
    "WINNER_MODEL_6M": "AutoETS", "FINALIST_METHOD_6M": "ML", "FINALIST_MODEL_6M": "AutoETS",
    "SCP_BEST_MODEL": "Naive", "ML_BEST_MODEL": "AutoETS", "ML_CLASSIFICATION": "A", "ML_TYPE": "Smooth",
    "SERIES_CLASSIFICATION": "High", "WINNER_IMPROVEMENT_PCT_6M": 25.0,
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a comparison table from rows that state only what differs from the default."""

    def build(*rows: dict):
        schema = series_schema()
        full = [
            {"ID": str(i), "ID_CONFIGURATION": str(i), **DEFAULT, **row} for i, row in enumerate(rows, start=1)
        ]
        return spark.createDataFrame([[row.get(c) for c in schema.names] for row in full], schema)

    return build


@pytest.fixture
def compare(table):
    def build(*rows: dict, **settings):
        return Comparison.of(table(*rows), Settings(**{"clients": CLIENTS, **settings}))

    return build


def dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def by(df, key: str) -> dict:
    return {row[key]: row.asDict() for row in df.collect()}
