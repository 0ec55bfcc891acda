"""Exact percentiles against numpy, on distributions that are hard for slots."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import by
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from forecast_duel.operators.statistics import FRACTIONS, describe

CASES = {
    "one_to_five": [1.0, 2.0, 3.0, 4.0, 5.0],
    "single": [7.5],
    "pair": [-1.0, 1.0],
    "one_value_holds_a_third": [0.0] * 500 + np.random.default_rng(1).normal(0, 1, 1000).tolist(),
    "heavy_tail": (np.random.default_rng(2).standard_cauchy(2000) * 100).tolist(),
    "narrow": (1e6 + np.random.default_rng(3).random(1500) * 1e-6).tolist(),
    "many_magnitudes": (10 ** np.random.default_rng(4).uniform(-300, 300, 800)).tolist(),
    "negative_tail": (100 - 10 ** np.random.default_rng(5).uniform(0, 6, 1200)).tolist(),
    "all_equal": [-33.25] * 400,
    "signed_zero": [0.0, -0.0, 0.0, 1e-320, -1e-320],
}


def frame(spark, groups):
    return spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "GRUPO string, value double")


def expected(values):
    v = np.array([x for x in values if x is not None])
    return {
        "count": len(v), "mean": v.mean(), "min": v.min(), "max": v.max(),
        **{name: np.quantile(v, f) for name, f in FRACTIONS.items()},
    }


def test_exact_statistics_equal_numpy(spark):
    rows = by(describe(frame(spark, CASES)), "GRUPO")
    for name, values in CASES.items():
        row = rows[name]
        for key, value in expected(values).items():
            assert row[key] == pytest.approx(value, rel=1e-9, abs=1e-300), (name, key)


def test_known_percentiles(spark):
    row = describe(frame(spark, {"x": [1.0, 2.0, 3.0, 4.0, 5.0, None]})).first()
    assert [row[k] for k in ("count", "p10", "p25", "median", "p75", "p90")] == [
        5, 1.4, 2.0, 3.0, 4.0, pytest.approx(4.6)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    row = describe(frame(spark, {"x": values})).first()
    for key, value in expected(values).items():
        assert row[key] == pytest.approx(value, rel=1e-9, abs=1e-6), key


def test_partitioning_and_order_do_not_matter(spark):
    df = frame(spark, {k: CASES[k] for k in ("heavy_tail", "one_value_holds_a_third")})
    names = ["median", "p10", "p25", "p75", "p90", "count", "min", "max"]
    one = by(describe(df.coalesce(1)), "GRUPO")
    other = by(describe(df.repartition(13).orderBy("value")), "GRUPO")
    assert {g: [r[n] for n in names] for g, r in one.items()} == {g: [r[n] for n in names] for g, r in other.items()}


def test_approximate_percentiles_are_close(spark):
    values = CASES["negative_tail"]
    row = describe(frame(spark, {"x": values}), approx=True).first()
    ordered = np.sort(values)
    for name, f in FRACTIONS.items():
        rank = np.searchsorted(ordered, row[name])
        assert abs(rank - f * len(values)) <= 2
    assert row["count"] == len(values)


def test_unbounded_number_of_groups(spark):
    df = frame(spark, {str(i): [float(i), float(i + 1)] for i in range(300)})
    rows = by(describe(df), "GRUPO")
    assert len(rows) == 300 and rows["17"]["median"] == 17.5


def test_infinite_and_missing_values(spark):
    inf = float("inf")
    row = describe(frame(spark, {"x": [1.0, inf, inf, inf, inf, float("nan"), None]})).first()
    assert [row[k] for k in ("count", "min", "median", "p25", "p75", "p90", "max")] == [5, 1.0, inf, inf, inf, inf, inf]
    row = describe(frame(spark, {"x": [-inf, -inf, 0.0, 10.0, 20.0]})).first()
    assert (row["median"], row["p10"], row["p75"]) == (0.0, -inf, 10.0)


def test_values_packed_closely_beside_far_ones(spark):
    values = [1e6 + i * 1e-7 for i in range(900)] + [-1e6, 3e6]
    row = describe(frame(spark, {"x": values})).first()
    assert row["median"] == pytest.approx(float(np.median(values)), rel=1e-15)


def test_total_is_over_all_groups(spark):
    groups = {"a": CASES["heavy_tail"], "b": CASES["negative_tail"], "c": [1.0]}
    rows = by(describe(frame(spark, groups), total=True), "GRUPO")
    assert set(rows) == {"TOTAL", *groups}
    for key, value in expected([v for vs in groups.values() for v in vs]).items():
        assert rows["TOTAL"][key] == pytest.approx(value, rel=1e-9), key
