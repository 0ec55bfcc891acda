"""Reports on tiny hand-made tables: null rules, denominators, clients without rows."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import by, dicts

SCP = {"WINNER_METHOD_6M": "SCP", "WINNER_MODEL_6M": "Naive", "SCP_WAPE_6M": 0.2, "ML_WAPE_6M": 0.3}
OUT = {"COMPARISON_STATUS": "NOT_COMPARABLE_NO_HISTORY"}


def test_universes(compare):
    c = compare({}, {"HAS_BASE_CANDIDATE": 0}, {"HAS_BASE_CANDIDATE": None}, {"ID_CLIENT": 9}, OUT,
                {"COMPARISON_STATUS": None})
    assert (c.candidates.count(), c.comparables.count()) == (3, 1)


def test_empty_client_selection_is_an_error_but_no_candidate_is_not(compare):
    with pytest.raises(ValueError, match="client filter"):
        compare({"ID_CLIENT": 9}).require_rows()
    assert compare({"HAS_BASE_CANDIDATE": 0}).require_rows().candidates.count() == 0


def test_improvement_is_null_where_undefined(compare):
    c = compare({}, {"SCP_WAPE_6M": 0.0}, {"SCP_WAPE_6M": None}, {"ML_WAPE_6M": None}, {"SCP_WAPE_6M": float("nan")})
    values = [r.ML_IMPROVEMENT_VS_SCP_6M for r in c.report("ml_improvement_by_series").orderBy("ID").collect()]
    assert values == [pytest.approx(25.0), None, None, None, None]


def test_coverage_counts_a_null_status_as_not_comparable(compare):
    c = compare({}, OUT, {"COMPARISON_STATUS": None, "HAS_ML_EXCLUDED": 1}, {"ID_CLIENT": 2, "HAS_ML_EXCLUDED": None, **OUT})
    rows = dicts(c.report("coverage_by_client"))
    assert [r["ID_CLIENT"] for r in rows] == ["TOTAL", "1", "2", "3"]
    total, one, two, none = (tuple(r.values())[1:] for r in rows)
    assert total == (4, 1, 25.0, 3, 1, 25.0)
    assert one == (3, 1, pytest.approx(100 / 3), 2, 1, pytest.approx(100 / 3))
    assert two == (1, 0, 0.0, 1, 0, 0.0)
    assert none == (0, 0, None, 0, 0, None)


def test_every_report_survives_an_empty_candidate_set(compare):
    from forecast_duel import REPORTS

    c = compare({"HAS_BASE_CANDIDATE": 0})
    counts = {name: c.report(name).count() for name in REPORTS}
    spine = {"coverage_by_client", "coverage_wide", "wape_impact", "ml_improvement_stats", "formatted_kpis"}
    one = {"exclusion_reconciliation", "global_summary", "ml_win_summary", "scp_win_summary", "dq_issue_count",
           "verdict", "ml_win_improvement_stats", "scp_win_improvement_stats"}
    special = {"ml_wins_by_client": 3, "scp_wins_by_client": 3, "chart_coverage": 3, "data_quality_checks": 7,
               "chart_wape": 2, "improvement_histogram": 40}
    expected = {n: 4 if n in spine else 1 if n in one else special.get(n, 0) for n in REPORTS}
    assert counts == expected
    assert c.report("verdict").first().VEREDICTO == "UNDEFINED"
    assert c.report("global_summary").first().PCT_COMPARABLES is None
    assert c.report("ml_win_improvement_stats").first().asDict() == {
        "GRUPO": "TODAS (gana ML)", "count": 0, "mean": None, "median": None, "p10": None, "p25": None, "p75": None,
        "p90": None, "min": None, "max": None}


def test_status_distribution_drops_null_but_keeps_it_in_the_denominator(compare):
    c = compare({}, {}, {"COMPARISON_STATUS": None}, {"ID_CLIENT": 2, **OUT})
    rows = [tuple(r) for r in c.report("status_distribution").collect()]
    assert rows == [
        ("TOTAL", "COMPARABLE", 2, 50.0), ("TOTAL", "NOT_COMPARABLE_NO_HISTORY", 1, 25.0),
        ("1", "COMPARABLE", 2, pytest.approx(200 / 3)), ("2", "NOT_COMPARABLE_NO_HISTORY", 1, 100.0),
    ]


def test_status_meaning_of_known_and_unknown_codes(compare):
    c = compare({}, OUT, {"COMPARISON_STATUS": "NOT_COMPARABLE_RUN_FAILED"}, {"COMPARISON_STATUS": "OTHER"})
    rows = by(c.report("status_with_meaning"), "COMPARISON_STATUS")
    assert set(rows) == {"NOT_COMPARABLE_NO_HISTORY", "NOT_COMPARABLE_RUN_FAILED", "OTHER"}
    assert rows["OTHER"]["SIGNIFICADO"] == "" and rows["NOT_COMPARABLE_RUN_FAILED"]["SIGNIFICADO"]
    assert rows["OTHER"]["PCT_SOBRE_CANDIDATAS"] == 25.0


def test_reasons_keep_the_null_bucket(compare):
    out = {"HAS_ML_EXCLUDED": 1, "COMPARISON_STATUS": "NOT_COMPARABLE_ML_EXCLUDED"}
    c = compare(
        {**out, "ML_EXCLUSION_REASON": "NewRelease"}, {**out, "ML_EXCLUSION_REASON": "NewRelease"}, out,
        {**out, "ID_CLIENT": 2, "COMPARISON_STATUS": None, "SCP_NO_OUTPUT_REASON": "X"}, {"SCP_NO_OUTPUT_REASON": "Y"},
    )
    assert [tuple(r) for r in c.report("exclusion_reasons").collect()] == [("NewRelease", 2, 50.0), (None, 2, 50.0)]
    assert [tuple(r) for r in c.report("exclusion_reasons_by_client").collect()] == [
        (1, "NewRelease", 2, pytest.approx(200 / 3)), (1, None, 1, pytest.approx(100 / 3)), (2, None, 1, 100.0)]
    assert [tuple(r) for r in c.report("scp_no_output_reasons").collect()] == [(None, 3, 75.0), ("X", 1, 25.0)]
    assert tuple(c.report("exclusion_reconciliation").first()) == (3, 4, 1)


def test_value_counts_can_drop_or_name_the_null(compare):
    from forecast_duel.operators.distribution import value_counts

    rows = compare({"ML_TYPE": None}, {}, {}).candidates
    assert [tuple(r) for r in value_counts(rows, "ML_TYPE", drop_null=True).collect()] == [("Smooth", 2, 100.0)]
    assert [r[0] for r in value_counts(rows, "ML_TYPE", null_label="nan").collect()] == ["Smooth", "nan"]


def test_missing_reasons_and_models_can_be_labelled(compare):
    out = {"HAS_ML_EXCLUDED": 1, **OUT}
    c = compare(out, {"WINNER_MODEL_6M": None, "HAS_ML_EXCLUDED": 0}, null_label="nan")
    assert tuple(c.report("exclusion_reasons").first()) == ("nan", 1, 100.0)
    assert tuple(c.report("exclusion_reasons_by_client").first()) == (1, "nan", 1, 100.0)
    assert tuple(c.report("scp_no_output_reasons").first()) == ("nan", 1, 100.0)
    assert tuple(c.report("ml_win_profiles").first()) == ("WINNER_MODEL_6M", "nan", 1, 100.0)


def test_wins_over_all_comparables_and_chart_over_decided_ones(compare):
    c = compare({}, {}, SCP, {"WINNER_METHOD_6M": None}, {"WINNER_METHOD_6M": "OTHER"}, {"ID_CLIENT": 2, **SCP})
    assert tuple(c.report("ml_win_summary").first()) == (2, pytest.approx(100 / 3), 6)
    assert tuple(c.report("scp_win_summary").first()) == (2, pytest.approx(100 / 3), 6)
    assert [tuple(r) for r in c.report("ml_wins_by_client").collect()] == [(1, 5, 2, 40.0), (2, 1, 0, 0.0), (3, 0, 0, None)]
    total = [tuple(r)[1:] for r in c.report("winner_distribution").collect() if r.ID_CLIENT == "TOTAL"]
    assert total == [("ML", 2, pytest.approx(100 / 3)), ("SCP", 2, pytest.approx(100 / 3)), ("OTHER", 1, pytest.approx(100 / 6))]
    assert [tuple(r) for r in c.report("chart_winners").collect()] == [(1, "ML", 2, 40.0), (2, "SCP", 2, 40.0)]


def test_weighted_wape(compare):
    c = compare({}, {"ID_CLIENT": 2, "TOTAL_HISTORY_6M": 0.0}, {"ID_CLIENT": 3, "SCP_TOTAL_ABS_ERROR_6M": None, "ML_TOTAL_ABS_ERROR_6M": None}, OUT)
    rows = by(c.report("wape_impact"), "ID_CLIENT")
    assert tuple(rows["1"].values())[1:] == (1, 0.2, 0.15, pytest.approx(25.0))
    assert tuple(rows["2"].values())[1:] == (1, None, None, None)
    assert tuple(rows["3"].values())[1:] == (1, 0.0, 0.0, None)  # an error that is null everywhere counts as 0
    assert tuple(rows["TOTAL"].values())[1:] == (3, 0.2, 0.15, pytest.approx(25.0))
    assert [r.WAPE_PCT for r in c.report("chart_wape").collect()] == [20.0, 15.0]


def test_decimal_sums_do_not_depend_on_order(compare):
    errors = [0.1, 0.2, 0.3, 1e9, -1e9 + 0.4] * 20
    rows = [{"SCP_TOTAL_ABS_ERROR_6M": e, "TOTAL_HISTORY_6M": 1.0} for e in errors]
    forward, backward = (compare(*r, sum_scale=2) for r in (rows, rows[::-1]))
    for name in ("wape_impact", "value_by_dimension"):
        assert forward.report(name).collect() == backward.report(name).collect()
    assert forward.report("wape_impact").first().SCP_WAPE_GLOBAL == 0.2
    assert forward.report("wape_impact").dtypes == compare({}).report("wape_impact").dtypes


def test_views(spark, compare):
    compare({}, SCP).create_views("v_")
    found = spark.sql("SELECT METODO, N FROM v_chart_winners ORDER BY ORDEN").collect()
    assert [tuple(r) for r in found] == [("ML", 1), ("SCP", 1)]


def test_very_long_client_list_is_not_broadcast_by_hint(compare):
    c = compare({}, {"ID_CLIENT": 15000}, clients=tuple(range(1, 20001)))
    rows = c.report("ml_wins_by_client").filter("N_COMPARABLES > 0").collect()
    assert [r.ID_CLIENT for r in rows] == [1, 15000]


def test_verdict(compare):
    good = compare({}, SCP).report("verdict").first()
    assert (good.VEREDICTO, good.MEDIANA_MEJORA_ML, good.N_TIE) == ("IMPROVES", 25.0, 0)
    assert good.MEDIANA_PERDIDA_ML == pytest.approx(50.0)
    equal = compare({"ML_TOTAL_ABS_ERROR_6M": 20.0}).report("verdict").first()
    assert (equal.VEREDICTO, equal.MEJORA_PCT) == ("NOT_IMPROVED", 0.0)
    assert compare({"TOTAL_HISTORY_6M": None}).report("verdict").first().VEREDICTO == "UNDEFINED"


def test_global_summary(compare):
    row = compare({}, SCP, {"WINNER_METHOD_6M": None}, OUT).report("global_summary").first()
    assert tuple(row)[:4] == ("1, 2, 3", 4, 3, 75.0)
    assert tuple(row)[-3:] == (pytest.approx(100 / 3), pytest.approx(100 / 3), 0.0)


def test_profiles_keep_null_values_and_share_one_denominator(compare):
    c = compare({}, {}, {"ML_TYPE": None}, SCP)
    rows = [tuple(r) for r in c.report("ml_win_profiles").collect()]
    assert [r for r in rows if r[0] == "ML_TYPE"] == [
        ("ML_TYPE", "Smooth", 2, pytest.approx(200 / 3)), ("ML_TYPE", None, 1, pytest.approx(100 / 3))]
    assert rows[0] == ("WINNER_MODEL_6M", "AutoETS", 3, 100.0)
    lost = [tuple(r) for r in c.report("scp_win_profiles").collect()]
    assert lost[0] == ("SCP_BEST_MODEL", "Naive", 1, 100.0) and len(lost) == 5
    both = [tuple(r) for r in c.report("win_profiles_by_client").collect()]
    assert ("SCP", 1, "SCP_BEST_MODEL", "Naive", 1, 100.0) in both
    assert not [r for r in both if r[0] == "SCP" and r[2] == "WINNER_MODEL_6M"]


def test_value_by_dimension(compare):
    c = compare({}, {"ML_TYPE": "Lumpy", "ML_TOTAL_ABS_ERROR_6M": 5.0}, SCP)
    rows = {(r.GANADOR, r.DIMENSION, r.VALOR): r for r in c.report("value_by_dimension").collect()}
    lumpy = rows["ML", "ML_TYPE", "Lumpy"]
    assert (lumpy.N, lumpy.REDUCCION_ERROR, lumpy.PCT_REDUCCION_ERROR) == (1, 15.0, 75.0)
    assert (lumpy.SCP_WAPE, lumpy.ML_WAPE) == (0.2, 0.05)


def test_top_winner_models_keep_the_null_model_in_the_denominator(compare):
    models = ["A", "A", "B", "C", "D", "E", "F", None]
    rows = compare(*({"WINNER_MODEL_6M": m} for m in models)).report("top_winner_models").collect()
    assert [tuple(r) for r in rows] == [("A", 2, 25.0), *((m, 1, 12.5) for m in "BCDE")]


def test_ranking_breaks_ties_by_key_and_puts_null_last(compare):
    rows = [{"ID_CONFIGURATION": f"{i:02}", "WINNER_IMPROVEMENT_PCT_6M": 50.0 if i < 19 else 40.0} for i in range(25)]
    rows.append({"WINNER_IMPROVEMENT_PCT_6M": None, "ID_CONFIGURATION": "00"})
    top = compare(*rows).report("top_ml_improvements")
    assert [r.ID_CONFIGURATION for r in top.collect()] == [f"{i:02}" for i in range(20)]
    assert len(top.columns) == 21
    few = compare({"WINNER_IMPROVEMENT_PCT_6M": None}, {}).report("top_ml_improvements").collect()
    assert [r.WINNER_IMPROVEMENT_PCT_6M for r in few] == [25.0, None]
    worst = compare(SCP, {**SCP, "ML_WAPE_6M": 0.5}, {**SCP, "SCP_WAPE_6M": 0.0}).report("top_ml_underperformance").collect()
    assert [r.ML_IMPROVEMENT_VS_SCP_6M for r in worst] == [pytest.approx(-150.0), pytest.approx(-50.0), None]


def test_quality_checks(compare):
    same = {"ID_CONFIGURATION": "7", "SOURCE_RUN_ID": None}
    c = compare(
        same, same, same,
        {"HISTORY_M1": None}, {"SCP_FORECAST_M1": None}, {"ML_FORECAST_M1": None, "ML_FORECAST_M6": 1.0},
        {"WINNER_METHOD_6M": None, "ML_WAPE_6M": None},
        {"HAS_ML_EXCLUDED": 1, **OUT}, {"HAS_ML_EXCLUDED": 1, "ML_EXCLUSION_REASON": "ShortSeries", **OUT},
    )
    rows = [tuple(r)[1:] for r in c.report("data_quality_checks").collect()]
    assert rows == [
        (2, 9, pytest.approx(200 / 9), "REVISAR"), (1, 7, pytest.approx(100 / 7), "REVISAR"),
        (1, 7, pytest.approx(100 / 7), "REVISAR"), (0, 7, 0.0, "OK"), (1, 7, pytest.approx(100 / 7), "REVISAR"),
        (1, 7, pytest.approx(100 / 7), "REVISAR"), (1, 2, 50.0, "REVISAR"),
    ]
    assert c.report("dq_issue_count").first()[0] == 6
    assert {r.ESTADO for r in compare({}).report("data_quality_checks").collect()} == {"OK"}


def improvements(values):
    return [{"SCP_WAPE_6M": 1.0, "ML_WAPE_6M": 1.0 - float(v) / 100} for v in values]


HISTOGRAM_CASES = [
    np.random.default_rng(1).normal(0, 80, 300).round(1),
    np.random.default_rng(2).normal(0, 80, 300).round(1),
    range(-100, 101, 5),  # values on and next to the edges
    np.arange(-50, 51, 2.5),
]


@pytest.mark.parametrize("values", HISTOGRAM_CASES)
def test_histogram_equals_numpy(compare, values):
    c = compare(*improvements(values))
    exact = [r[0] for r in c.comparables.select("ML_IMPROVEMENT_VS_SCP_6M").collect()]
    counts, edges = np.histogram(np.clip(exact, -100, 100), bins=40)
    rows = c.report("improvement_histogram").collect()
    assert [r.N for r in rows] == counts.tolist()
    assert [r.DESDE for r in rows] + [rows[-1].HASTA] == pytest.approx(edges.tolist())


def test_histogram_of_one_value(compare):
    one = compare(*improvements([50.0])).report("improvement_histogram").collect()
    assert (one[0].DESDE, one[-1].HASTA, sum(r.N for r in one), one[20].N) == (49.5, 50.5, 1, 1)


def test_formatting(spark):
    from pyspark.sql import functions as F

    from forecast_duel.functions import format_count, format_percent

    rows = [(0.25, 1234567), (0.35, 999), (-27.55, 0), (12345.678, -1234), (None, None)]
    df = spark.createDataFrame(rows, "p double, n long").select(format_percent(F.col("p")), format_count(F.col("n")))
    assert [r[0] for r in df.collect()] == [*(f"{p:.1f}%" for p, _ in rows[:-1]), "n/d"]
    assert [r[1] for r in df.collect()] == ["1.234.567", "999", "0", "-1.234", "n/d"]


def test_other_methods_and_windows_pick_other_columns():
    from forecast_duel import Settings
    from forecast_duel.schema import series_schema

    names = series_schema(Settings(base="OLD", challenger="NEW", months=3)).names
    assert {"HAS_NEW_EXCLUDED", "OLD_WAPE_3M", "NEW_FORECAST_M3", "WINNER_METHOD_3M"} <= set(names)
    assert "HISTORY_M4" not in names


def test_long_client_list(compare):
    c = compare({}, {"ID_CLIENT": 1500}, {"ID_CLIENT": 9999}, clients=tuple(range(1, 2001)))
    rows = c.report("coverage_by_client").collect()
    assert [r.ID_CLIENT for r in rows] == ["TOTAL", *(str(i) for i in range(1, 2001))]
    assert (rows[0].SERIES_CANDIDATAS, rows[1500].SERIES_CANDIDATAS) == (2, 1)
    assert [tuple(r)[::2] for r in c.report("status_distribution").collect()] == [("TOTAL", 2), ("1", 1), ("1500", 1)]
    assert [r.ID_CLIENT for r in c.report("win_profiles_by_client").collect()] == [1] * 5 + [1500] * 5


def test_all_clients_and_batches(compare):
    rows = ({}, {"ID_CLIENT": 30, "ID_BATCH": "2"}, {"ID_CLIENT": 4}, {"ID_CLIENT": None})
    c = compare(*rows, clients=None)
    assert [r.ID_CLIENT for r in c.report("coverage_by_client").collect()] == ["TOTAL", "1", "4", "30", None]
    assert c.report("coverage_by_client").first().SERIES_CANDIDATAS == 4
    assert [r.ID_CLIENT for r in c.report("ml_wins_by_client").collect()] == [1, 4, 30, None]
    assert [(r.GRUPO, r["count"]) for r in c.report("ml_improvement_stats").collect()] == [
        ("TOTAL", 4), ("1", 1), ("4", 1), ("30", 1), (None, 1)]
    assert {(r.ID_CLIENT, r.N) for r in c.report("status_distribution").collect()} == {
        ("TOTAL", 4), ("1", 1), ("4", 1), ("30", 1), (None, 1)}
    assert {r.PCT for r in c.report("win_profiles_by_client").collect()} == {100.0}
    assert compare(*rows, batches=("2",), clients=None).candidates.count() == 1


def test_infinite_errors_have_no_improvement(compare):
    inf = float("inf")
    c = compare({"SCP_WAPE_6M": 1.0, "ML_WAPE_6M": 1.1}, {"SCP_WAPE_6M": inf, "ML_WAPE_6M": 0.1}, {"SCP_WAPE_6M": inf, "ML_WAPE_6M": inf})
    stats = c.report("ml_improvement_stats").first()
    assert stats["count"] == 1 and stats["median"] == pytest.approx(-10.0)
    assert sum(r.N for r in c.report("improvement_histogram").collect()) == 1


def test_reports_run_with_other_method_names_and_months(spark):
    from forecast_duel import REPORTS, Comparison, Settings
    from forecast_duel.schema import series_schema

    s = Settings(clients=(1,), base="AAA", challenger="BBB", months=3)
    schema = series_schema(s)
    row = {"ID": "1", "ID_CLIENT": 1, "HAS_BASE_CANDIDATE": 1, "COMPARISON_STATUS": s.status_missing("AAA")}
    c = Comparison.of(spark.createDataFrame([[row.get(n) for n in schema.names]], schema), s)
    for name in REPORTS:
        c.report(name).collect()
    assert [tuple(r)[::3] for r in c.report("status_with_meaning").collect()] == [
        ("NOT_COMPARABLE_MISSING_AAA", "Falta el forecast de AAA.")]
