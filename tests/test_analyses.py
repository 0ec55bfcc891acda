"""The analyses beyond the document: small cases, identities, plans; their registered queries are compared with SQL in test_plans."""

from __future__ import annotations

import math
import random

import pytest
from conftest import TESTDATA, by, dicts
from pyspark.sql import functions as F
from test_plans import physical

import __spark_entry__ as entry
from forecast_duel.operators import bands, bootstrap, difference, months
from forecast_duel.plans import ANALYSES, RUN_ANALYSES, StoredTables, batch_changes_by_client, batch_difference
from forecast_duel.settings import Settings

S = Settings()


def test_previous_run_skips_gaps_and_repeated_series(compare):
    c = compare(
        {"ID": "a", "ID_CONFIGURATION": "1", "ID_BATCH": "1"}, {"ID": "b", "ID_CONFIGURATION": "1", "ID_BATCH": "1", "ML_WAPE_6M": 0.3},
        {"ID": "c", "ID_CONFIGURATION": "1", "ID_BATCH": "3", "WINNER_METHOD_6M": "SCP"}, {"ID": "d", "ID_CONFIGURATION": "1", "ID_BATCH": "3"},
        {"ID": "e", "ID_CONFIGURATION": "2", "ID_BATCH": "3"}, {"ID": "f", "ID_CONFIGURATION": None, "ID_BATCH": "1"},
        {"ID": "g", "ID_CONFIGURATION": None, "ID_BATCH": "2"}, {"ID": "h", "ID_CONFIGURATION": "1", "ID_BATCH": None})
    found = by(RUN_ANALYSES["previous_runs"](c), "ID")
    assert len(found) == 8
    assert {i: found[i]["ANTERIOR_ID_BATCH"] for i in found} == {
        "a": None, "b": None, "c": "1", "d": "1", "e": None, "f": None, "g": "1", "h": None}
    assert found["c"]["ANTERIOR_ML_WAPE_6M"] == 0.15 and found["c"]["ANTERIOR_WINNER_METHOD_6M"] == "ML"
    changes = {(r["ID_BATCH"], r["ID_CLIENT"]): r for r in dicts(RUN_ANALYSES["run_changes_by_client"](c))}
    total = changes["3", "TOTAL"]
    assert (total["N_SERIES"], total["N_CON_ANTERIOR"], total["N_MISMO_GANADOR"], total["N_PASA_A_SCP"], total["N_PASA_A_ML"]) == (3, 2, 1, 1, 0)
    assert total["CAMBIO_ML_WAPE"] == 0.0 and changes["1", "TOTAL"]["ML_WAPE"] is None


def test_kinds_of_change(compare):
    c = compare(
        {"ID_CONFIGURATION": "same", "ID_BATCH": "1"}, {"ID_CONFIGURATION": "same", "ID_BATCH": "2", "ID_RUN_STAGING": "77"},
        {"ID_CONFIGURATION": "gone", "ID_BATCH": "1"}, {"ID_CONFIGURATION": "new", "ID_BATCH": "2"},
        {"ID_CONFIGURATION": "status", "ID_BATCH": "1"}, {"ID_CONFIGURATION": "status", "ID_BATCH": "2", "COMPARISON_STATUS": None},
        {"ID_CONFIGURATION": "value", "ID_BATCH": "1"}, {"ID_CONFIGURATION": "value", "ID_BATCH": "2", "ML_WAPE_6M": None, "ML_TYPE": "x"},
        {"ID_CONFIGURATION": "other", "ID_BATCH": "1"}, {"ID_CONFIGURATION": "other", "ID_BATCH": "2", "ML_TYPE": None},
        {"ID_CONFIGURATION": None, "ID_BATCH": "1"}, {"ID_CONFIGURATION": None, "ID_BATCH": "2"}, {"ID_CONFIGURATION": None, "ID_BATCH": "2"},
        {"ID_CONFIGURATION": "later", "ID_BATCH": "3"})
    found = {r["ID_CONFIGURATION"]: (r["CAMBIO"], r["N_ANTES"], r["N_AHORA"], r["COLUMNAS"]) for r in dicts(batch_difference(c, "1", "2"))}
    watched = ", ".join(difference.compared_values(S))
    assert found == {
        "same": ("IGUAL", 1, 1, ""), "gone": ("SALE", 1, 0, ""), "new": ("ENTRA", 0, 1, ""),
        "status": ("CAMBIA_ESTADO", 1, 1, "COMPARISON_STATUS"), "value": ("CAMBIAN_VALORES", 1, 1, "ML_WAPE_6M"),
        "other": ("CAMBIAN_VALORES", 1, 1, ""), None: ("CAMBIA_ESTADO", 1, 2, watched)}
    assert by(batch_changes_by_client(c, "1", "2"), "ID_CLIENT")["TOTAL"] == {
        "ID_CLIENT": "TOTAL", "N_ENTRA": 1, "N_SALE": 1, "N_IGUAL": 1, "N_CAMBIA_ESTADO": 2, "N_CAMBIAN_VALORES": 2}


def test_difference_agrees_with_except_all(spark):
    c = entry.runs(spark, f"{TESTDATA}/sf0.001")
    values = [x for x in c.candidates.columns if x not in ("ID", "ID_BATCH", "ID_RUN_STAGING", "SOURCE_RUN_ID", S.improvement)]
    old, new = (c.candidates.where(f"ID_BATCH = {b}").select(*values) for b in (2, 3))
    key = ["ID_CLIENT", "ID_CONFIGURATION"]
    left = {tuple(r) for r in old.exceptAll(new).unionByName(new.exceptAll(old)).select(*key).collect()}
    found = batch_difference(c, 2, 3)
    assert {(r.ID_CLIENT, r.ID_CONFIGURATION) for r in found.where("CAMBIO <> 'IGUAL'").collect()} == left
    assert {r.CAMBIO for r in found.select("CAMBIO").distinct().collect()} == set(difference.KINDS)
    assert "Join" not in physical(found)
    assert batch_difference(c, 98, 99).count() == 0


def test_hierarchy_rolls_up_groups_not_rows(compare):
    c = compare({"VALUE_LEVEL_1": "n"}, {"VALUE_LEVEL_1": "n", "VALUE_LEVEL_2": "x", "COMPARISON_STATUS": None}, {"VALUE_LEVEL_1": None})
    found = ANALYSES["value_hierarchy"](c)
    rows = dicts(found)
    assert [(r["NIVEL"], r["VALUE_LEVEL_1"], r["SERIES_CANDIDATAS"]) for r in rows if r["NIVEL"] < 2] == [(0, None, 3), (1, None, 1), (1, "n", 2)]
    assert [(r["VALUE_LEVEL_1"], r["VALUE_LEVEL_2"], r["SERIES_COMPARABLES"]) for r in rows if r["NIVEL"] == 5] == [(None, None, 1), ("n", None, 1), ("n", "x", 0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Printed from the top: the rows are added up (last in the text) before they are expanded.
    assert plan.rindex("HashAggregate") > plan.index("Expand") and plan.count("Expand") >= 1
    assert [r["NIVEL"] for r in dicts(ANALYSES["value_hierarchy"](compare({"ID_CLIENT": 99})))] in ([], [0])


def test_concentration(compare):
    errors = [50.0, 30.0, 15.0, 5.0, 0.0, None, math.inf]
    c = compare(*({"SCP_TOTAL_ABS_ERROR_6M": e, "ML_TOTAL_ABS_ERROR_6M": 1.0} for e in errors))
    found = [r for r in dicts(ANALYSES["error_concentration"](c)) if r["METODO"] == "SCP"]
    assert [(r["ERROR"], r["PCT_ACUMULADO"]) for r in found] == [(50.0, 50.0), (30.0, 80.0)]
    summary = {(r["METODO"], r["ID_CLIENT"]): r for r in dicts(ANALYSES["concentration_by_client"](c))}
    assert (summary["SCP", "TOTAL"]["N_SERIES"], summary["SCP", "1"]["N_CONCENTRAN"], summary["ML", "1"]["N_CONCENTRAN"]) == (4, 2, 6)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(4)
    values = [None, float("nan"), math.inf, -math.inf, 0.0, -1.0, 1.0, *(rng.uniform(-300, 300) for _ in range(200)), *(float(i) for i in range(-20, 20))]
    limits = [(None, -50.0), (-50.0, 0.0), (-3.0, 7.0), (0.0, 1.0), (1.0, 1.0), (5.0, 2.0), (10.0, 10.5), (100.0, None), (None, None), (1e300, None)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    table = spark.createDataFrame([(f"b{i}", lo, hi) for i, (lo, hi) in enumerate(limits)], "BANDA string, DESDE double, HASTA double")
    want = set()
    for i, v in enumerate(values):
        mine = [] if v is None or math.isnan(v) else [
            f"b{k}" for k, (lo, hi) in enumerate(limits)
            if (lo is None or v >= lo) and (hi is None or v < hi) and (lo is None or hi is None or lo < hi)]
        want |= {(i, b) for b in mine or [None]}
    found = bands.interval_join(rows, "v", table)
    assert sorted(map(str, ((r.id, r.BANDA) for r in found.collect()))) == sorted(map(str, want))
    assert "NestedLoop" not in physical(found) and "Cartesian" not in physical(found)
    assert bands.interval_join(rows, "v", table.limit(0)).count() == len(values)


def test_months_without_values(compare):
    full = {f"HISTORY_M{i}": 10.0 for i in range(1, 7)} | {f"ML_FORECAST_M{i}": 10.0 + i for i in range(1, 7)}
    none = {f"SCP_FORECAST_M{i}": None for i in range(1, 7)}
    c = compare({**full, **none, "ML_TOTAL_ABS_ERROR_6M": 21.0}, {**full, **none, "HISTORY_M6": None, "ML_TOTAL_ABS_ERROR_6M": 22.0})
    one, two = sorted(dicts(months.monthly_accuracy(c.comparables, S)), key=lambda r: r["ID"])
    assert (one["ML_SESGO"], one["ML_PEOR_MES"], one["ML_ERROR_RECALCULADO"], one["ML_ESTADO"]) == (21 / 60, 6, 21.0, "OK")
    assert (one["SCP_SESGO"], one["SCP_PEOR_MES"], one["SCP_ERROR_RECALCULADO"], one["SCP_ESTADO"]) == (None, None, None, "SIN_DATOS")
    assert (two["ML_ERROR_RECALCULADO"], two["ML_DIFERENCIA"], two["ML_ESTADO"]) == (31.0, 9.0, "REVISAR")


def test_bootstrap_does_not_depend_on_partitions(spark):
    c = entry.comparison(spark, f"{TESTDATA}/sf0.001")
    one = dicts(bootstrap.improvement_interval(c.comparables.coalesce(1), S, 100))
    assert one == dicts(bootstrap.improvement_interval(c.comparables.repartition(13), S, 100))
    total = one[0]
    assert total["N_REPLICAS"] == 100 and total["INFERIOR_PCT"] < total["MEJORA_PCT"] < total["SUPERIOR_PCT"]
    draws = spark.range(4000).select(bootstrap.weight(F.md5(F.col("id").cast("string")), 3).alias("w"))
    mean, variance = draws.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 0.06 and abs(variance - 1) < 0.12


def test_bootstrap_without_base_error(compare):
    c = compare({"SCP_TOTAL_ABS_ERROR_6M": 0.0}, {"SCP_TOTAL_ABS_ERROR_6M": None})
    row = dicts(bootstrap.improvement_interval(c.comparables, S, 50))[0]
    assert (row["MEJORA_PCT"], row["INFERIOR_PCT"], row["N_REPLICAS"], row["VEREDICTO"]) == (None, None, 0, None)


def test_a_rewritten_folder_is_read_again(spark, table, tmp_path):
    store, path, calls = StoredTables(), str(tmp_path / "t"), []

    def make():
        calls.append(1)
        return spark.read.parquet(path)

    table({}, {"ID_CLIENT": 2}).write.parquet(path)
    assert store.of_files(spark, "t", [path], make).count() == store.get(spark.read.parquet(path)).count() == 2
    assert store.of_files(spark, "t", [path], make).count() == 2 and len(calls) == 1
    table({}).write.mode("overwrite").parquet(path)
    assert store.of_files(spark, "t", [path], make).count() == store.get(spark.read.parquet(path)).count() == 1
    assert len(calls) == 2


@pytest.mark.parametrize("name", [*ANALYSES, *RUN_ANALYSES])
def test_analyses_of_no_series(compare, name):
    c = compare({"ID_CLIENT": 99})
    found = {**ANALYSES, **RUN_ANALYSES}[name](c).collect()
    assert len(found) <= 2
