"""Mergeable sketches and the table functions of Spark SQL; their registered queries are compared with SQL here too."""

from __future__ import annotations

import pytest
from conftest import TESTDATA, by, dicts
from oracle_check import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from forecast_duel.operators import sketches
from forecast_duel.plans import create_functions, stored_sketches
from forecast_duel.settings import Settings

S = Settings()
FOLDER = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", ["sketch_audit", "sql_coverage", "sql_wape"])
def test_query_equals_its_sql(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name]) == []


def rows(batch: str, client: int | None, values) -> list[dict]:
    """Series whose improvement is the value: errors follow from a WAPE of 1."""
    return [{"ID_BATCH": batch, "ID_CLIENT": client, "ID_CONFIGURATION": f"{batch}-{client}-{i}", "SCP_WAPE_6M": 1.0, "ML_WAPE_6M": None if v is None else 1.0 - v / 100}
            for i, v in enumerate(values)]


def test_few_values_are_exact_and_batches_merge(compare, tmp_path):
    c = compare(*rows("1", 1, [10, 20, 30]), *rows("2", 1, [40, 50]), *rows("2", 2, [None, None]), *rows("3", 2, [-5]))
    folder = str(tmp_path / "states")
    states = stored_sketches(c, folder)
    found = by(sketches.sketch_quantiles(states), "ID_CLIENT")
    assert (found["1"]["N_SERIES"], found["1"]["N"], found["1"]["N_CONFIGURACIONES"]) == (5, 5, 5)
    assert found["1"]["P50"] == pytest.approx(30) and found["TOTAL"]["P05"] == pytest.approx(-5) and found["TOTAL"]["N_SERIES"] == 8
    some = by(sketches.sketch_quantiles(states, ("1", "2")), "ID_CLIENT")
    assert (some["2"]["N"], some["2"]["P50"], some["2"]["N_SERIES"]) == (0, None, 2) and some["1"] == found["1"]
    # A run that is repeated replaces its batch and leaves the others.
    again = stored_sketches(compare(*rows("1", 1, [10, 20, 30])), folder)
    assert by(sketches.sketch_quantiles(again), "ID_CLIENT") == found


def test_states_of_no_rows(compare):
    c = compare(*rows("1", 1, [1]))
    states = sketches.sketch_states(c.comparables.where("false"), S)
    assert states.count() == 0
    assert [r["N"] for r in dicts(sketches.sketch_quantiles(states)) if r["ID_CLIENT"] != "TOTAL"] == []


def test_merged_states_keep_the_stated_rank_error(spark, compare):
    n = 60_000
    base = compare({}, clients=None).comparables.drop("ID_BATCH", "ID_CONFIGURATION", S.improvement)
    many = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({
        "ID_BATCH": (F.col("i") % 7).cast("string"), "ID_CONFIGURATION": (F.col("i") % 5000).cast("string"),
        S.improvement: ((F.col("i") * 7919) % n).cast("double")})
    row = by(sketches.sketch_quantiles(sketches.sketch_states(many, S)), "ID_CLIENT")["TOTAL"]
    for p in sketches.PROBABILITIES:
        assert abs(row[f"P{round(100 * p):02d}"] / n - p) <= row["ERROR_DE_RANGO"]
    assert abs(row["N_CONFIGURACIONES"] - 5000) <= 5000 * sketches.count_error() and row["N"] == n


def test_functions_take_methods_and_clients(spark, compare):
    c = compare({"ID_CLIENT": 1}, {"ID_CLIENT": 9, "WINNER_METHOD_6M": "SCP"}, {"ID_CLIENT": None, "COMPARISON_STATUS": None})
    create_functions(c, "t_")
    assert {r["ID_CLIENT"]: r["SERIES_CANDIDATAS"] for r in dicts(spark.sql("SELECT * FROM t_coverage()"))} == {"TOTAL": 3, "1": 1, "9": 1, None: 1}
    forth = by(spark.sql("SELECT * FROM t_wape('SCP', 'ML', array(1, 9))"), "ID_CLIENT")
    back = by(spark.sql("SELECT * FROM t_wape('ML', 'SCP', array(9))"), "ID_CLIENT")
    assert forth["TOTAL"]["IMPROVEMENT_PCT"] == pytest.approx(25) and (forth["TOTAL"]["N_GANA_BASE"], forth["TOTAL"]["N_GANA_CHALLENGER"]) == (1, 1)
    assert back.keys() == {"9", "TOTAL"} and back["9"]["IMPROVEMENT_PCT"] == pytest.approx(-100 / 3) and back["9"]["N_GANA_CHALLENGER"] == 1
    with pytest.raises(Exception, match="unknown method: XX"):
        spark.sql("SELECT * FROM t_wape('SCP', 'XX')").collect()
