"""What the plans look like, what the sinks write, and identities between the reports."""

from __future__ import annotations

import contextlib
import io

import duckdb
import pytest
from conftest import TESTDATA, by
from oracle_check import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from forecast_duel import BLOCKS, REPORTS, Comparison, Settings, write_blocks
from forecast_duel.plans import StoredTables, scratch_path
from retail_series import monthly_quantities

FOLDER = f"{TESTDATA}/sf0.001"
ALL = list(entry.library_queries())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ALL)
def test_query_equals_its_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == []


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(ALL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 6


def physical(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", list(REPORTS))
def test_plans_push_filters_and_avoid_products_and_python(spark, name):
    plan = physical(entry.comparison(spark, FOLDER).report(name))
    assert "In(ID_CLIENT" in plan and "EqualTo(HAS_BASE_CANDIDATE,1)" in plan
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan


def test_reports_read_only_their_columns(spark):
    c = entry.comparison(spark, FOLDER)

    def columns(name):
        schema = physical(c.report(name)).split("ReadSchema: struct<")[1].split(">")[0]
        return {part.split(":")[0] for part in schema.split(",")}

    assert columns("coverage_by_client") == {"ID_CLIENT", "COMPARISON_STATUS", "HAS_BASE_CANDIDATE", "HAS_ML_EXCLUDED"}
    assert columns("wape_impact") == {
        "ID_CLIENT", "COMPARISON_STATUS", "HAS_BASE_CANDIDATE", "TOTAL_HISTORY_6M",
        "SCP_TOTAL_ABS_ERROR_6M", "ML_TOTAL_ABS_ERROR_6M"}


def test_rankings_are_top_n_without_a_full_sort(spark):
    c = entry.comparison(spark, FOLDER)
    for name in ("top_ml_improvements", "top_ml_underperformance", "top_winner_models"):
        assert "TakeOrderedAndProject" in physical(c.report(name))


def test_identities_between_reports(spark):
    c = entry.comparison(spark, f"{TESTDATA}/sf0.01")
    coverage = by(c.report("coverage_by_client"), "ID_CLIENT")
    total = coverage.pop("TOTAL")
    for column in ("SERIES_CANDIDATAS", "SERIES_COMPARABLES", "SERIES_HAS_ML_EXCLUDED"):
        assert total[column] == sum(r[column] for r in coverage.values())
    status = [r.N for r in c.report("status_distribution").collect() if r.ID_CLIENT == "TOTAL"]
    null_status = c.candidates.filter("COMPARISON_STATUS IS NULL").count()
    assert sum(status) + null_status == total["SERIES_CANDIDATAS"] == 1155
    winners = [r.N for r in c.report("winner_distribution").collect() if r.ID_CLIENT == "TOTAL"]
    no_winner = by(c.report("data_quality_checks"), "CHECK")["comparable_without_winner"]["N_FILAS_AFECTADAS"]
    assert sum(winners) + no_winner == total["SERIES_COMPARABLES"] == 759
    by_status, by_flag, gap = c.report("exclusion_reconciliation").first()
    reasons = sum(r.N for r in c.report("exclusion_reasons").collect())
    per_client = sum(r.N for r in c.report("exclusion_reasons_by_client").collect())
    assert by_flag == reasons == per_client == total["SERIES_HAS_ML_EXCLUDED"] == 70
    assert gap == by_flag - by_status
    histogram = sum(r.N for r in c.report("improvement_histogram").collect())
    assert histogram == c.report("ml_improvement_stats").first()["count"]


def test_statistics_have_one_plan_with_three_scans(spark):
    plan = physical(entry.comparison(spark, FOLDER).report("ml_improvement_stats"))
    assert "functions=[percentile" not in plan and plan.split("Subqueries")[0].count(") Scan parquet") <= 6


@pytest.mark.parametrize("name", ["win_profiles_by_client", "value_by_dimension", "ml_win_profiles"])
def test_profiles_scan_once(spark, name):
    plan = physical(entry.comparison(spark, FOLDER).report(name))
    assert plan.split("Subqueries")[0].count("Scan parquet") // 2 == 1


def test_histogram_binds_its_range_once(spark):
    plan = entry.comparison(spark, FOLDER).report("improvement_histogram")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery#") <= 8


def test_a_long_client_list_reaches_the_scan(spark):
    c = entry.comparison(spark, FOLDER, Settings(clients=tuple(range(20_000))))
    assert "In(ID_CLIENT" in physical(c.report("coverage_by_client"))


@pytest.mark.parametrize("name", ["coverage_by_client", "status_distribution", "ml_improvement_stats", "value_by_dimension"])
def test_row_order_and_partitions_do_not_matter(spark, name):
    c = entry.comparison(spark, FOLDER)
    shuffled = Comparison(c.series.repartition(11).orderBy(F.xxhash64("ID")), c.settings)
    assert entry.rounded(shuffled.report(name)).collect() == entry.rounded(c.report(name)).collect()


def test_hot_client_and_hot_customer(spark, tmp_path):
    """A customer and an order that hold most lines, a client that holds most series."""
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        if name == "lineitem":
            df = df.withColumn("l_orderkey", F.when(F.col("l_linenumber") <= 3, 1).otherwise(F.col("l_orderkey")).cast("long"))
        if name == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(F.col("o_custkey")).cast("long"))
        if name == "nation":
            df = df.withColumn("n_regionkey", F.when(F.col("n_nationkey") < 20, 1).otherwise(F.col("n_regionkey")).cast("int"))
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("series_table", "coverage_by_client", "ml_improvement_stats", "win_profiles_by_client"):
        assert differences(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []


def test_lines_of_a_hot_order_are_split(spark):
    """One order with most lines: the join splits its partition, the customer sum combines first."""
    lines = spark.range(200_000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("l_orderkey"),
        (F.xxhash64("id") % 50).cast("double").alias("l_quantity"),
        F.timestamp_add("DAY", -(F.col("id") % 900).cast("int"), F.lit("2001-11-04").cast("timestamp")).alias("l_shipdate"),
    )
    orders = spark.range(200_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 5000).alias("o_custkey"))
    tuned = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in tuned}
    try:
        for k, v in tuned.items():
            spark.conf.set(k, v)
        months = monthly_quantities(lines.repartition(16), orders)
        total = months.agg(F.sum("q1"), F.count("*"))
        found = total.collect()
        plan = physical(total)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan or "skewed" in plan
    expected = lines.filter("l_shipdate >= '2001-10-01' AND l_shipdate < '2001-11-01'").agg(F.sum("l_quantity")).first()[0]
    assert found[0][0] == expected


@pytest.mark.parametrize("file_format", ["parquet", "json", "csv"])
def test_blocks_are_written_with_an_index(spark, compare, tmp_path, file_format):
    c = compare({}, {"ID_CLIENT": 2})
    index = write_blocks(c, str(tmp_path), file_format).collect()
    assert [(r.ORDEN, r.HOJA, r.BLOQUE) for r in index] == [(i, b.sheet, b.report) for i, b in enumerate(BLOCKS, 1)]
    rows = {r.BLOQUE: r for r in index}
    assert rows["coverage_by_client"].N_FILAS == 4 and rows["coverage_by_client"].NOTA is None
    assert rows["exclusion_reasons"].N_FILAS == 0 and rows["exclusion_reasons"].NOTA == "(sin datos)"
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    assert reader.format(file_format).load(f"{tmp_path}/index").count() == len(BLOCKS)
    back = reader.format(file_format).load(f"{tmp_path}/coverage_by_client")
    assert {(r.ID_CLIENT, str(r.SERIES_CANDIDATAS)) for r in back.collect()} == {
        ("TOTAL", "2"), ("1", "1"), ("2", "1"), ("3", "0")}
    if file_format == "parquet":
        empty = spark.read.parquet(f"{tmp_path}/exclusion_reasons")
        assert empty.columns == ["ML_EXCLUSION_REASON", "N", "PCT"] and empty.isEmpty()


@pytest.mark.parametrize("name", [
    "status_distribution", "status_with_meaning", "exclusion_reasons", "exclusion_reasons_by_client",
    "scp_no_output_reasons", "excluded_flag_distribution", "winner_distribution", "finalist_distribution"])
def test_shared_counts_give_the_same_reports(spark, con, name):
    shared = entry.comparison(spark, FOLDER).sharing_codes()
    assert differences(shared.report(name), con, entry.oracle_sql()[name]) == []


def test_stored_tables_are_found_by_their_plan(spark, table):
    store, one, two = StoredTables(), table({}, {"ID_CLIENT": 2}), table({"ID_CLIENT": 3})
    first = store.get(one)
    assert store.get(one) is first and first.count() == 2
    assert store.get(two).first().ID_CLIENT == 3
    assert store.get(one.filter("ID_CLIENT = 2")).count() == 1
    assert "Scan parquet" in physical(first)


def test_scratch_paths_follow_the_shared_folder(spark):
    from forecast_duel.plans.stored_tables import CHECKPOINT_SETTING

    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(root.rstrip("/"))


def test_an_empty_selection_fails_before_anything_is_written(spark, compare, tmp_path):
    with pytest.raises(ValueError, match="left no row"):
        write_blocks(compare({"ID_CLIENT": 77}), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
