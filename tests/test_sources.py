from __future__ import annotations

import pytest
from conftest import DEFAULT
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from forecast_duel.schema import NA_TOKENS, ranking_columns, require_columns, series_schema
from forecast_duel.sources import read_csv, read_parquet, write_parquet
from retail_series import series_from_retail
from forecast_duel.sources.parquet_table import conform

NAMES = series_schema().names


def write_csv(path, rows, names=NAMES, quote=lambda v: v):
    lines = [",".join(names)]
    for row in rows:
        values = {"ID": "1", "ID_CONFIGURATION": "1", **{k: str(v) for k, v in DEFAULT.items()}, **row}
        lines.append(",".join(quote(values.get(n, "")) for n in names))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_schema_has_the_54_columns_and_the_projection_21():
    assert len(NAMES) == len(set(NAMES)) == 54
    assert NAMES[:6] == ["ID", "ID_BATCH", "ID_RUN_STAGING", "ID_CLIENT", "SOURCE_RUN_ID", "ID_CONFIGURATION"]
    assert NAMES[-1] == "WINNER_IMPROVEMENT_PCT_6M"
    assert len(ranking_columns()) == 21


def test_columns_match_by_name_and_extra_ones_are_dropped(spark, tmp_path):
    names = ["EXTRA", *reversed(NAMES)]
    row = read_csv(spark, write_csv(tmp_path / "a.csv", [{"EXTRA": "x"}], names)).first()
    assert list(row.asDict()) == NAMES
    assert (row.ID_CLIENT, row.HAS_BASE_CANDIDATE, row.SCP_WAPE_6M, row.ID_BATCH) == (1, 1, 0.2, "1")


def test_missing_columns_are_all_named_in_declared_order(spark, tmp_path):
    names = [n for n in NAMES if n not in ("ML_WAPE_6M", "ID_BATCH")]
    with pytest.raises(ValueError, match="ID_BATCH, ML_WAPE_6M$"):
        read_csv(spark, write_csv(tmp_path / "a.csv", [{}], names))
    with pytest.raises(ValueError, match="ID_BATCH"):
        require_columns(spark.range(1))


def test_absent_file(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_quotes_commas_and_line_breaks(spark, tmp_path):
    text = 'he said ""hi"", ok'
    path = write_csv(
        tmp_path / "a.csv",
        [{"VALUE_LEVEL_1": f'"{text}"', "VALUE_LEVEL_2": '"two\nlines"', "VALUE_LEVEL_3": '"a,b"'}],
    )
    row = read_csv(spark, path, multi_line=True).first()
    assert (row.VALUE_LEVEL_1, row.VALUE_LEVEL_2, row.VALUE_LEVEL_3) == ('he said "hi", ok', "two\nlines", "a,b")


def test_torn_record_fails_without_multi_line(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [{"VALUE_LEVEL_2": '"two\nlines"'}])
    for columns in (NAMES, ["ID_CLIENT"]):
        with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
            read_csv(spark, path, multi_line=False).select(*columns).collect()
    plain = write_csv(tmp_path / "b.csv", [{}, {}])
    assert read_csv(spark, plain, multi_line=False).count() == 2


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("extra", [True, False])
def test_record_of_the_wrong_length_fails_whatever_is_selected(spark, tmp_path, multi_line, extra):
    path = write_csv(tmp_path / "a.csv", [{}, {}])
    lines = (tmp_path / "a.csv").read_text(encoding="utf-8").splitlines()
    lines[2] = lines[2] + ",1" if extra else lines[2].rsplit(",", 1)[0]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read_csv(spark, path, multi_line=multi_line).select("ID_CLIENT").collect()


def test_every_missing_token_is_null(spark, tmp_path):
    rows = [{"VALUE_LEVEL_1": t, "SCP_WAPE_6M": t, "HAS_ML_EXCLUDED": t, "ID_BATCH": t} for t in NA_TOKENS]
    df = read_csv(spark, write_csv(tmp_path / "a.csv", rows))
    found = df.select("VALUE_LEVEL_1", "SCP_WAPE_6M", "HAS_ML_EXCLUDED", "ID_BATCH").distinct().collect()
    assert [tuple(r) for r in found] == [(None,) * 4]
    assert df.count() == len(NA_TOKENS) == 19


def test_integer_columns_written_as_floats_or_booleans(spark, tmp_path):
    rows = [{"HAS_ML_EXCLUDED": v, "ID_CLIENT": c} for v, c in [("1.0", "7.0"), ("True", "8"), ("0", "9007199254740993")]]
    found = read_csv(spark, write_csv(tmp_path / "a.csv", rows)).select("HAS_ML_EXCLUDED", "ID_CLIENT").collect()
    assert [tuple(r) for r in found] == [(1, 7), (1, 8), (0, 9007199254740993)]


@pytest.mark.parametrize("column, value", [("SCP_WAPE_6M", "abc"), ("HAS_BASE_CANDIDATE", "1.5"), ("ID_CLIENT", "x")])
def test_value_of_the_wrong_type_names_column_and_value(spark, tmp_path, column, value):
    path = write_csv(tmp_path / "a.csv", [{column: value}])
    with pytest.raises(Exception, match=f"(?s){column}.*{value}"):
        read_csv(spark, path).collect()


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [{}])
    write_csv(tmp_path / "b.csv", [{}], list(reversed(NAMES)))
    with pytest.raises(Exception, match="header|FAILED_READ"):
        read_csv(spark, str(tmp_path)).collect()


def test_nan_becomes_null_and_identifiers_keep_their_type(spark, table):
    df = table({"SCP_WAPE_6M": float("nan")}).withColumn("ID", F.col("ID").cast("long"))
    df = conform(df.select(*reversed(df.columns), F.lit(1).alias("EXTRA")))
    assert df.columns == NAMES and dict(df.dtypes)["ID"] == "bigint"
    assert df.first().SCP_WAPE_6M is None


def test_parquet_round_trip_prunes_batches_clients_and_columns(spark, table, tmp_path):
    path = str(tmp_path / "series")
    original = table({}, {"ID_BATCH": "02", "ID_CLIENT": 2}, {"ID_BATCH": None})
    write_parquet(original, path)
    back = read_parquet(spark, path, schema=original.schema)
    assert sorted(back.collect(), key=str) == sorted(original.collect(), key=str)
    plan = back.filter((F.col("ID_BATCH") == "02") & (F.col("ID_CLIENT") == 2)).select("ML_TYPE")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ID_BATCH" in text and "EqualTo(ID_CLIENT,2)" in text
    assert "HISTORY_M1" not in text.split("ReadSchema")[1]


def test_rebalanced_write_keeps_every_row_and_few_files(spark, table, tmp_path):
    rows = table(*({"ID_BATCH": str(i % 5)} for i in range(60))).repartition(12)
    path = tmp_path / "series"
    write_parquet(rows, str(path), rebalance=True)
    assert read_parquet(spark, str(path)).count() == 60
    assert len(list(path.glob("*/*.parquet"))) == 5


@pytest.mark.parametrize("multi_line", [True, False])
def test_byte_order_mark_carriage_returns_blank_lines_and_padded_numbers(spark, tmp_path, multi_line):
    path = write_csv(tmp_path / "a.csv", [{"SCP_WAPE_6M": " 0.5 ", "VALUE_LEVEL_1": " x"}, {}])
    text = (tmp_path / "a.csv").read_text(encoding="utf-8").replace("\n", "\r\n\r\n")
    (tmp_path / "a.csv").write_bytes(("\ufeff" + text).encode("utf-8"))
    rows = read_csv(spark, path, multi_line=multi_line).collect()
    assert [(r.ID, r.SCP_WAPE_6M, r.VALUE_LEVEL_1) for r in rows] == [("1", 0.5, " x"), ("1", 0.2, None)]
    assert rows[0].WINNER_IMPROVEMENT_PCT_6M == 25.0


def test_derived_series_have_the_expected_mix(spark):
    df = series_from_retail(spark, "/root/testdata/sf0.001").cache()
    candidates = df.filter("ID_CLIENT IN (10200, 10201, 10202, 10203) AND HAS_BASE_CANDIDATE = 1")
    comparable = candidates.filter("COMPARISON_STATUS = 'COMPARABLE'")
    assert (df.count(), candidates.count(), comparable.count()) == (152, 109, 78)
    wins = {r[0]: r[1] for r in comparable.groupBy("WINNER_METHOD_6M").count().collect()}
    assert wins == {"ML": 26, "SCP": 51, None: 1}


def test_a_large_file_is_split(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [{} for _ in range(400)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert read_csv(spark, path).rdd.getNumPartitions() > 1 and read_csv(spark, path).count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_job_writes_the_document_or_fails(spark, tmp_path):
    from run_comparison import main

    path = write_csv(tmp_path / "in.csv", [{}, {"ID_CLIENT": "2"}])
    assert main([path, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "index")).count() > 20
    assert main([path, str(tmp_path / "none"), "999"]) == 1 and main([str(tmp_path / "missing.csv"), "x"]) == 1


def test_the_job_parses_csv_once(spark, tmp_path, monkeypatch):
    import run_comparison

    seen = []
    monkeypatch.setattr(run_comparison, "write_blocks", lambda comparison, target: seen.append(comparison.series) or comparison.series)
    path = write_csv(tmp_path / "in.csv", [{}, {"ID_CLIENT": "2"}])
    assert run_comparison.main([path, str(tmp_path / "out")]) == 0
    (series,) = seen
    assert series.count() == 2 and all(f.endswith(".parquet") for f in series.inputFiles())
