"""Running totals and as-of joins against brute force, for any number of ranges, hot groups, ties and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from forecast_duel.operators.ordered import asof_join, running_totals


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, *range(50)]), rng.randint(-3, 9)) for i in range(2000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, t long, v long").repartition(5).cache()


def order_of(row):
    return (row[2] is not None, row[2] or 0, row[0])


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_totals_by_group(table, rows, ranges):
    want = {}
    for g in (None, "a", "b"):
        total = 0
        for row in sorted((r for r in rows if r[1] == g), key=order_of):
            total += row[3]
            want[row[0]] = total
    found = running_totals(table, [F.col("t"), F.col("id")], {"v": "total"}, ["g"], ranges).collect()
    assert {r.id: r.total for r in found} == want and len(found) == len(rows)


@pytest.mark.parametrize("kind", ["long", "decimal(12,3)", "double"])
def test_running_totals_of_everything(table, rows, kind):
    total, want = 0, {}
    for row in sorted(rows, key=order_of):
        total += row[3]
        want[row[0]] = total
    found = running_totals(table.withColumn("v", F.col("v").cast(kind)), [F.col("t"), F.col("id")], {"v": "total"}, ranges=7)
    assert {r.id: r.total for r in found.collect()} == want
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    assert running_totals(table.limit(0), [F.col("id")], {"v": "total"}).count() == 0


def test_running_totals_pass_over_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "id long, v long")
    assert [r.s for r in running_totals(df, [F.col("id")], {"v": "s"}, ranges=4).orderBy("id").collect()] == [0, 5, 5, 6]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("ranges", [1, 9])
def test_asof_join(table, rows, strict, ranges):
    found = asof_join(table, table.withColumn("extra", F.lit("x")), ["g"], "t", ["id", "v"], strict=strict, tie="id", ranges=ranges)
    assert found.count() == len(rows)
    for r in found.collect():
        earlier = [] if r.t is None else [
            (t, -i, v) for i, g, t, v in rows if g == r.g and t is not None and (t < r.t or (not strict and t == r.t))]
        t, i, v = max(earlier, default=(None, None, None))
        assert (r.PREV_t, r.PREV_id, r.PREV_v) == (t, None if i is None else -i, v)


def test_asof_join_of_empty_tables(table):
    assert asof_join(table.limit(0), table, ["g"], "t", ["v"]).count() == 0
    alone = asof_join(table, table.limit(0), ["g"], "t", ["v"])
    assert alone.where("PREV_v IS NOT NULL OR PREV_t IS NOT NULL").count() == 0 and alone.count() == table.count()
