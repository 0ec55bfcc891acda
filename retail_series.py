"""A series-comparison table derived from order lines: one series per customer.

The comparison needs two sets of forecasts. Here they are stand-ins computed from the
months before the evaluated window; they exist so that tests and benchmarks have a table
that grows with the given data, not as forecasting methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.functions import ratio
from forecast_duel.schema import series_schema
from forecast_duel.settings import COMPARABLE, TIE, Settings

WINDOW = range(1, 7)  # evaluated months, 1 = newest closed month
NEAR = range(7, 10)  # months behind the base forecast
YEAR = range(7, 19)  # months behind the challenger forecast
SECOND_HALF = range(13, 19)
OLDER = 19  # every month before YEAR
DUPLICATE_OFFSET = 1_000_000_000


TABLES = ("lineitem", "orders", "customer", "nation", "region")
RUNS = 3


def runs_from_retail(spark: SparkSession, folder: str) -> DataFrame:
    """The same series evaluated in three batches: 3 is the newest, each earlier one lies a month further back.

    A quarter of the configurations was not computed again, so their values stay; each batch lacks some configurations.
    """
    def run(back: int) -> DataFrame:
        there = F.col("ID_CONFIGURATION") % 7 != back
        return series_from_retail(spark, folder, back).where(there).withColumn("ID_BATCH", F.lit(RUNS - back).cast("long"))

    first, *others = (run(back) for back in range(RUNS))
    for other in others:
        first = first.unionByName(other)
    return first


def series_from_retail(spark: SparkSession, folder: str, back: int = 0) -> DataFrame:
    """Build the table from ``lineitem``, ``orders``, ``customer``, ``nation``, ``region``, as of ``back`` months ago."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    months = monthly_quantities(read("lineitem"), read("orders"), back)
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    series = customers.join(months, F.col("c_custkey") == F.col("o_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return with_duplicates(label(compare(forecast(series))))


def monthly_quantities(lineitem: DataFrame, orders: DataFrame, back: int = 0) -> DataFrame:
    """Per customer: quantity of each of the 18 months before the open one; ``back`` months ago for three customers of four.

    Only the key, the month and the quantity of a line cross the join's shuffle. Lines
    of one very large order are split by the adaptive skew join (the order side is unique
    per key, so nothing multiplies); lines of one very large customer are summed before
    they are shuffled.
    """
    month_number = lambda c: F.year(c) * 12 + F.month(c)
    newest = lineitem.agg(month_number(F.max("l_shipdate"))).scalar()
    age = newest - month_number("l_shipdate")
    lines = lineitem.select(
        "l_orderkey",
        F.when(age > OLDER + back, OLDER + back).otherwise(age).alias("m"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    owners = orders.select("o_orderkey", "o_custkey")
    owned = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
    if back:
        owned = owned.withColumn("m", F.least(F.col("m") - F.when(F.col("o_custkey") % 4 == 0, 0).otherwise(back), F.lit(OLDER)))
    return (
        owned.groupBy("o_custkey")
        .agg(
            *(F.expr(f"sum(CASE WHEN m = {i} THEN quantity END) AS q{i}") for i in range(1, OLDER)),
            F.expr(f"coalesce(any(m = {OLDER}), false) AS has_older"),
        )
    )


def total(months: range) -> Column:
    return F.expr(" + ".join(f"coalesce(q{i}, 0)" for i in months))


def months_with_lines(months: range) -> Column:
    return F.expr(" + ".join(f"int(q{i} IS NOT NULL)" for i in months))


def every(n: int) -> Column:
    return F.col("c_custkey") % n == 0


def forecast(series: DataFrame) -> DataFrame:
    """Stand-in forecasts: a three-month mean, and the same month of the year before."""
    known = series.select(
        "*",
        total(WINDOW).alias("total"),
        total(NEAR).alias("near"),
        total(YEAR).alias("year"),
        (months_with_lines(NEAR) > 0).alias("has_near"),
        months_with_lines(YEAR).alias("year_months"),
        (months_with_lines(SECOND_HALF) > 0).alias("has_seasonal"),
    )
    has_year = "year_months >= 2 AND c_custkey % 71 <> 0"
    return known.select(
        "*",
        *(F.expr(f"CASE WHEN has_near THEN near div 3 END AS base{i}") for i in WINDOW),
        *(
            F.expr(f"CASE WHEN {has_year} THEN coalesce(q{i + 12}, year div 12) END AS challenger{i}")
            for i in WINDOW
        ),
    )


def compare(series: DataFrame) -> DataFrame:
    """Absolute errors, winner and comparison status."""

    def abs_error(method: str) -> Column:
        return F.expr(" + ".join(f"abs(coalesce(q{i}, 0) - {method}{i})" for i in WINDOW))

    errors = series.select(
        "*",
        # A perfect base forecast now and then, so that its WAPE is 0; null stays null.
        (abs_error("base") * F.when(every(43), 0).otherwise(1)).alias("base_error"),
        abs_error("challenger").alias("challenger_error"),
        (F.col("year_months") < 2).alias("excluded"),
    )
    base, challenger = F.col("base_error"), F.col("challenger_error")
    winner = (
        F.when(every(53) | base.isNull() | challenger.isNull(), None)
        .when(challenger < base, "ML")
        .when(base < challenger, "SCP")
        .otherwise(TIE)
    )
    status = (
        F.when(every(101), None)
        .when(F.col("total") == 0, "NOT_COMPARABLE_NO_HISTORY")
        .when(base.isNull() & challenger.isNull(), "NOT_COMPARABLE_MISSING_SCP_AND_ML")
        .when(F.col("excluded"), "NOT_COMPARABLE_ML_EXCLUDED")
        .when(base.isNull(), "NOT_COMPARABLE_MISSING_SCP")
        .when(challenger.isNull(), "NOT_COMPARABLE_MISSING_ML")
        .otherwise(COMPARABLE)
    )
    return errors.select("*", winner.alias("winner"), status.alias("status"))


def label(series: DataFrame) -> DataFrame:
    """Name, type and order the columns as the comparison table declares them."""
    key = F.col("c_custkey")
    base, challenger = F.col("base_error"), F.col("challenger_error")
    has_base, has_challenger = F.col("base1").isNotNull(), F.col("challenger1").isNotNull()
    base_model = F.when(
        has_base,
        F.when(key % 3 == 0, "MovingAverage3M").when(key % 3 == 1, "Croston").otherwise("Naive"),
    )
    challenger_model = F.when(
        has_challenger & ~every(29),
        F.when(F.col("has_seasonal"), "SeasonalNaive").otherwise("HistoricAverage"),
    )
    winner = F.col("winner")
    best_model = F.when(winner == "ML", challenger_model).when(winner.isNotNull(), base_model)
    best, worst = F.least(base, challenger), F.greatest(base, challenger)
    improvement = F.when(winner == TIE, 0.0).when(winner.isNotNull(), ratio(worst - best, worst) * 100)
    reason = (
        F.when(~F.col("excluded") | every(11), None)
        .when(F.col("year_months") == 1, "ShortSeries")
        .when(F.col("has_older"), "MissingHistory")
        .otherwise("NewRelease")
    )
    values = {
        "ID": key,
        "ID_BATCH": F.lit(1),
        "ID_RUN_STAGING": 10 + F.col("c_nationkey"),
        "ID_CLIENT": 10200 + F.col("r_regionkey"),
        "SOURCE_RUN_ID": F.when(~every(13), 500 + key % 3),
        "ID_CONFIGURATION": key,
        "VALUE_LEVEL_1": F.col("r_name"),
        "VALUE_LEVEL_2": F.col("n_name"),
        "VALUE_LEVEL_3": F.col("c_mktsegment"),
        "VALUE_LEVEL_4": F.col("c_name"),
        "VALUE_LEVEL_5": F.lit(None),
        "ML_BEST_MODEL": challenger_model,
        "ML_CLASSIFICATION": F.col("c_mktsegment"),
        "ML_TYPE": F.when(F.col("year_months") >= 6, "Smooth").otherwise("Intermittent"),
        "ML_STATUS": F.when(challenger.isNotNull(), "OK").otherwise("NO_OUTPUT"),
        "SCP_BEST_MODEL": base_model,
        "SCP_CLASSIFICATION": F.col("c_mktsegment"),
        "SCP_STATUS": F.when(base.isNotNull(), "OK").otherwise("NO_OUTPUT"),
        "SERIES_CLASSIFICATION": F.when(F.col("total") >= 100, "High").otherwise("Low"),
        "COMPARISON_STATUS": F.col("status"),
        "HAS_BASE_CANDIDATE": (~every(19)).cast("int"),
        "HAS_SCP_CALCULATED": base.isNotNull(),
        "HAS_ML_CALCULATED": challenger.isNotNull(),
        "HAS_ML_EXCLUDED": F.col("excluded"),
        "ML_EXCLUSION_REASON": reason,
        "SCP_NO_OUTPUT_REASON": F.when(~has_base, "NoRecentHistory"),
        **{f"HISTORY_M{i}": F.when(~every(59), F.col(f"q{i}")) for i in WINDOW},
        **{f"SCP_FORECAST_M{i}": F.when(~every(61), F.col(f"base{i}")) for i in WINDOW},
        **{f"ML_FORECAST_M{i}": F.when(~every(67), F.col(f"challenger{i}")) for i in WINDOW},
        "TOTAL_HISTORY_6M": F.col("total"),
        "SCP_TOTAL_ABS_ERROR_6M": base,
        "ML_TOTAL_ABS_ERROR_6M": challenger,
        "SCP_WAPE_6M": ratio(base, F.col("total")),
        "ML_WAPE_6M": F.when(~every(79), ratio(challenger, F.col("total"))),
        "WINNER_METHOD_6M": winner,
        "WINNER_MODEL_6M": best_model,
        "FINALIST_METHOD_6M": F.when(winner == TIE, "SCP").otherwise(winner),
        "FINALIST_MODEL_6M": best_model,
        "WINNER_IMPROVEMENT_PCT_6M": improvement,
    }
    return series.select(
        *(values[f.name].cast(f.dataType).alias(f.name) for f in series_schema(Settings(), T.LongType()))
    )


def with_duplicates(series: DataFrame) -> DataFrame:
    """Repeat every 97th series under another surrogate id, as a key violation to find."""
    offsets = F.when(F.col("ID_CONFIGURATION") % 97 == 0, F.array(F.lit(0), F.lit(DUPLICATE_OFFSET)))
    copies = F.explode(F.coalesce(offsets, F.array(F.lit(0)))).alias("copy")
    return series.select("*", copies).withColumn("ID", F.col("ID") + F.col("copy")).drop("copy")
