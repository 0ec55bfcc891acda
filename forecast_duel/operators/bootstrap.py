"""Bootstrap interval of the improvement with Poisson weights that follow from the series' keys.

Each replicate weighs every series by a Poisson number of mean 1, drawn from a digest of the series' key and the number of the replicate. So the
replicates do not depend on partitions, retries or the order of rows, and they are plain sums: one aggregate holds all of them,
combined before the shuffle.
"""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.functions import relative_improvement
from forecast_duel.operators.clients import client_label
from forecast_duel.schema import KEY
from forecast_duel.settings import Settings

REPLICATES = 200
# A digest of 32 hexadecimal digits gives eight draws of 16 bits.
DRAWS, DIGITS = 8, 4
# The interval's outcomes.
IMPROVES, WORSENS, OPEN = "IMPROVES", "NOT_IMPROVED", "INCONCLUSIVE"
ERROR_TYPE = "decimal(28,6)"


def limits() -> list[int]:
    """Draws from which the weight is 1, 2, ...: the distribution function in steps of 2^-16."""
    share, found = 0.0, []
    for k in range(8):
        share += exp(-1) / factorial(k)
        found.append(round(share * 2 ** (4 * DIGITS)))
    return found


def weight(digest: Column, draw: int) -> Column:
    value = F.conv(F.substring(digest, draw * DIGITS + 1, DIGITS), 16, 10).cast("int")
    return sum((F.when(value >= limit, 1).otherwise(0) for limit in limits()), F.lit(0))


def replicate_sums(comparable_rows: DataFrame, s: Settings, replicates: int) -> DataFrame:
    """(ID_CLIENT, replicate, base, challenger): weighted errors of each client in each replicate; replicate -1 is unweighted.

    Errors are decimals, so the sums are exact; an infinite or missing error adds nothing.
    """
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*KEY, "ID")))
    errors = [F.coalesce(F.col(s.abs_error(m)).try_cast(ERROR_TYPE), F.lit(0).cast(ERROR_TYPE)).alias(n) for m, n in ((s.base, "base"), (s.challenger, "challenger"))]
    blocks = -(-replicates // DRAWS)
    dealt = comparable_rows.select("ID_CLIENT", name.alias("name"), *errors).withColumn(
        "block", F.explode(F.sequence(F.lit(-1), F.lit(blocks - 1))))
    drawn = dealt.withColumn("digest", F.md5(F.concat("name", F.lit("#"), F.col("block").cast("string")))).select(
        "ID_CLIENT", "block", "base", "challenger",
        *(F.when(F.col("block") < 0, 1 if d == 0 else 0).otherwise(weight(F.col("digest"), d)).alias(f"w{d}") for d in range(DRAWS)))
    sums = drawn.groupBy("ID_CLIENT", "block").agg(
        *(F.sum(F.col(m) * F.col(f"w{d}")).cast("decimal(38,6)").alias(f"{m}{d}") for d in range(DRAWS) for m in ("base", "challenger")))
    each = F.inline(F.array(*(
        F.struct((F.col("block") * DRAWS + d).alias("replicate"), F.col(f"base{d}").alias("base"), F.col(f"challenger{d}").alias("challenger"))
        for d in range(DRAWS))))
    found = sums.select("ID_CLIENT", "block", each)
    return found.where(f"(block >= 0 AND replicate < {replicates}) OR replicate = {-DRAWS}").drop("block")


def improvement_interval(comparable_rows: DataFrame, s: Settings, replicates: int = REPLICATES) -> DataFrame:
    """The weighted improvement with the interval that holds 95 % of its replicates, and what it allows to say; TOTAL and per client.

    The limits are replicates themselves: with m of them in order the one at ceil(m / 40) and its mirror image. Replicates without base error
    have no improvement and are left out.
    """
    sums = replicate_sums(comparable_rows, s, replicates)
    rolled = sums.groupingSets([["ID_CLIENT", "replicate"], ["replicate"]], "ID_CLIENT", "replicate").agg(
        F.sum("base").alias("base"), F.sum("challenger").alias("challenger"),
        client_label(F.col("ID_CLIENT"), F.grouping("ID_CLIENT") == 1).alias("label"))
    value = relative_improvement(F.col("base").cast("double"), F.col("challenger").cast("double"))
    figures = rolled.select("label", (F.col("replicate") < 0).alias("whole"), value.alias("value"))
    # As many values a label as replicates.
    found = figures.groupBy("label").agg(
        F.max(F.when(F.col("whole"), F.col("value"))).alias("MEJORA_PCT"), F.array_sort(F.collect_list(F.when(~F.col("whole"), F.col("value")))).alias("values"))
    n = F.size("values")
    place = F.ceil(n / F.lit(40)).cast("int")
    low, high = (F.when(n > 0, F.get("values", i)) for i in (place - 1, n - place))
    said = F.when(low > 0, IMPROVES).when(high <= 0, WORSENS).when(low.isNotNull(), OPEN)
    return found.select(
        F.col("label").alias("ID_CLIENT"), "MEJORA_PCT", low.alias("INFERIOR_PCT"), high.alias("SUPERIOR_PCT"), n.alias("N_REPLICAS"), said.alias("VEREDICTO"),
    ).orderBy(F.col("ID_CLIENT").try_cast("long").asc_nulls_first(), "ID_CLIENT")
