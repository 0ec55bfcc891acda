"""Connected components of an edge table by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecast_duel.llm.common import stored


def smallest_neighbour(edges: DataFrame) -> DataFrame:
    """u and the smallest of u and all its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the root is the smallest node of the component.

    Large stars hang larger neighbours on the smallest one, small stars hang smaller ones together; both keep
    components whole, and the edges end up as one star a component. A node with many edges is combined before its
    rows are shuffled, and the join that follows has one row for it on one side.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.where("u > v")
        small = low.join(smallest_neighbour(low), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
