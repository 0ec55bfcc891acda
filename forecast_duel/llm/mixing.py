"""A mix of sources near target weights by weighted fair queueing.

Every source serves its documents in shuffled order, round after round. A document's virtual finish time is the number of words
its source has served up to and with it, divided by the source's weight. Sorted by finish time over all sources, the documents up
to the total budget are the mix: each source has then been served in proportion to its weight, and a source whose rounds
are used up leaves its share to the others. Sorting and adding up run over ranges of rows, so neither a source that
holds most documents nor the whole queue is ever in one task.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecast_duel.llm.common import stored
from forecast_duel.operators.ordered import running_totals

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeated as long as there are sources.
WEIGHTS = (3, 1, 2)
#: Words to take, as a fraction of all words.
BUDGET = (3, 2)
#: How often a document can be taken.
ROUNDS = 2
#: Finish times and totals of words times weights are whole numbers of this kind.
WHOLE = "decimal(38,0)"


def number_of_words(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, shuffle) of every row: the texts are read once. The shuffle depends on nothing but the id."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), number_of_words(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("shuffle"))


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) with the place of the source by code point, null last, and its weight."""
    placed = running_totals(
        sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"one": "place"}).drop("one")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights)))
    return placed.withColumn("weight", F.get(F.array(*(F.lit(w) for w in weights)), turn.cast("int")).cast("long"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], rounds: int) -> DataFrame:
    """Each source's share of the budget by weight, at most ``rounds`` times its size.

    What a full source cannot take is shared out again. Sources fill up in the order of capacity divided by weight: a source
    is full if, once the level has reached that ratio, the words served do not exceed the budget. Whole numbers decide it.
    """
    above, below = budget
    unit = lcm(*weights)
    level = sources.withColumn("cap", F.col("source_size") * rounds).withColumn(
        "ratio", (F.col("cap").cast(WHOLE) * (F.lit(unit) / F.col("weight")).cast("long")).cast(WHOLE))
    level = running_totals(level, [F.col("ratio"), F.col("place")], {"cap": "cap_so_far", "weight": "weight_so_far"})
    level = stored(level, "levels")
    whole = level.agg(F.sum(F.col("source_size").cast(WHOLE)).alias("size"), F.sum("weight").alias("weight"))
    all_size, all_weight = (whole.select(c).scalar() for c in ("size", "weight"))
    served = F.col("cap_so_far").cast(WHOLE) * unit + (F.col("ratio") * (all_weight - F.col("weight_so_far"))).cast(WHOLE)
    full = (served * below).cast(WHOLE) <= (all_size * (above * unit)).cast(WHOLE)
    level = level.withColumn("full", full)
    taken = level.where("full").agg(
        F.coalesce(F.sum(F.col("cap").cast(WHOLE)), F.lit(0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"))
    full_cap, full_weight = (taken.select(c).scalar() for c in ("cap", "weight"))
    rest = (all_size * above - full_cap * below).cast("double") * F.col("weight") / ((all_weight - full_weight) * below).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest)
    return level.select("source", "source_size", "place", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, rounds: int = ROUNDS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``docs``; ``taken`` counts the words of all its repeats.

    Sizes count words; null and empty texts have none and are never taken. A null source is a source, and so is a null id
    a document; repeated rows are documents of their own that follow one another. Ties of finish time go to the source of the
    earlier name. The mix ends before the first document that would exceed the budget, so it lacks less than that document,
    and a source differs from its target by less than its largest document and that one's share of the weights.
    An empty table gives no row. Other columns are not read. The result depends on nothing but ids, sizes and sources.
    """
    above, below = budget
    unit = lcm(*weights)
    rows = stored(sized(docs, id_col, text_col, source_col), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(with_targets(weighted(sources, weights), weights, budget, rounds), "targets")
    order = [F.col("shuffle"), F.col("id"), F.col("size")]
    queued = running_totals(rows, order, {"size": "served"}, ["source"]).drop("shuffle")
    known = sources.withColumnRenamed("source", "name")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    factor = (F.lit(unit) / F.col("weight")).cast("long")
    finish = [((F.col("served") + r * F.col("source_size")).cast(WHOLE) * factor).cast(WHOLE) for r in range(rounds)]
    queued = stored(queued.select("id", "size", "source_size", "target", "place", F.array(*finish).alias("finish")), "queue")

    items = queued.where("size > 0").select("size", "place", F.explode("finish").alias("finish"))
    served = running_totals(items, [F.col("finish"), F.col("place")], {"size": "total"})
    allowed = (queued.agg(F.sum(F.col("size").cast(WHOLE))).scalar() * above).cast(WHOLE)
    # One row: the last item within the budget. Within a source all finish times differ.
    border = served.where((F.col("total").cast(WHOLE) * below).cast(WHOLE) <= allowed).agg(F.max(F.struct("finish", "place"))).first()[0]
    if border is None:
        times = F.lit(0)
    else:
        last = F.struct(F.lit(border["finish"]).cast(WHOLE), F.lit(border["place"]).cast("long"))
        times = sum((F.when(F.struct(F.get("finish", F.lit(r)), F.col("place")) <= last, 1).otherwise(0) for r in range(rounds)), F.lit(0))
    return queued.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (times.cast("long") * F.col("size")).alias("taken"))
