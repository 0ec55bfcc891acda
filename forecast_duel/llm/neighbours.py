"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Largest inner product becomes smallest distance by one more coordinate: candidates are lifted to the largest norm, queries
are scaled to it. Distances are estimated from a few Gaussian projections, which are 2-stable: the squared projected
distance over the squared distance has a chi-square distribution. A kd-tree over the projections is read leaf by
leaf in order of projected distance, and the vectors of those candidates of a leaf are verified for which the test is still open; reading
stops when a candidate that is nearer than the k-th best would lie that far out only with a probability below ``miss``.

Candidates are dealt out to cells, the leaves of a kd-tree fitted on a bounded sample, whose size bounds their number; all rows are indexed. A query
reads its own cell first, then the cells that its stopping test still leaves open, so cells are searched apart.

No group is unbounded: of equal vectors the k + 1 smallest ids are candidates, as no other can be among k best; a cell
with more than ``cell_rows`` candidates is dealt to several parts, each of which all its queries read; a cell or part
with more queries than that is copied for them. Partial lists are merged.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; a
shorter vector counts as filled up with zeros; of repeated ids the smallest vector stands; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.llm.common import hash_share, stored
from forecast_duel.llm.words import mixed

DIMENSIONS = 24
#: Probability of stopping before a given true neighbour is read.
MISS = 0.05
#: Rows that the cells are fitted on, and rows of a cell.
SAMPLE_ROWS = 20_000
CELL_ROWS = 20_000
#: Rows of the sample that a cell rests on at least.
CELL_SAMPLE = 64
LEAF_ROWS = 512


def chi_square_below(x: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Probability that a chi-square variable with an even number of degrees of freedom is at most x."""
    half, term, total = x / 2.0, np.ones_like(x), np.ones_like(x)
    for i in range(1, dimensions // 2):
        term = term * half / i
        total = total + term
    return 1.0 - np.exp(-np.minimum(half, 700.0)) * total


def stop_ratio(miss: float, dimensions: int = DIMENSIONS) -> float:
    """Squared projected distance over squared distance that is exceeded with probability ``miss``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(np.array(middle), dimensions) < 1 - miss else (low, middle)
    return high


def splits(points: np.ndarray, depth: int) -> np.ndarray:
    """Dimension and value of each inner node of a complete kd-tree: the widest dimension at its median."""
    nodes = np.zeros((2**depth - 1, 2))
    groups = [points]
    for level in range(depth):
        after = []
        for i, group in enumerate(groups):
            d = int(np.ptp(group, axis=0).argmax()) if len(group) else 0
            value = float(np.median(group[:, d])) if len(group) else 0.0
            nodes[2**level - 1 + i] = d, value
            after += [group[group[:, d] <= value], group[group[:, d] > value]]
        groups = after
    return nodes


def leaf_of(points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    depth = int(np.log2(len(nodes) + 1))
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        d = nodes[node, 0].astype(np.int64)
        node = 2 * node + 1 + (points[np.arange(len(points)), d] > nodes[node, 1])
    return node - len(nodes)


def depth_for(rows: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(rows, 1) / leaf))))


class Cell:
    """A kd-tree over the projections of one cell's candidates; leaves keep the box of their points.

    ``verified`` counts the candidates whose vectors were read, over all queries.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        leaf = leaf_of(projected, splits(projected, depth_for(len(ids), LEAF_ROWS)))
        order = np.lexsort((ids, leaf))
        self.ids, self.vectors, self.projected = ids[order], vectors[order], projected[order]
        self.verified = 0
        used, begin = np.unique(leaf[order], return_index=True)
        self.begin = np.r_[begin, len(ids)]
        self.low = np.minimum.reduceat(projected[order], begin, axis=0)
        self.high = np.maximum.reduceat(projected[order], begin, axis=0)

    def nearest(self, own: int, vector: np.ndarray, projected: np.ndarray, k: int, ratio: float, largest: float, bound: float):
        """Ids and inner products of the k best read, best first. ``bound`` is a k-th best that is known already."""
        gap = np.maximum(0.0, np.maximum(self.low - projected, projected - self.high))
        far = (gap**2).sum(axis=1)
        scale = largest / np.sqrt((vector**2).sum())
        ids, scores = np.zeros(0, self.ids.dtype), np.zeros(0)
        for leaf in np.argsort(far, kind="stable"):
            # The lifted distance of an inner product; nothing nearer is likely to lie this far out.
            limit = ratio * max(2.0 * largest**2 - 2.0 * scale * bound, 0.0)
            if far[leaf] > limit:
                break
            b, e = self.begin[leaf], self.begin[leaf + 1]
            away = self.projected[b:e] - projected
            near = b + np.flatnonzero(np.einsum("ij,ij->i", away, away) <= limit)
            self.verified += len(near)
            found, score = self.ids[near], self.vectors[near] @ vector
            good = (score >= bound) & (found != own)
            if good.any():
                ids, scores = np.r_[ids, found[good]], np.r_[scores, score[good]]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    bound = max(bound, scores[-1])
        return ids, scores


def dealt(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """A number below ``among`` for each id."""
    return (mixed(ids.astype(np.int64).view(np.uint64)) % among.astype(np.uint64)).astype(np.int64)


def neighbours(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
               dimensions: int = DIMENSIONS, miss: float = MISS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank from 1, id and score of each query's k nearest found; ``is_query`` is SQL over the columns of ``vectors``."""
    fine = F.expr(f"exists(`{vector_col}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) = false "
                  f"AND exists(`{vector_col}`, x -> x <> 0)")
    clean = (
        vectors.where(fine & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"),
                F.col(vector_col).cast("array<double>").alias("vector"))
        .groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    clean = stored(clean.withColumn("norm2", norm2), "vectors")
    # The rank is cut at k + 1 before rows are dealt out by vector, so many copies of one are no large group.
    copies = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    able = stored(clean.select("id", "vector", "norm2", F.row_number().over(copies).alias("copy")).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    size = able.agg(F.count("*").alias("n"), F.max("norm2").alias("norm2"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], size["width"] or 1
    largest = float(np.sqrt(size["norm2"] or 1.0))
    directions = np.random.default_rng(7).standard_normal((width + 1, dimensions))
    ratio = stop_ratio(miss, dimensions)
    depth = min(depth_for(n, cell_rows), int(np.log2(max(1, SAMPLE_ROWS / CELL_SAMPLE))))

    def matrix(column: pa.Array) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        out = np.zeros((len(column), width))
        sizes = np.diff(column.offsets.to_numpy())
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
        return out

    def lifted(x: np.ndarray) -> np.ndarray:
        """Projections of candidates, whose one more coordinate brings them to the largest norm."""
        rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0.0))
        return x @ directions[:-1] + rest[:, None] * directions[-1]

    def scaled(x: np.ndarray) -> np.ndarray:
        return (x * (largest / np.sqrt((x**2).sum(axis=1)))[:, None]) @ directions[:-1]

    # The cells: splits of a sample of bounded size. Their boxes come from all rows.
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = able.where(hash_share("id") < share).orderBy(hash_share("id")).limit(SAMPLE_ROWS).select("vector").toArrow()
    nodes = splits(lifted(matrix(sample.column("vector"))), depth) if depth else np.zeros((0, 2))

    def to_cells(batches):
        for batch in batches:
            cell = leaf_of(lifted(matrix(batch.column("vector"))), nodes) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("id"), batch.column("vector")], names=["cell", "id", "vector"])

    candidates = stored(able.select("id", "vector").mapInArrow(to_cells, "cell long, id long, vector array<double>"), "cells")

    def boxes_of(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            cell, points = batch.column("cell").to_numpy(), lifted(matrix(batch.column("vector")))
            for c in np.unique(cell).tolist():
                own = points[cell == c]
                low[c] = np.minimum(low.get(c, np.inf), own.min(axis=0))
                high[c] = np.maximum(high.get(c, -np.inf), own.max(axis=0))
                rows[c] = rows.get(c, 0) + len(own)
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(list(low), pa.int64()), "rows": pa.array(list(rows.values()), pa.int64()), "low": pa.array([x.tolist() for x in low.values()], pa.list_(pa.float64())),
            "high": pa.array([x.tolist() for x in high.values()], pa.list_(pa.float64()))})

    parts = candidates.mapInArrow(boxes_of, "cell long, rows long, low array<double>, high array<double>")
    limits = parts.groupBy("cell").agg(
        F.sum("rows").alias("rows"),
        F.array(*(F.min(F.col("low")[i]) for i in range(dimensions))).alias("low"),
        F.array(*(F.max(F.col("high")[i]) for i in range(dimensions))).alias("high"))
    # A box a cell; the sample bounds their number.
    boxes = limits.toArrow().sort_by("cell")
    cells = boxes.column("cell").to_numpy()
    low = np.array(boxes.column("low").to_pylist()).reshape(-1, dimensions)
    high = np.array(boxes.column("high").to_pylist()).reshape(-1, dimensions)
    parts_of = -(-boxes.column("rows").to_numpy() // cell_rows)

    def route(batches):
        """The cell of each query by the splits; where that one is empty, another one."""
        for batch in batches:
            points = scaled(matrix(batch.column("vector"))) if len(batch) else np.zeros((0, dimensions))
            home = cells[np.minimum(np.searchsorted(cells, leaf_of(points, nodes)), len(cells) - 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array(home, pa.int64()), batch.column("id"), batch.column("vector"), pa.array(np.full(len(batch), -np.inf))],
                names=["cell", "id", "vector", "bound"])

    def route_on(batches):
        """The other cells that the stopping test leaves open."""
        for batch in batches:
            x = matrix(batch.column("vector")) if len(batch) else np.zeros((0, width))
            bound, home = batch.column("bound").to_numpy(), batch.column("home").to_numpy()
            rows, to = [], []
            for i, p in enumerate(scaled(x)):
                far = (np.maximum(0.0, np.maximum(low - p, p - high)) ** 2).sum(axis=1)
                near = 2.0 * largest**2 - 2.0 * largest / np.sqrt((x[i] ** 2).sum()) * bound[i]
                open_ = cells[(far <= ratio * max(near, 0.0)) & (cells != home[i])]
                rows += [i] * len(open_)
                to += open_.tolist()
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), kept.column("id"), kept.column("vector"), kept.column("bound")],
                                             names=["cell", "id", "vector", "bound"])

    asked = "cell long, id long, vector array<double>, bound double"

    def searched(queries: DataFrame) -> DataFrame:
        """Each query's best k of its cell. A group's candidates come before its queries, which stream."""
        asking = queries.groupBy("cell").count().toArrow()
        copies_of = np.ones(len(cells), np.int64)
        copies_of[np.searchsorted(cells, asking.column("cell").to_numpy())] = -(-asking.column("count").to_numpy() // cell_rows)
        begin = np.r_[0, np.cumsum(parts_of * copies_of)]

        def spread(batches, asks: bool):
            """Candidates go to all copies of one part of their cell, queries to one copy of all parts; a group is a part's copy."""
            for batch in batches:
                at, ids = np.searchsorted(cells, batch.column("cell").to_numpy()), batch.column("id").to_numpy()
                times = (parts_of if asks else copies_of)[at]
                row = np.repeat(np.arange(len(at)), times)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                fixed = dealt(ids, (copies_of if asks else parts_of)[at])[row]
                group = begin[at[row]] + (turn * copies_of[at[row]] + fixed if asks else fixed * copies_of[at[row]] + turn)
                kept = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), *kept.columns[1:]], names=batch.schema.names)

        held = candidates.mapInArrow(lambda batches: spread(batches, False), "cell long, id long, vector array<double>")
        both = held.select("cell", "id", "vector", F.lit(None).cast("double").alias("bound"), F.lit(0).alias("kind")).unionByName(
            queries.mapInArrow(lambda batches: spread(batches, True), asked).withColumn("kind", F.lit(1))).repartition("cell").sortWithinPartitions("cell", "kind")

        def search(batches):
            waiting, tree, of = [], None, None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                cell, kind = table.column("cell").to_numpy(), table.column("kind").to_numpy()
                for c in np.unique(cell).tolist():
                    mine = table.filter(pa.array((cell == c) & (kind == 0)))
                    if c != of:
                        waiting, tree, of = [], None, c
                    if len(mine):
                        waiting.append(mine)
                    asks = table.filter(pa.array((cell == c) & (kind == 1)))
                    if not len(asks) or not (waiting or tree):
                        continue
                    if tree is None:
                        whole = pa.concat_tables(waiting)
                        x = matrix(whole.column("vector"))
                        tree, waiting = Cell(whole.column("id").to_numpy(), x, lifted(x)), []
                    x = matrix(asks.column("vector"))
                    points, out = scaled(x), ([], [], [])
                    for i, (own, bound) in enumerate(zip(asks.column("id").to_pylist(), asks.column("bound").to_pylist())):
                        ids, scores = tree.nearest(own, x[i], points[i], k, ratio, largest, bound)
                        for part, values in zip(out, (np.full(len(ids), own), ids, scores)):
                            part.append(values)
                    yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "id", "score"), (np.concatenate(p) for p in out))))

        return both.mapInArrow(search, "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        """One row a query: its k best as (-score, id), partial lists first."""
        pair = F.struct((-F.col("score")).alias("minus"), F.col("id").alias("id"))
        lists = found.groupBy("query_id").agg(F.collect_list(pair).alias("found"))
        return lists.select("query_id", F.slice(F.array_sort("found"), 1, k).alias("found"))

    queries = clean.where("asks").select("id", "vector")
    homes = stored(queries.mapInArrow(route, asked), "homes")
    first = stored(searched(homes), "near")
    at_home = best(first).select(F.col("query_id").alias("id"), F.when(F.size("found") == k, -F.element_at("found", -1)["minus"]).alias("bound"))
    onward = homes.drop("bound").withColumnRenamed("cell", "home").join(at_home, "id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("-inf"))))
    second = searched(stored(onward.mapInArrow(route_on, asked), "onward"))
    ranked = best(first.unionByName(second)).select("query_id", F.posexplode("found").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.minus")).alias("score"))
