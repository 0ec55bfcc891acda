"""Near duplicates by shingle sets: an exact Jaccard join on count-vector R-trees.

Shingles are hashed into groups; the counts by group make a set a point. The overlap of two sets is at most the sum
of the smaller counts, so a node of an R-tree can be left out when the sum against its largest counts is below what
a link needs. Pairs that survive are verified on the sets themselves.

High-dimensional points do not cluster, so a tree over all documents would visit nearly all of its nodes. Sets are
therefore dealt out first, without loss: in any fixed order of shingles two linked sets share one of their first
``n - ceil(0.75 n) + 1`` shingles. The order is by frequency in a counting sketch of fixed size, so the shared
first shingles are rare ones. Sets that share one make a bucket, and every bucket gets a tree.

Equal sets are one class. A first round links each class within one of its buckets; after that, only pairs of different
components are compared, in all buckets. So a large group of near copies costs a few links for each member,
and no round makes all its pairs. Buckets are split into blocks of bounded size.

Sets and words are compared by 64-bit codes. Defined results: a document without words or with a null text has no
shingles and is a component of its own; repeated rows are returned each; a null id never names a component
unless all its documents have a null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.llm import sketch
from forecast_duel.llm.common import stored, text_chunks, unused
from forecast_duel.llm.components import components
from forecast_duel.llm.words import SPACED, mixed, words

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Fewest groups that shingles are hashed into, the dimensions of an R-tree; larger sets have one for every two to four shingles.
GROUPS = 64
LEAF = 16
#: Sets of a bucket that a task compares at once.
BLOCK = 256
#: Codes that a task holds before it counts them.
CODES = 1 << 18


def shingles(code: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct codes of the word n-grams of one document; fewer words make one n-gram."""
    if not len(code):
        return np.zeros(0, np.uint64)
    n = min(size, len(code))
    total = np.full(len(code) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total + code[k : len(code) - n + 1 + k])
    return np.unique(total)


def class_of(own: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    return int(mixed(np.array([mixed(own).sum() + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def sets_of(batch: pa.RecordBatch):
    """(row, shingle codes) of every text of a batch."""
    for i, j, data, offsets in text_chunks(batch, "text"):
        found = words(data, offsets, SPACED)
        for k in range(j - i):
            yield i + k, shingles(found.code[found.first[k] : found.first[k + 1]])


def in_runs(batches, key: str):
    """Tables of whole groups of rows with the same ``key``, from batches sorted by it."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        values = table.column(key).to_numpy()
        if not len(values):
            continue
        last = int(np.searchsorted(values, values[-1], side="left")) if values.dtype.kind in "iu" else 0
        rest = table.slice(last)
        if last:
            yield table.slice(0, last)
    if rest is not None and rest.num_rows:
        yield rest


class Tree:
    """An R-tree over count vectors, bulk-loaded by size and position; nodes keep the largest counts of their points."""

    def __init__(self, points: np.ndarray):
        points = points.astype(np.int64)
        self.points, self.sizes = points, points.sum(axis=1)
        order = np.lexsort((*self.points[:, :3].T, self.sizes))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.levels = [(np.stack([self.points[x].max(axis=0) for x in self.leaves]), np.array([self.sizes[x].min() for x in self.leaves]))]
        while len(self.levels[-1][0]) > LEAF:
            top, least = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut, axis=0), np.minimum.reduceat(least, cut)))

    def candidates(self, i: int) -> np.ndarray:
        """Points whose overlap with point i can be large enough, nearest bound first."""
        point, size = self.points[i], self.sizes[i]
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[level]
            nodes = nodes[np.minimum(top[nodes], point).sum(axis=1) >= needed(size, least[nodes])]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.leaves[x] for x in nodes])
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        rows, bound = rows[ok := bound >= needed(size, self.sizes[rows])], bound[ok]
        return rows[np.argsort(-bound, kind="stable")]


def point_of(own: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each group; the number of groups, a power of two, grows with the set."""
    groups = max(GROUPS, 1 << max(len(own) // 2, 1).bit_length() - 1)
    return np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same set's point in fewer groups."""
    return point.reshape(-1, groups).sum(axis=0) if len(point) > groups else point


class Forest:
    """A tree for each number of groups. Linked sets differ by less than a factor of two, so each set is in the tree
    of its own groups and, folded, in that of half as many."""

    def __init__(self, points: list[np.ndarray]):
        self.groups = np.array([len(p) for p in points])
        self.trees, self.members = {}, {}
        for g in np.unique(self.groups).tolist():
            rows = np.flatnonzero((self.groups == g) | (self.groups == 2 * g))
            self.members[g] = rows
            self.trees[g] = Tree(np.stack([folded(points[k], g) for k in rows]))

    def candidates(self, i: int) -> np.ndarray:
        """Sets that the bound does not rule out, itself among them."""
        g = int(self.groups[i])
        found = [self._in_tree(g, i)]
        if g // 2 in self.trees:
            smaller = self._in_tree(g // 2, i)
            found.append(smaller[self.groups[smaller] == g // 2])
        return np.concatenate(found)

    def _in_tree(self, g: int, i: int) -> np.ndarray:
        rows = self.members[g]
        return rows[self.trees[g].candidates(int(np.searchsorted(rows, i)))]


def points_in(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= needed(len(a), len(b))


def links(names: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, ask: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that join different components: enough of them to join all that the ``ask`` rows link to."""
    tree = Forest([point_of(s) for s in sets])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(ask):
        for j in tree.candidates(int(i)).tolist():
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b and linked(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                out.append((int(names[i]), int(names[j])))
    return out


def compared(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) found in ``groups`` (key, class, label, ask); the rows of a key are compared in one task."""
    rows = groups.join(sets, "class").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for table in in_runs(batches, "key"):
            key = table.column("key").to_numpy()
            names, labels = table.column("class").to_numpy(), table.column("label").to_numpy()
            ask, raw = table.column("ask").to_numpy(), table.column("shingles")
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found: list[tuple[int, int]] = []
            for b, e in zip(begins, np.r_[begins[1:], len(key)]):
                if e - b > 1:
                    own = [np.frombuffer(raw[k].as_py(), np.uint64) for k in range(b, e)]
                    found += links(names[b:e], own, labels[b:e], ask[b:e])
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.select("key", "class", "label", "ask", "shingles").mapInArrow(run, "u long, v long")


def blocks_of(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")


def narrowed(groups: DataFrame, points: DataFrame) -> DataFrame:
    """The classes of ``groups`` that the overlap bound leaves with a partner of another label, as new buckets.

    Few classes stay, each in many groups. Groups around one component become one bucket, so that a set moves once for each.
    """
    rows = groups.join(points, "class").select("key", "class", "label", "ask", "most", "point").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for table in in_runs(batches, "key"):
            table = table.combine_chunks()
            key, name = table.column("key").to_numpy(), table.column("class").to_numpy()
            label, ask, most = (table.column(c).to_numpy() for c in ("label", "ask", "most"))
            at = points_in(table.column("point"))
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            keep = np.zeros(len(key), bool)
            for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(key)]):
                own, tree = label[b:e], Forest(at[b:e])
                for i in np.flatnonzero(ask[b:e]).tolist():
                    other = tree.candidates(i)
                    other = other[own[other] != own[i]]
                    if len(other):
                        keep[b + i] = keep[b + other] = True
            yield pa.RecordBatch.from_pydict({"bucket": most[keep], "class": name[keep]})

    return rows.mapInArrow(run, "bucket long, class long").distinct()


def in_blocks(members: DataFrame) -> DataFrame:
    """(key, class, label, ask): each bucket's ``members`` (bucket, class, label) dealt out to blocks."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    dealt = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("class"), blocks_of("n")))
    return dealt.select(F.xxhash64("bucket", "block").alias("key"), "class", "label", F.lit(True).alias("ask"))


def across(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, class, label, ask, most) such that in every bucket each class outside of its largest component meets all others.

    ``most`` is that largest component of the bucket.
    """
    named = buckets.join(labels, "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("label"))
    by_label = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = by_label.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("n_most"),
    ).where("labels > 1").withColumn("few", F.col("n") - F.col("n_most"))
    member = named.join(open_, "bucket").select(
        "bucket", "class", "label", "most", (F.col("label") != F.col("most")).alias("apart"),
        blocks_of("n").alias("n_all"), blocks_of("few").alias("n_few"))
    own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    asked = member.select("*", F.explode(F.sequence(F.lit(0), F.col("n_few") - 1)).alias("j")).withColumn("k", own("n_all"))
    asking = member.where("apart").select("*", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("k")).withColumn("j", own("n_few"))
    key = F.xxhash64("bucket", "j", "k").alias("key")
    columns = [key, "class", "label", "most"]
    both = asked.select(*columns, F.lit(False).alias("ask")).unionByName(asking.select(*columns, F.lit(True).alias("ask")))
    return both.groupBy("key", "class").agg(*(F.max(c).alias(c) for c in ("label", "ask", "most")))


def measured(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(id, text_hash, n_shingles, class, point) of every row, stored, and the frequency sketch of the shingles.

    A task gives the point of a class once.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()),
                           T.StructField("point", T.BinaryType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        often, known, last = sketch.empty(), set(), None
        for batch in batches:
            last, n, name = batch, np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            new, held, point = [], 0, [None] * len(batch)
            for row, own in sets_of(batch):
                n[row], name[row] = len(own), class_of(own)
                if len(own) and int(name[row]) not in known:  # equal sets of a task count once
                    known.add(int(name[row]))
                    new.append(own)
                    held += len(own)
                    point[row] = point_of(own).astype(np.uint16).tobytes()
                    if held > CODES:
                        sketch.add(often, np.concatenate(new))
                        new, held = [], 0
            if new:
                sketch.add(often, np.concatenate(new))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(n), pa.array(name), pa.array(point, pa.binary()), pa.nulls(len(batch), pa.int32()),
                                              pa.nulls(len(batch), pa.binary())], names=schema.names)
        if last is not None:
            n = sketch.N_SLICES
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, last.column("id").type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), *sketch.as_slices(often)],
                names=schema.names)

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    both = stored(source.mapInArrow(run, schema), "sets")

    counts = sketch.total(both.where("slice IS NOT NULL"))
    return both.where("slice IS NULL").drop("slice", "counts"), counts


def bucketed(docs: DataFrame, text_col: str, often: np.ndarray) -> DataFrame:
    """(bucket, class): classes that share one of their first shingles; buckets of the same classes are one. Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def first_shingles(batches):
        counts, known = shared.value, set()
        for batch in batches:
            parts, names = [], []
            for _, own in sets_of(batch):
                if len(own) and (name := class_of(own)) not in known:
                    known.add(name)
                    size = prefix_size(len(own))
                    times = counts[sketch.places(own)]
                    parts.append(own[np.lexsort((own, times))[:size]])
                    names.append(np.full(size, name, np.int64))
            if parts:
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(parts).view(np.int64), "class": np.concatenate(names)})

    def grouped(batches):
        for table in in_runs(batches, "shingle"):
            key, name = table.column("shingle").to_numpy(), table.column("class").to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
            key, name = key[new], name[new]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begins, len(key)])
            bucket = mixed(np.add.reduceat(mixed(name.view(np.uint64)), begins) + sizes.astype(np.uint64)).view(np.int64)
            shared_by = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_pydict({"bucket": np.repeat(bucket, sizes)[shared_by], "class": name[shared_by]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(first_shingles, "shingle long, class long")
    rows = rows.repartition("shingle").sortWithinPartitions("shingle", "class")
    return stored(rows.mapInArrow(grouped, "bucket long, class long").distinct(), "buckets")


def promising(buckets: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of ``buckets`` whose class has a partner there that the overlap bound does not rule out. Stored.

    Buckets beyond the size of a block stay as they are; their pairs are bounded when they are compared.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
    sized = buckets.join(sizes, "bucket")
    small = sized.where(F.col("n") <= BLOCK).select("bucket", "class").join(points, "class")

    def search(batches):
        for table in in_runs(batches, "bucket"):
            table = table.combine_chunks()
            key, name = table.column("bucket").to_numpy(), table.column("class").to_numpy()
            at = points_in(table.column("point"))
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begins, len(key)])
            keep = np.zeros(len(key), bool)
            for b in begins[sizes == 2].tolist():
                g = min(len(at[b]), len(at[b + 1]))
                over = int(np.minimum(folded(at[b], g), folded(at[b + 1], g)).sum())
                keep[b] = keep[b + 1] = over >= needed(int(at[b].sum()), int(at[b + 1].sum()))
            for b, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                tree = Forest(at[b : b + n])
                for i in range(n):
                    if not keep[b + i]:
                        with_ = tree.candidates(i)
                        if len(with_) > 1:
                            keep[b + with_] = True
            yield pa.RecordBatch.from_pydict({"bucket": key[keep], "class": name[keep]})

    rows = small.select("bucket", "class", "point").repartition("bucket").sortWithinPartitions("bucket")
    large = sized.where(F.col("n") > BLOCK).select("bucket", "class")
    return stored(rows.mapInArrow(search, "bucket long, class long").unionByName(large), "promising")


def sets_table(docs: DataFrame, of_class: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(class, shingles) of the ``wanted`` classes. Stored.

    Copies of a text meet in one task, which gives their class once; a class that comes twice would do no harm.
    """
    def run(batches):
        known = set()
        for batch in batches:
            names, raw = [], []
            for _, own in sets_of(batch):
                if (name := class_of(own)) not in known:
                    known.add(name)
                    names.append(name)
                    raw.append(own.tobytes())
            yield pa.RecordBatch.from_pydict({"class": pa.array(names, pa.int64()), "shingles": pa.array(raw, pa.binary())})

    one = stored(of_class.join(wanted, "class", "left_semi").select("text_hash"), "wanted")
    # A bitmap of fixed size keeps most of the other texts out of the shuffle; the join decides.
    shared = docs.sparkSession.sparkContext.broadcast(sketch.members(one, "text_hash"))

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(sketch.may_hold(shared.value, batch.column("text_hash").to_numpy())))

    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.mapInArrow(likely, "text_hash long, text string").join(one, "text_hash", "left_semi")
    return stored(texts.select("text").mapInArrow(run, "class long, shingles binary"), "shingles")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_shingles, root and component_id (the smallest id that links reach) of every row.

    ``root`` names the component, it is null without shingles.
    """
    rows, often = measured(docs, id_col, text_col)
    classes = rows.where("n_shingles > 0").groupBy("class").agg(F.min("id").alias("id"), F.min("text_hash").alias("text_hash"))
    points = rows.where("point IS NOT NULL").groupBy("class").agg(F.first("point").alias("point"))
    buckets = promising(bucketed(docs, text_col, often), points)
    sets = sets_table(docs, classes, buckets.select("class").distinct(), text_col)
    first = buckets.groupBy("class").agg(F.min("bucket").alias("bucket")).withColumn("label", F.col("class"))
    edges = stored(compared(in_blocks(first), sets), "links")
    labels = stored(components(edges).withColumnRenamed("node", "class"), "labels")
    while True:  # one class for each component of a large bucket, until its components fit a block
        named = buckets.join(labels, "class", "left").select("bucket", F.coalesce("root", "class").alias("label"), "class")
        one = named.groupBy("bucket", "label").agg(F.min("class").alias("class"))
        large = one.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("bucket")
        if large.isEmpty():
            break
        new = stored(compared(in_blocks(one.join(large, "bucket", "left_semi")), sets), "links")
        if new.isEmpty():
            break
        edges = edges.unionByName(new)
        labels = stored(components(edges).withColumnRenamed("node", "class"), "labels")
    open_ = stored(narrowed(across(buckets, labels), points), "open")
    more = stored(compared(across(open_, labels), sets), "links")
    roots = stored(components(edges.unionByName(more)).withColumnRenamed("node", "class"), "labels")
    rooted = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = rooted.select("class", "root").join(smallest, "root").select("class", "root", "component_id")
    joined = rows.join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), "text_hash", "n_shingles", "root", component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, then of the smallest hash of the text."""
    found = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "text_hash", "root")
    row = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    firsts = found.where("root IS NOT NULL").groupBy("root").agg(F.min(row).alias("row")).select("row.id", "row.text_hash")
    stay = firsts.unionByName(found.where("root IS NULL").select("id", "text_hash").distinct())
    name = unused("_hash", docs.columns)
    hashed = docs.withColumn(name, F.xxhash64(text_col))
    kept = hashed.join(stay, hashed[id_col].eqNullSafe(stay["id"]) & (hashed[name] == stay["text_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)
