"""Benchmark decontamination on a positional inverted index of the documents.

``build_index`` tokenises whole documents and stores, shard by shard, the posting list of every token: its
places in the shard, in order. A shard is a run of documents of bounded size, so shards are searched apart.
``search`` takes a block of test items; for every window of an item it starts from the posting list of the rarest
term and intersects it with the other lists, each shifted by its offset, until none or all terms are matched
(``phrase``), or keeps the places of the rarest term that have every other term nearby (``proximity``).

Words are compared by 64-bit codes. Defined results: a null text has no words; an item without words or with a null
id takes no part; items of the same id are one item with several texts; repeated documents are judged each.
Test items are tokenised into a stored table of blocks of about ``BLOCK_WORDS`` words. The driver holds one block at a
time: it hands it to the tasks, which make the windows, and has the found matches stored before it takes the next.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.llm.common import row_ranges, shared_folder, stored, text_chunks
from forecast_duel.llm.words import ALPHANUMERIC, words

WINDOW = 13
SHARD_BYTES = 2 << 20
#: Bound of what a search sends to its tasks: words of one block of items.
BLOCK_WORDS = 1_000_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its documents, where their words begin, and the postings of all its tokens, stored."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("shard", T.StringType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("first", T.BinaryType()), T.StructField("terms", T.BinaryType()),
        T.StructField("begins", T.BinaryType()), T.StructField("postings", T.BinaryType()),
    ])

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text", shard_bytes):
                found = words(data, offsets, ALPHANUMERIC)
                order = np.argsort(found.code, kind="stable").astype(np.uint32)
                terms, begins = np.unique(found.code[order], return_index=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{n}"]),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("id").slice(i, j - i)),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (
                        found.first.astype(np.uint32), terms, np.r_[begins, len(order)].astype(np.uint32), order)),
                ], names=schema.names)
                n += 1

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(source.mapInArrow(run, schema), "postings", {"parquet.block.size": 16 << 20})


def item_windows(first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and size of each window of items that begin at ``first``; one with fewer words is one shorter window."""
    length = np.diff(first)
    n = np.maximum(length - window, 0) + 1
    of = np.repeat(np.arange(len(length)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), np.minimum(length, window)[of]


class Shard:
    """The posting lists of one shard."""

    def __init__(self, first: bytes, terms: bytes, begins: bytes, postings: bytes):
        self.first = np.frombuffer(first, np.uint32).astype(np.int64)
        self.terms = np.frombuffer(terms, np.uint64)
        self.begins = np.frombuffer(begins, np.uint32).astype(np.int64)
        self.postings = np.frombuffer(postings, np.uint32)

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term number and length of the posting list of each code; no list has length 0."""
        if not len(self.terms):
            return np.zeros(codes.shape, np.int64), np.zeros(codes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return at, np.where(self.terms[at] == codes, self.begins[at + 1] - self.begins[at], 0)

    def places(self, term: int) -> np.ndarray:
        return self.postings[self.begins[term] : self.begins[term + 1]].astype(np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def phrase(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places where the terms follow one another within a document."""
        order = np.argsort(sizes, kind="stable")
        at = self.places(terms[order[0]]) - order[0]
        at = at[(at >= 0) & (at + len(terms) <= self.first[-1])]
        for k in order[1:]:
            if not len(at):
                return at
            other = self.places(terms[k]) - k
            near = np.minimum(np.searchsorted(other, at), len(other) - 1)
            at = at[other[near] == at]
        return at[self.document(at) == self.document(at + len(terms) - 1)] if len(at) else at

    def proximity(self, terms: np.ndarray, sizes: np.ndarray, within: int) -> np.ndarray:
        """Places of the rarest term that have every other term in the same document, ``within`` words away at most."""
        order = np.argsort(sizes, kind="stable")
        at = self.places(terms[order[0]])
        for k in order[1:]:
            if not len(at):
                return at
            other, doc = self.places(terms[k]), self.document(at)
            low = np.maximum(at - within, self.first[doc])
            high = np.minimum(at + within, self.first[doc + 1] - 1)
            at = at[np.searchsorted(other, low) < np.searchsorted(other, high, side="right")]
        return at


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Sorted intervals as their unions."""
    out: list[list[int]] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def search_block(index: DataFrame, items: pa.Table, id_col: str, item_type: T.DataType, window: int, within: int | None) -> DataFrame:
    """Matches of one bounded block of (item id, word codes) in every shard, one row a document."""
    schema = T.StructType([
        T.StructField("shard", T.StringType()), T.StructField("ordinal", T.IntegerType()),
        T.StructField(id_col, index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()),
        T.StructField("matches", T.ArrayType(T.StructType([
            T.StructField("item_id", item_type), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ])
    names = items.column("item").to_pylist()
    lists = items.column("codes").combine_chunks()
    flat, sizes_of = lists.flatten().to_numpy().view(np.uint64), pc.list_value_length(lists).to_numpy()
    first = np.r_[0, np.cumsum(sizes_of, dtype=np.int64)]

    def matches_of(shard: Shard, of: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> dict[int, list[tuple]]:
        spans: dict[tuple, list[tuple[int, int]]] = {}
        terms, sizes = shard.lookup(flat)
        there = np.r_[0, np.cumsum(sizes > 0)]
        for row in np.flatnonzero(there[starts + lengths] - there[starts] == lengths):
            own = slice(starts[row], starts[row] + lengths[row])
            if within is None:
                at = shard.phrase(terms[own], sizes[own])
                ends = at + lengths[row]
            else:
                at = shard.proximity(terms[own], sizes[own], within)
                ends = at + 1
            for doc, s, e in zip(shard.document(at).tolist(), at.tolist(), ends.tolist()):
                spans.setdefault((doc, names[of[row]]), []).append((s - int(shard.first[doc]), e - int(shard.first[doc])))
        out: dict[int, list[tuple]] = {}
        for (doc, item), found in spans.items():
            found.sort()
            out.setdefault(doc, []).extend((item, s, e) for s, e in merged(*np.array(found).T))
        return out

    def run(batches):
        windows = item_windows(first, window)
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                shard = Shard(*(row[c].as_py() for c in ("first", "terms", "begins", "postings")))
                found, n = matches_of(shard, *windows), len(row["ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), row["ids"].values,
                    pa.array(np.diff(shard.first)),
                    pa.array([[dict(zip(("item_id", "start", "end"), m)) for m in sorted(found.get(d, []), key=lambda m: m[1:])]
                              for d in range(n)], pa.list_(pa.struct([
                                  ("item_id", item_arrow), ("start", pa.int32()), ("end", pa.int32())]))),
                ], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)
    return index.mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
           window: int = WINDOW, within: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document of the index: id, n_words and matches (item_id, start and end word), spans of an item united within a block.

    ``within`` asks for proximity instead of exact phrases.
    """
    def codes(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text"):
                found = words(data, offsets, ALPHANUMERIC)
                lists = pa.ListArray.from_arrays(pa.array(found.first, pa.int32()), pa.array(found.code.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, j - i), lists], names=["item", "codes"])

    item_type = items.schema[item_col].dataType
    named = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    tokens = stored(named.mapInArrow(codes, T.StructType([
        T.StructField("item", item_type), T.StructField("codes", T.ArrayType(T.LongType()))])).where("size(codes) > 0"), "items")
    blocks = -(-(tokens.agg(F.sum(F.size("codes"))).first()[0] or 0) // block_words)
    if blocks <= 1:
        return search_block(index, tokens.toArrow(), id_col, item_type, window, within).drop("shard", "ordinal")
    # Rows of a block lie together, so each block is read with few others.
    number = F.pmod(F.xxhash64("item", "codes"), F.lit(blocks))
    numbered = stored(tokens.withColumn("block", number).repartition("block").sortWithinPartitions("block"), "blocks")
    path = f"{shared_folder(index.sparkSession)}/matches-{uuid.uuid4().hex}"
    for b in range(blocks):
        found = search_block(index, numbered.where(F.col("block") == b).select("item", "codes").toArrow(), id_col, item_type, window, within)
        # The first block names all documents, the others those they match.
        (found.where("size(matches) > 0") if b else found).write.mode("append").parquet(path)
    together = index.sparkSession.read.schema(found.schema).parquet(path)
    return (
        together.groupBy("shard", "ordinal")
        .agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"),
             F.flatten(F.collect_list("matches")).alias("matches"))
        .drop("shard", "ordinal")
    )


def covered_words(matches: str = "matches") -> Column:
    """How many words the spans of a document cover together."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda a, m: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), m["e"] - F.greatest(m["s"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], m["e"].cast("long")).alias("reach")),
        lambda a: a["n"],
    )


def contamination(found: DataFrame) -> DataFrame:
    """The matches of ``search`` with n_hit, the sorted item ids and the rule of a twentieth of the words."""
    n_hit = covered_words()
    return found.select(
        "*", n_hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string")))).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
