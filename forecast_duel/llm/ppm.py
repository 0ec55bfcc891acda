"""Language-model scores by prediction by partial matching over bytes.

``count_strings`` counts every string of order + 1 symbols of all training texts on the executors; shorter contexts are
sums of longer ones. A trie gives a symbol its frequency in the longest known context, escapes to shorter ones
with the share of distinct symbols (method C) and leaves out the symbols that longer contexts have already ruled out.
A text is scored whole, with a closing symbol; before its first byte stand padding symbols.

All counted strings take part, however many they are. They are dealt out to shards by the last two symbols of their
context, so every context of two symbols and more lies whole in one shard with its shorter ones; strings of one and two
symbols, whose number the alphabet bounds, are in all shards. A block of documents sends each of its distinct strings
once to the string's shard and gets its score (float32). A shard's askers are dealt to copies of it.

``adaptive`` scores a text by a trie that starts empty and learns as it reads.

The yardstick (``base_score``) adds log10 shares of whole words. Their counts are joined back block by block: a
block of documents sends each of its distinct words once and gets its count.

Defined results: a null text is empty and scores its closing symbol; repeated rows are scored each; without training
texts every symbol has the same share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecast_duel.llm.common import stored, text_chunks
from forecast_duel.llm.words import SPACED, mixed, words

ORDER = 5
#: Strings of a shard on average; more strings make more shards. There are ``SHARDS`` at least.
MAX_NODES = 1_000_000
SHARDS = 64
#: Blocks that ask one copy of a shard.
ASKERS = 64
BLOCK_BYTES = 8 << 20
#: Bytes of text whose strings are made at once (each takes 8 bytes, several times), and strings a task holds uncombined.
GRAM_BYTES, LOOSE = 1 << 18, 1_000_000
BITS, END, PAD, SYMBOLS = 9, 256, 257, 257


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each symbol of each text with its context, and where each text begins."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.full(len(data) + len(sizes) * (order + 1), PAD, np.int64)
    symbols[np.arange(len(data)) + doc * (order + 1) + order] = data
    ends = offsets[1:] + np.arange(len(sizes)) * (order + 1) + order
    symbols[ends] = END
    key = symbols[order:].copy()
    for k in range(1, order + 1):
        key |= symbols[order - k : len(symbols) - k] << (BITS * k)
    first = offsets[:-1] + np.arange(len(sizes)) * (order + 1)
    own = np.ones(len(key), bool)
    for k in range(order):  # strings that end in the next text's padding
        own[(first[1:] - 1 - k)[first[1:] - 1 - k >= 0]] = False
    return key[own], offsets + np.arange(len(offsets))


def distinct(key: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    key = np.sort(key)
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each string: a number of the last two symbols of its context. ``SHARD_SQL`` is the same in SQL."""
    pair = (key >> BITS) & ((1 << (2 * BITS)) - 1)
    return ((pair * 2654435761 >> 12) & 0xFFFFF) % shards


SHARD_SQL = f"CAST(shiftright((shiftright(gram, {BITS}) & {(1 << (2 * BITS)) - 1}L) * 2654435761L, 12) & {0xFFFFF}L AS LONG) % {{shards}}"


def by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted strings by shard, then by number; where each shard begins (one entry more than shards)."""
    shard = shard_of(key, shards)
    place = np.argsort(shard, kind="stable")
    return key[place], np.searchsorted(shard[place], np.arange(shards + 1))


def planes(x: np.ndarray) -> bytes:
    """The numbers with all first bytes together, then all second ones: sorted numbers compress well so."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Trie:
    """By order: known strings with counts; known contexts with total, distinct symbols and what they exclude below."""

    order: int
    keys: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    totals: tuple[np.ndarray, ...]
    distinct: tuple[np.ndarray, ...]
    excluded: tuple[np.ndarray, ...]
    slot_key: np.ndarray  # the common strings by hash, for one look each
    slot_score: np.ndarray

    @staticmethod
    def build(levels: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Trie:
        """``levels`` has strings and counts by order; an order that is missing is the sum of the next longer one."""
        keys, counts, contexts, totals, distinct, excluded = [], [], [], [], [], []
        filled = dict(levels)
        for k in range(order - 1, -1, -1):
            if k not in filled:
                top, n = filled[k + 1]
                known, at = np.unique(top & np.int64((1 << (BITS * (k + 1))) - 1), return_inverse=True)
                filled[k] = known, np.bincount(at, n, len(known))
        for k in range(order + 1):
            place = np.argsort(filled[k][0])
            known, count = filled[k][0][place], filled[k][1][place].astype(np.float64)
            context, inside = np.unique(known >> BITS, return_inverse=True)
            keys.append(known)
            counts.append(count)
            contexts.append(context)
            totals.append(np.bincount(inside, count, len(context)))
            distinct.append(np.bincount(inside, minlength=len(context)).astype(np.float64))
            if k:
                below = np.searchsorted(keys[k - 1], known & np.int64((1 << (BITS * k)) - 1))
                excluded.append(np.bincount(inside, counts[k - 1][below], len(context)))
            else:
                excluded.append(np.zeros(len(context)))
        trie = Trie(order, *map(tuple, (keys, counts, contexts, totals, distinct, excluded)), np.zeros(0, np.int64), np.zeros(0))
        bits = max(10, int(np.ceil(np.log2(2 * len(keys[order]) + 1))))
        slot_key, slot_score = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        by_count = np.argsort(counts[order], kind="stable")  # the most frequent string of a slot is written last
        slot = trie.slot(keys[order][by_count], bits)
        slot_key[slot] = keys[order][by_count]
        at = np.searchsorted(contexts[order], keys[order] >> BITS)
        slot_score[slot] = np.log10(counts[order] / (totals[order][at] + distinct[order][at]))[by_count]
        return Trie(order, *map(tuple, (keys, counts, contexts, totals, distinct, excluded)), slot_key, slot_score)

    @staticmethod
    def slot(key: np.ndarray, bits: int) -> np.ndarray:
        return mixed(key.view(np.uint64)) >> np.uint64(64 - bits)

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each string after the symbols before it."""
        slot = self.slot(key, int(np.log2(len(self.slot_key))))
        out = self.slot_score[slot].astype(np.float64)
        rare = np.flatnonzero(self.slot_key[slot] != key)
        if len(rare):
            different, at = np.unique(key[rare], return_inverse=True)
            out[rare] = self.walk(different)[at]
        return out

    def walk(self, key: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
        outer_distinct, outer_excluded = np.zeros(len(key)), np.zeros(len(key))
        for k in range(self.order, -1, -1):
            if not len(self.keys[k]):
                continue
            own = key & np.int64((1 << (BITS * (k + 1))) - 1)
            context = np.minimum(np.searchsorted(self.contexts[k], own >> BITS), len(self.contexts[k]) - 1)
            known = open_ & (self.contexts[k][context] == own >> BITS)
            at = np.minimum(np.searchsorted(self.keys[k], own), len(self.keys[k]) - 1)
            hit = known & (self.keys[k][at] == own)
            new = self.distinct[k][context] - outer_distinct
            space = self.totals[k][context] - outer_excluded + new
            out[hit] += np.log10(self.counts[k][at][hit] / space[hit])
            miss = known & ~hit & (new > 0)
            out[miss] += np.log10(new[miss] / space[miss])
            open_ &= ~hit
            outer_distinct = np.where(known, self.distinct[k][context], outer_distinct)
            outer_excluded = np.where(known, self.excluded[k][context], outer_excluded)
        unseen = SYMBOLS - (self.distinct[0][0] if len(self.distinct[0]) else 0)
        out[open_] -= np.log10(max(unseen, 1))
        return out


class Scores:
    """The scores of the distinct strings of a block, found by hash and else by search."""

    def __init__(self, key: np.ndarray, score: np.ndarray):
        place = np.argsort(key)
        self.key, self.score = key[place], score[place]
        self.bits = max(10, int(np.ceil(np.log2(2 * len(key) + 1))))
        self.slot_key, self.slot_score = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        slot = Trie.slot(self.key, self.bits)
        self.slot_key[slot], self.slot_score[slot] = self.key, self.score
        # Of the strings of a slot one is written; both arrays must hold the same one.
        self.slot_score[slot] = self.score[np.searchsorted(self.key, self.slot_key[slot])]

    def of(self, key: np.ndarray) -> np.ndarray:
        slot = Trie.slot(key, self.bits)
        out = self.slot_score[slot].astype(np.float64)
        other = np.flatnonzero(self.slot_key[slot] != key)
        out[other] = self.score[np.searchsorted(self.key, key[other])]
        return out


def count_strings(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Count the strings of all texts of ``docs``; every task sends each of its distinct strings once."""
    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def together():
            key = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.int64)
            known, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in parts]), len(known)) if parts else np.zeros(0)
            return known, n.astype(np.int64)

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch, text_col, GRAM_BYTES):
                parts.append(np.unique(grams(data, offsets, order)[0], return_counts=True))
                if sum(len(k) for k, _ in parts[1:]) > LOOSE:
                    parts[:] = [together()]
        known, n = together()
        for i in range(0, len(known), 1 << 16):
            yield pa.RecordBatch.from_pydict({"gram": known[i : i + (1 << 16)], "n": n[i : i + (1 << 16)]})

    counted = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return stored(counted, "grams")


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and is told each symbol after it was scored."""
    from math import log10

    seen: dict[tuple, dict[int, int]] = {}
    symbols, total = [*text, END], 0.0
    for i, symbol in enumerate(symbols):
        out: set[int] = set()
        tails = [tuple(symbols[i - k : i]) for k in range(min(order, i), -1, -1)]
        for tail in tails:
            left = {s: n for s, n in seen.get(tail, {}).items() if s not in out}
            if not left:
                continue
            space = sum(left.values()) + len(left)
            if symbol in left:
                total += log10(left[symbol] / space)
                break
            total += log10(len(left) / space)
            out |= left.keys()
        else:
            total -= log10(max(SYMBOLS - len(out), 1))
        for tail in tails:
            counts = seen.setdefault(tail, {})
            counts[symbol] = counts.get(symbol, 0) + 1
    return total


def score_documents(docs: DataFrame, training: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                    max_nodes: int = MAX_NODES, mode: str = "pretrained", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, training flag and, for each text, n_tokens, n_known, train_tokens, base_score and score.

    ``training`` is a boolean SQL expression over the columns of ``docs``: the rows to learn from.
    ``mode`` is ``pretrained`` or ``adaptive``.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.expr(training), F.lit(False)).alias("learn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("learn").alias("learned")).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    blocked = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition("block")

    pretrained = mode == "pretrained"
    strings = count_strings(source.where("learn").select("text"), order=order) if pretrained else None
    shards = max(SHARDS, -(-strings.count() // max_nodes)) if pretrained else 1
    copies = -(-blocks // ASKERS)

    def ask(table: pa.Table) -> pa.Table:
        """The distinct words of a block with their training counts, and its distinct strings by shard."""
        code, weight, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in table.to_batches():
            taught = batch.column("learn").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch, "text", GRAM_BYTES):
                found = words(data, offsets, SPACED)
                code.append(found.code.view(np.int64))
                weight.append(np.repeat(taught[i:j], np.diff(found.first)).astype(np.int64))
                if pretrained:
                    key.append(distinct(grams(data, offsets, order)[0]))
        word, at = np.unique(np.concatenate(code), return_inverse=True)
        n = np.bincount(at, np.concatenate(weight), len(word)).astype(np.int64)
        key, first = by_shard(distinct(np.concatenate(key)), shards)
        used = np.flatnonzero(np.diff(first))
        return pa.Table.from_pydict({
            "block": np.full(len(word) + len(used), table.column("block")[0].as_py(), np.int32),
            "word": pa.concat_arrays([pa.array(word), pa.nulls(len(used), pa.int64())]),
            "n": pa.concat_arrays([pa.array(n), pa.nulls(len(used), pa.int64())]),
            "shard": pa.concat_arrays([pa.nulls(len(word), pa.int64()), pa.array(used)]),
            "data": pa.concat_arrays([pa.nulls(len(word), pa.binary()), pa.array([planes(key[first[q] : first[q + 1]]) for q in used], pa.binary())])})

    asked = stored(blocked.select("block", "learn", "text").groupBy("block").applyInArrow(
        ask, "block int, word long, n long, shard long, data binary"), "asked")
    counts = stored(
        asked.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    learned = int(size["learned"] or 0)
    n_all, n_distinct = int(sums["n"] or 0) + learned, int(sums["distinct"] or 0) + (learned > 0)
    known = counts.where("n > 0").select(
        F.explode("blocks").alias("block"), "word", "n", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("data"))

    if pretrained:
        # Strings of one and two symbols: their number is bounded by the alphabet.
        short, lowest = min(order, 1), {}
        shortest = strings.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (BITS * (short + 1))) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        lowest[short] = shortest.column("gram").to_numpy(), shortest.column("n").to_numpy()
        if short:
            last, at = np.unique(lowest[1][0] & ((1 << BITS) - 1), return_inverse=True)
            lowest[0] = last, np.bincount(at, lowest[1][1], len(last))
        shared = spark.sparkContext.broadcast(lowest)

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            """The scores of all strings that blocks ask a shard for."""
            trie = Trie.build({order: (left.column("gram").to_numpy(), left.column("n").to_numpy())} | shared.value, order)
            scores = [planes(trie.score(from_planes(x.as_py(), np.int64)).astype(np.float32)) for x in right.column("data")]
            return pa.Table.from_arrays([right.column("block"), right.column("shard"), pa.array(scores, pa.binary())], names=["block", "shard", "data"])

        dealt = strings.select(F.expr(SHARD_SQL.format(shards=shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "gram", "n")
        asks = asked.where("shard IS NOT NULL").select("shard", (F.col("block") % copies).alias("copy"), "block", "data")
        answers = dealt.groupBy("shard", "copy").cogroup(asks.groupBy("shard", "copy")).applyInArrow(answer, "block int, shard long, data binary")
        known = known.unionByName(answers, allowMissingColumns=True)

    out = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("learn", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.filter(right.column("word").is_valid())
        word, n = told.column("word").to_numpy(), told.column("n").to_numpy()
        order_ = np.argsort(word)
        word, n = word[order_], n[order_]
        batches, parts = left.combine_chunks().to_batches(), []
        if pretrained:
            # The strings are in the order in which they were asked for.
            keys = [distinct(grams(data, offsets, order)[0]) for batch in batches for _, _, data, offsets in text_chunks(batch, "text", GRAM_BYTES)]
            answered = right.filter(right.column("shard").is_valid()).sort_by("shard").column("data")
            own = by_shard(distinct(np.concatenate([np.zeros(0, np.int64), *keys])), shards)[0]
            model_of = Scores(own, np.concatenate([np.zeros(0, np.float32), *(from_planes(x.as_py(), np.float32) for x in answered)]))
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch, "text", GRAM_BYTES):
                found = words(data, offsets, SPACED)
                c = np.zeros(len(found.code))
                if len(word):
                    code = found.code.view(np.int64)
                    at = np.minimum(np.searchsorted(word, code), len(word) - 1)
                    c = np.where(word[at] == code, n[at], 0).astype(np.float64)
                space = np.log10(n_all + 0.5 * (n_distinct + 1))
                sums_of = lambda x: np.diff(np.r_[0, np.cumsum(x)][found.first])  # noqa: B023, E731
                base = sums_of(np.log10(c + 0.5)) + np.log10(learned + 0.5) - (np.diff(found.first) + 1) * space
                if mode == "adaptive":
                    model = np.array([adaptive(data[a:b].tobytes(), order) for a, b in zip(offsets, offsets[1:])])
                else:
                    key, first = grams(data, offsets, order)
                    model = np.add.reduceat(model_of.of(key), first[:-1])
                part = batch.slice(i, j - i)
                parts.append(pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("learn"), pa.array(np.diff(found.first) + 1),
                    pa.array(sums_of(c > 0) + int(learned > 0)), pa.array(np.full(j - i, n_all)), pa.array(base), pa.array(model),
                ], names=out.names))
        return pa.Table.from_batches(parts) if parts else pa.Table.from_batches([], pa.schema([
            (id_col, left.schema.field("id").type), ("learn", pa.bool_()), *((c, pa.int64()) for c in out.names[2:5]),
            *((c, pa.float64()) for c in out.names[5:])]))

    return blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, out)
