"""Phrase collocations: frequent word sequences by mergeable Misra-Gries summaries, then exact counts and scores.

A phrase that occurs ``least`` times survives in any summary of its hash partition whose capacity exceeds the partition's mass
(occurrences) divided by ``least``: merging and cutting summaries lowers a count by at most mass / (capacity + 1) in all.
So the summaries, a few bytes for each hundred occurrences, give a small superset of the frequent phrases, whatever the number
of different phrases is. It is held in a bitmap of fixed size, and a second pass counts exactly what the bitmap lets through.

Phrases of up to two words are summed up first; a longer one can be frequent only if every pair of words in it is, so
its occurrences are left out where the bitmap of the pairs says no. This drops no frequent phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.llm.common import stored, text_chunks
from forecast_duel.llm.sketch import may_hold, members
from forecast_duel.llm.tally import Tally, gather, name_codes, run_starts, salt_of, salted
from forecast_duel.llm.words import LOWER, mixed, words

LEAST, LONGEST, TOP = 100, 5, 2000
NO_LANGUAGE = "und"
#: Bytes that part a text into pieces, and those that stand between words.
_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_SPLIT
_INSIDE[[9, 32]] = False
#: Occurrences that a task sums up at once, rows of its exact counts, bytes of text for each hash partition, bytes of text at once.
FLUSH, TALLIED, PARTITION_MASS, CHUNK_BYTES = 1 << 20, 1 << 19, 1 << 23, 1 << 18
#: Capacity of a summary as a multiple of mass / ``least``: counts are then lowered by at most an eighth of ``least``.
ROOM = 8
SUMMARY = "partition int, mass long, codes binary, counts binary"


class Sequences:
    """The word sequences in the texts of a chunk: for each length, the first words of all that stay within a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray):
        found = words(data, offsets, _INSIDE)
        self.data, self.start, self.end = LOWER[data], found.start, found.end
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
        splits = np.cumsum(_SPLIT[data], dtype=np.int64)
        # A number that is equal for words of the same piece, and for no others next to them.
        self.piece = splits[found.start] + self.text if len(found.start) else np.zeros(0, np.int64)
        self.joined = np.zeros(0, bool)
        if len(found.start) > 1:
            self.joined = (self.piece[1:] == self.piece[:-1]) & (self.text[1:] == self.text[:-1])
        self.code = salted(found.code, salt[self.text])
        self.salt = salt

    def of_length(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, numbers of the first words, codes), from one word to ``longest``."""
        at, code = np.arange(len(self.code)), self.code
        for n in range(1, longest + 1):
            if n > 1:
                more = at + n - 1 < len(self.code)
                more[more] = self.joined[at[more] + n - 2]
                at, code = at[more], code[more]
                code = mixed(code * np.uint64(3) + self.code[at + n - 1])
            yield n, at, code

    def longer(self, longest: int, pairs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The same from three words on, where all pairs of neighbours may be in the bitmap."""
        good = np.zeros(max(len(self.code) - 1, 0), bool)
        for n, at, code in self.of_length(longest):
            if n == 2:
                good[at] = may_hold(pairs, code)
            elif n > 2:
                run = np.ones(len(at), bool)
                for j in range(n - 1):
                    run &= good[at + j]
                yield n, at[run], code[run]

    def phrases(self, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the sequences with one space between words, and where each begins."""
        word = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
        size = self.end[word] - self.start[word] + 1
        data, to = gather(np.append(self.data, np.uint8(32)), self.start[word], size)
        data[to[1:] - 1] = 32
        begins = np.r_[0, np.cumsum(np.add.reduceat(size, np.r_[0, np.cumsum(length)[:-1]]))] if len(length) else np.zeros(1, np.int64)
        keep = np.ones(len(data), bool)
        keep[begins[1:] - 1] = False
        return data[keep], begins - np.arange(len(begins))


def chunks(batch: pa.RecordBatch, salts: dict) -> Iterator[tuple[Sequences, np.ndarray, list[str]]]:
    """(sequences, language number of each text, languages) over a batch of (lang, text)."""
    index, names = name_codes(batch.column("lang"))
    names = [NO_LANGUAGE if n is None else n for n in names]
    salt = np.array([salts.setdefault(n, salt_of(n)) for n in names], np.uint64)
    for i, j, data, offsets in text_chunks(batch, "text", CHUNK_BYTES):
        yield Sequences(data, offsets, salt[index[i:j]]), index[i:j], names


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = run_starts(codes)
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def cut(codes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most ``capacity`` codes: all counts are lowered by the largest one that must go, which is returned."""
    if len(codes) <= capacity:
        return codes, counts, 0
    lower = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > lower
    return codes[keep], counts[keep] - lower, lower


def summaries(docs: DataFrame, found: Callable[[Sequences], Iterator], n_partitions: int) -> DataFrame:
    """Exact summaries (partition, mass, codes, counts) of what each task meets, in parts of ``FLUSH`` occurrences."""
    def run(batches):
        salts, held, size = {}, [], 0

        def rows():
            codes, counts = summed(np.concatenate(held), np.ones(size, np.int64)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            part = (codes % np.uint64(n_partitions)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = run_starts(part[order])
            ends = [*first[1:], len(order)]
            mine = [order[i:j] for i, j in zip(first, ends)]
            return pa.RecordBatch.from_pydict({
                "partition": pa.array(part[order[first]], pa.int32()), "mass": pa.array([int(counts[m].sum()) for m in mine], pa.int64()),
                "codes": pa.array([codes[m].tobytes() for m in mine], pa.binary()),
                "counts": pa.array([counts[m].astype(np.uint32).tobytes() for m in mine], pa.binary())})

        for batch in batches:
            for sequences, _, _ in chunks(batch, salts):
                for _, _, codes in found(sequences):
                    held.append(codes)
                    size += len(codes)
                if size >= FLUSH:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    return docs.mapInArrow(run, SUMMARY)


def survivors(parts: DataFrame, least: int) -> DataFrame:
    """(code) of every sequence that may occur ``least`` times: its count in the merged summary of its hash partition and all that
    this summary was lowered by reach that far."""
    def run(table: pa.Table) -> pa.Table:
        capacity = ROOM * sum(table.column("mass").to_pylist()) // least + 1
        # Parts are taken up together until they hold twice as many codes as the summary may, and then cut.
        codes, counts, size, lowered = [], [], 0, 0

        def merged():
            return cut(*summed(np.concatenate(codes), np.concatenate(counts)), capacity)

        for c, n in zip(table.column("codes"), table.column("counts")):
            codes.append(np.frombuffer(c.as_py(), np.uint64))
            counts.append(np.frombuffer(n.as_py(), np.uint32).astype(np.int64))
            size += len(codes[-1])
            if size > 2 * capacity + FLUSH // 4:
                a, b, lower = merged()
                codes, counts, size, lowered = [a], [b], len(a), lowered + lower
        a, b, lower = merged()
        return pa.Table.from_pydict({"code": pa.array(a[b + lowered + lower >= least].view(np.int64))})

    return parts.groupBy("partition").applyInArrow(run, "code long")


def packed(part: tuple, names: list[str], n_partitions: int) -> pa.RecordBatch:
    """A task's counts as one row for each hash partition and language."""
    group, code, (n,), data, offsets = part
    to = (code % np.uint64(n_partitions)).astype(np.int64)
    order = np.lexsort((group, to))
    group, code, n, to = group[order], code[order], n[order], to[order]
    data, offsets = gather(data, offsets[order], np.diff(offsets)[order])
    first = run_starts(to, group)
    ends = np.r_[first[1:], len(order)]
    return pa.RecordBatch.from_pydict({
        "partition": pa.array(to[first], pa.int32()), "lang": pa.array([names[g] for g in group[first]], pa.string()),
        "codes": pa.array([code[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()),
        "counts": pa.array([n[i:j].astype(np.int64).tobytes() for i, j in zip(first, ends)], pa.binary()),
        "sizes": pa.array([np.diff(offsets[i : j + 1]).astype(np.int32).tobytes() for i, j in zip(first, ends)], pa.binary()),
        "phrases": pa.array([data[offsets[i] : offsets[j]].tobytes() for i, j in zip(first, ends)], pa.binary())})


def exact_counts(docs: DataFrame, bits: np.ndarray, longest: int, least: int, n_partitions: int) -> DataFrame:
    """(lang, phrase, n): exact counts, from ``least`` on, of the sequences the bitmap lets through; a null phrase counts all words.

    A task sends its counts packed by hash partition, as the summaries are; words of a language are a row of partition -1.
    """
    def run(batches):
        salts, names, tally, total = {}, {}, Tally(1), {}
        for batch in batches:
            for sequences, lang, languages in chunks(batch, salts):
                number = np.array([names.setdefault(x, len(names)) for x in languages], np.int64)[lang]
                per_text = np.bincount(sequences.text, minlength=len(lang))
                for k in np.unique(lang):
                    total[languages[k]] = total.get(languages[k], 0) + int(per_text[lang == k].sum())
                first, code, length = [], [], []
                for n, at, codes in sequences.of_length(longest):
                    kept = may_hold(bits, codes)
                    first.append(at[kept])
                    code.append(codes[kept])
                    length.append(np.full(len(first[-1]), n))
                first, code, length = (np.concatenate(x) for x in (first, code, length))
                order = np.argsort(code, kind="stable")
                begins = run_starts(code[order])
                if not len(begins):
                    continue
                chosen = order[begins]
                counts = np.diff(np.r_[begins, len(order)])
                tally.add(number[sequences.text[first[chosen]]], code[chosen], [counts], *sequences.phrases(first[chosen], length[chosen]))
                if tally.rows > TALLIED:
                    tally.merge()
                    if tally.rows > TALLIED // 2:
                        yield packed(tally.take_part(), list(names), n_partitions)
        part = tally.take_part()
        if part is not None:
            yield packed(part, list(names), n_partitions)
        if total:
            none = pa.array([b""] * len(total), pa.binary())
            yield pa.RecordBatch.from_pydict({
                "partition": pa.array([-1] * len(total), pa.int32()), "lang": pa.array(list(total), pa.string()), "codes": none,
                "counts": pa.array([np.int64(n).tobytes() for n in total.values()], pa.binary()), "sizes": none, "phrases": none})

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, words_seen = Tally(1), 0
        for batch in batches:
            for codes, counts, sizes, phrases in zip(*(batch.column(c) for c in ("codes", "counts", "sizes", "phrases"))):
                code, n = np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)
                if key[0].as_py() < 0:
                    words_seen += int(n.sum())
                    continue
                size = np.frombuffer(sizes.as_py(), np.int32).astype(np.int64)
                tally.add(np.zeros(len(code), np.int64), code, [n], np.frombuffer(phrases.as_py(), np.uint8), np.r_[0, np.cumsum(size)])
                if tally.rows > TALLIED:
                    tally.merge()
        taken = tally.take()
        if taken is None:
            texts, n = pa.nulls(1, pa.string()), np.array([words_seen], np.int64)
        else:
            _, (n,), texts = taken
            keep = n >= least
            texts, n = texts.filter(pa.array(keep)), n[keep]
        yield pa.RecordBatch.from_pydict({"lang": pa.repeat(key[1], len(n)), "phrase": texts, "n": pa.array(n, pa.int64())})

    parts = docs.mapInArrow(run, "partition int, lang string, codes binary, counts binary, sizes binary, phrases binary")
    return parts.groupBy("partition", "lang").applyInArrow(add_up, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, n_partitions: int | None = None) -> DataFrame:
    """(lang, phrase, n) of every sequence of 1 to ``longest`` words with ``least`` occurrences or more, and, with a null phrase, the words of each language.

    ``docs`` has lang and text.
    """
    docs = docs.select("lang", "text")
    few = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    if n_partitions is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n_partitions = max(int(few), size // PARTITION_MASS + 1)
    short = stored(survivors(summaries(docs, lambda s: s.of_length(2), n_partitions), least), "survivors")
    pairs = members(short, "code")
    long = stored(survivors(summaries(docs, lambda s: s.longer(longest, pairs), n_partitions), least), "survivors")
    bits = pairs | members(long, "code")
    return exact_counts(docs, bits, longest, least, n_partitions)


def whole(c: str | Column, digits: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP,
                 lang_col: str = "lang", text_col: str = "text", n_partitions: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the collocations of each language, best first.

    Only A-Z are lower-cased; a text is parted at ``.,;:!?`` and line breaks, words stand between spaces and tabs; null is an empty text, a null
    language is ``und``. A phrase of 2 to ``longest`` words with a >= ``least`` occurrences (overlapping ones count) is cut after each
    of its words but the last; the cut with the smallest score floor(1000 a n / (l r)) counts, the earliest of equals. A
    phrase inside a longer one with as many occurrences is left out. Ties of score go to the larger a, then to the smaller phrase by bytes.
    Repeated rows count as often as they stand there; an empty table gives no row; other columns are not read.

    Sequences are told apart by 64-bit codes within a task and as texts beyond it.
    """
    docs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = stored(frequent_phrases(docs, least, longest, n_partitions), "phrases")
    totals = counts.where("phrase IS NULL").select("lang", F.col("n").alias("words"))
    known = counts.where("phrase IS NOT NULL").withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")
    split = known.select("lang", "phrase", "a", parts.alias("parts")).where(F.size("parts") > 1)

    def piece(begin, size):
        return F.array_join(F.slice("parts", begin, size), " ")

    cuts = split.select("lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.size("parts") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    # Counts have up to 16 digits here, so all products stay within 38; the floor fits a long, as it is at most 1000 n / a.
    score = F.expr("(CAST(a * 1000 AS DECIMAL(19,0)) * CAST(words AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    best = cuts.select("lang", "phrase", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r", "words").alias("cut"))
    best = best.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # If a longer phrase has as many occurrences, so has one that is longer by one word.
    shorter = split.select(
        "lang", "a", F.explode(F.array(piece(F.lit(1), F.size("parts") - 1), piece(F.lit(2), F.size("parts") - 1))).alias("phrase"))
    best = best.join(shorter.distinct(), ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("cut.words").alias("n"), F.col("cut.score").alias("score"))
