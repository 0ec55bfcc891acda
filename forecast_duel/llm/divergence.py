"""Divergence of the sources of a language from one another and from the whole, by products of one-hot level matrices.

How often a term occurs in a (language, source) group is the term's level there, and the price of a term for two groups depends on
nothing but its two levels. A matrix with a row for each term and a column for each (group, level), one where the group has
the term at that level, multiplied by its own transpose holds for every two groups the number of terms at each pair of levels: their joint table.
The product is taken in blocks of terms and of groups: dense within a block, whole numbers throughout. Every cell is priced once
with its number of terms, so the sum over the cells is the sum over all terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecast_duel.llm.common import stored, text_chunks
from forecast_duel.llm.tally import Tally, gather, name_codes, run_starts
from forecast_duel.llm.words import ALPHANUMERIC, LOWER, words

#: Words of letters: ASCII letters and everything outside ASCII.
LETTERS = ALPHANUMERIC.copy()
LETTERS[ord("0") : ord("9") + 1] = False
LETTERS[ord("A") : ord("Z") + 1] = True
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a block, groups of a block on either side, columns of a dense product, and rows a task counts before they leave it.
TERMS, GROUPS, COLUMNS, TALLIED = 2048, 128, 1024, 1 << 19


def per_document(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words in order of document and code, where each different word of a document begins)."""
    order = np.lexsort((code, doc))
    return order, run_starts(doc[order], code[order])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that have it."""
    def run(batches):
        tally, numbers = Tally(2), {}

        def rows():
            taken = tally.take()
            if taken is None:
                return
            group, (n, d), texts = taken
            names = list(numbers)
            lang, source = (
                pa.DictionaryArray.from_arrays(pa.array(group, pa.int32()), pa.array([x[i] for x in names], pa.string())).cast(pa.string())
                for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"lang": lang, "source": source, "term": texts, "n": pa.array(n), "docs": pa.array(d)})

        for batch in batches:
            lang, langs = name_codes(batch.column("lang"))
            source, sources = name_codes(batch.column("source"))
            pairs, inverse = np.unique(lang * len(sources) + source, return_inverse=True)
            known = np.array([
                numbers.setdefault((langs[p // len(sources)], sources[p % len(sources)]), len(numbers)) for p in pairs.tolist()], np.int64)
            group_of_row = known[inverse]
            for i, _, data, offsets in text_chunks(batch, "text"):
                found = words(data, offsets, LETTERS)
                if not len(found.code):
                    continue
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
                order, begins = per_document(doc, found.code)
                n = np.diff(np.r_[begins, len(order)])
                seen = order[begins]
                group, code = group_of_row[i + doc[seen]], found.code[seen]
                again = np.lexsort((group, code))
                starts = run_starts(code[again], group[again])
                chosen = seen[again[starts]]
                counters = [np.add.reduceat(n[again], starts), np.diff(np.r_[starts, len(again)])]
                tally.add(group[again[starts]], code[again[starts]], counters, *gather(LOWER[data], found.start[chosen], found.end[chosen] - found.start[chosen]))
                if tally.rows > TALLIED:
                    tally.merge()
                    if tally.rows > TALLIED // 2:
                        yield from rows()
        yield from rows()

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # The rows are summed up in the tasks already; one shuffle by term serves the sums and the windows that follow.
    return found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, source, n, whole): counts of the terms that enough documents of their language have; ``whole`` is the language's count."""
    of_term = Window.partitionBy("lang", "term")
    return (
        counts.select("*", F.sum("docs").over(of_term).alias("lang_docs"), F.sum("n").over(of_term).alias("whole"))
        .where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "whole"))


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, vocabulary, lang_total) of every group that occurs, with terms or without."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A language's terms are counted in the row of one of their groups.
    first = kept.groupBy("lang", "term").agg(F.min("whole").alias("whole"))
    langs = first.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("whole").alias("lang_total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.fillna(0, ["total", "vocabulary", "lang_total"])


def level_price(count: str, total: str) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 vocabulary)), exact for any long."""
    above = f"CAST({count} + 2 AS DECIMAL(19,0)) * CAST({SCALE} AS DECIMAL(12,0))"
    return F.expr(f"1 + ({above}) div (CAST({total} AS DECIMAL(20,0)) + CAST(2 * vocabulary AS DECIMAL(20,0)))")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)): prices are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def blocks(kept: DataFrame, groups: DataFrame, terms: int, size: int) -> DataFrame:
    """Rows of every (lang, block of terms, block of groups, block of groups): the counts of its terms, and, without a term, its groups.

    Both blocks follow from hashes. A count is copied for each block of groups that its own one meets.
    """
    langs = groups.groupBy("lang").agg(
        F.ceil(F.max("vocabulary") / F.lit(terms)).alias("n_terms"), F.ceil(F.count("*") / F.lit(size)).alias("n_groups"))
    langs = stored(langs.select("lang", F.greatest("n_terms", F.lit(1)).alias("n_terms"), "n_groups"), "blocks")
    own = F.pmod(F.xxhash64("source"), F.col("n_groups"))
    counts = kept.select("lang", "term", "source", "n", F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("vocabulary"))
    counts = counts.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_terms")))
    heads = groups.join(langs, "lang").select(
        "lang", F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("long").alias("n"), "total", "vocabulary", "n_terms", "n_groups",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_terms") - 1)).alias("block"))
    dealt = counts.unionByName(heads).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_groups") - 1)))
    return dealt.select(
        "lang", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "term", "source", "n", "total", "vocabulary")


class Block:
    """Counts of a block's terms in its groups as a dense matrix, and the joint tables of every two of its groups."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        head = pc.is_null(table.column("term"))
        heads = table.filter(head).sort_by("source").to_pydict()
        body = table.filter(pc.invert(head))
        self.sources, self.total, self.vocabulary = heads["source"], heads["total"], heads["vocabulary"]
        own = np.array(heads["own"], np.int64)
        # Pairs of one block are taken once; pairs of two blocks have one group on either side.
        place = np.arange(len(own))
        self.wanted = place[:, None] < place[None, :] if i == j else (own[:, None] == i) & (own[None, :] == j)
        term = body.column("term").combine_chunks().dictionary_encode()
        group = pc.index_in(body.column("source").combine_chunks(), pa.array(self.sources, pa.string())).to_numpy(zero_copy_only=False)
        counts = np.zeros((len(term.dictionary), len(own)), np.int64)
        counts[term.indices.to_numpy(zero_copy_only=False), group.astype(np.int64)] = body.column("n").to_numpy()
        # Terms of similar totals have few different levels.
        self.counts = counts[np.argsort(counts.sum(axis=1), kind="stable")]

    def products(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(group, other group, level, other level, number of terms) of the cells that are not empty, slice by slice."""
        begin, rows, (n, wide) = 0, len(self.counts), self.counts.shape
        while begin < n:
            rows = min(rows, n - begin)
            while True:
                part = self.counts[begin : begin + rows]
                levels, at = np.unique(part, return_inverse=True)
                columns, where = np.unique(np.arange(wide)[None, :] * len(levels) + at.reshape(part.shape), return_inverse=True)
                if len(columns) <= max(COLUMNS, wide) or rows == 1:
                    break
                rows = max(1, rows // 2)
            # Zeros and ones, and sums of at most as many as rows: exact in single precision.
            hot = np.zeros((rows, len(columns)), np.float32)
            hot[np.arange(rows)[:, None], where.reshape(part.shape)] = 1
            joint = hot.T @ hot
            of, level = columns // len(levels), levels[columns % len(levels)]
            a, b = np.nonzero(joint)
            pair = self.wanted[of[a], of[b]]
            a, b = a[pair], b[pair]
            yield of[a], of[b], level[a], level[b], joint[a, b].astype(np.int64)
            begin += rows
            rows *= 2

    def price(self, group: np.ndarray, level: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(np.stack([group, level]), axis=1, return_inverse=True)
        prices = [1 + SCALE * (int(c) + 2) // (self.total[g] + 2 * self.vocabulary[g]) for g, c in keys.T.tolist()]
        return np.array(prices, np.int64)[inverse.ravel()]

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups, other groups and the summed price of all terms of the block for every pair."""
        total = np.zeros(self.wanted.shape, np.int64)
        for g, h, a, b, n in self.products():
            p, q = self.price(g, a), self.price(h, b)
            np.add.at(total, (g, h), n * ((p - q) ** 2 // (p + q)))
        g, h = np.nonzero(self.wanted)
        return g, h, total[g, h]


def joint_tables(kept: DataFrame, groups: DataFrame, terms: int = TERMS, size: int = GROUPS) -> DataFrame:
    """(lang, source, other, level, other_level, n_terms): the joint table of every two groups of a language, each pair once.

    Terms that neither group has are not listed.
    """
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, out = Block(table), []
        names = pa.array(block.sources, pa.string())
        for g, h, a, b, n in block.products():
            seen = (a > 0) | (b > 0)
            out.append(pa.Table.from_pydict({
                "lang": pa.repeat(key[0], int(seen.sum())), "source": names.take(pa.array(g[seen])), "other": names.take(pa.array(h[seen])),
                "level": pa.array(a[seen]), "other_level": pa.array(b[seen]), "n_terms": pa.array(n[seen])}))
        return pa.concat_tables(out) if out else pa.schema(
            [("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("level", pa.int64()), ("other_level", pa.int64()), ("n_terms", pa.int64())]).empty_table()

    found = blocks(kept, groups, terms, size).groupBy("lang", "block", "i", "j").applyInArrow(
        run, "lang string, source string, other string, level long, other_level long, n_terms long")
    return found.groupBy("lang", "source", "other", "level", "other_level").agg(F.sum("n_terms").alias("n_terms"))


def pair_values(kept: DataFrame, groups: DataFrame, terms: int = TERMS, size: int = GROUPS) -> DataFrame:
    """(lang, source, item, value) for every source and every other one of its language."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table)
        g, h, value = block.values()
        names = pa.array(block.sources, pa.string())
        return pa.Table.from_pydict({
            "lang": pa.repeat(key[0], len(g)), "source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "value": pa.array(value),
            "seen": pa.repeat(pa.scalar(len(block.counts), pa.int64()), len(g))})

    found = blocks(kept, groups, terms, size).groupBy("lang", "block", "i", "j").applyInArrow(
        run, "lang string, source string, item string, value long, seen long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Terms that neither has all cost the same.
    zero = groups.where("vocabulary > 0").withColumn("none", level_price("0", "total")).select("lang", "source", "vocabulary", "none")
    found = found.join(zero, ["lang", "source"], "left").join(
        zero.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none")), ["lang", "item"], "left")
    rest = F.coalesce((F.col("vocabulary") - F.col("seen")) * gap("none", "item_none"), F.lit(0))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
    return found.select("lang", both, (F.col("value") + rest).alias("value")).select("lang", "pair.source", "pair.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text", terms: int = TERMS, size: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms from the whole.

    Null language, source and text count as empty. Terms are runs of letters (all characters outside ASCII are letters), A-Z lower-cased, that
    ``least_docs`` documents of the language have; repeated rows are documents of their own. Part ``pair`` has a row for each other source of
    the language, 0 if the language has no term; part ``term`` the ``top`` terms that the group has and at a higher price than
    the whole language. Ranks are by value, the largest first, ties by the item's bytes. An empty table gives no row; other columns are not read.
    Terms are told apart by 64-bit codes within a task and as texts beyond it.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = stored(kept_terms(term_counts(docs), least_docs), "terms")
    groups = stored(groups_of(docs, kept), "groups")
    pairs = pair_values(kept, groups, terms, size).withColumn("part", F.lit("pair"))
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), level_price("n", "total").alias("p"), level_price("whole", "lang_total").alias("q"))
    own = priced.where("p > q").select("lang", "source", "item", gap("p", "q").alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(own).select("lang", "source", "part", "item", "value", "rank")
