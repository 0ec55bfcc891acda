"""Source divergence, phrase collocations and the mix of sources: odd input against SQL, blocks and ranges against one piece."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_fixtures import docs_of, edges, empty  # noqa: F401
from oracle_check import differences
from pyspark.sql import functions as F

from forecast_duel.llm import divergence, phrases
from forecast_duel.llm.divergence import audit, groups_of, joint_tables, kept_terms, term_counts
from forecast_duel.llm.mixing import mix
from forecast_duel.llm.ngram_join import one_of_each
from forecast_duel.llm.phrases import collocations, cut, summed
from forecast_duel.llm.queries import OP11_SQL, OP12_SQL, OP13_SQL
from forecast_duel.llm.secrets import without_secrets


@pytest.fixture(scope="module")
def odd(edges):  # noqa: F811
    """The odd texts in several languages and sources, some of them null, with other columns of clashing names."""
    k = F.coalesce(F.col("doc_id"), F.lit(4))
    table = edges.withColumn("lang", F.when(k % 4 == 0, None).when(k % 4 == 1, "und").when(k % 4 == 2, "").otherwise("EN é"))
    return table.withColumn("source", F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("s"), k % 3))).cache()


@pytest.fixture(scope="module")
def con(odd):
    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text", "lang", "source").toArrow())
    return con


def test_divergence_of_odd_texts(odd, con):
    sql = OP11_SQL.replace("count(*) >= 10", "count(*) >= 3")
    assert differences(audit(odd, least_docs=3), con, sql) == []
    # Small blocks of terms and groups, and slices of few columns, give the same sums.
    assert differences(audit(odd, least_docs=3, terms=16, size=1), con, sql) == []
    assert differences(audit(odd, least_docs=10_000), con, OP11_SQL.replace("count(*) >= 10", "count(*) >= 10000")) == []


def test_joint_tables_count_all_terms(odd, monkeypatch):
    monkeypatch.setattr(divergence, "COLUMNS", 8)
    docs = odd.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_terms(term_counts(docs), 2).cache()
    found = joint_tables(kept, groups_of(docs, kept), terms=20, size=1).collect()
    level, sources = {}, {}
    for r in kept.collect():
        level[r.lang, r.source, r.term] = r.n
        sources.setdefault((r.lang, r.term), set()).add(r.source)
    want = Counter()
    pairs = {(r.lang, r.source, r.other) for r in found}
    for lang, a, b in pairs:
        for (term_lang, term), there in sources.items():
            if term_lang == lang and there & {a, b}:
                want[lang, a, b, level.get((lang, a, term), 0), level.get((lang, b, term), 0)] += 1
    assert {(r.lang, r.source, r.other, r.level, r.other_level): r.n_terms for r in found} == want
    assert len(pairs) > 10


@pytest.mark.parametrize("partitions", [None, 3])
def test_phrases_of_odd_texts(odd, con, partitions, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH", 500)
    monkeypatch.setattr(phrases, "TALLIED", 200)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 700)
    sql = OP12_SQL.replace("count(*) >= 100", "count(*) >= 4")
    assert differences(collocations(odd, least=4, n_partitions=partitions), con, sql) == []


def test_phrases_overlap_tie_and_stay_within_pieces(docs_of):  # noqa: F811
    rows = [(1, "A a a a"), (2, "a\ta  a"), (3, "b c. b c"), (4, "b c,b c\nc"), (5, None), (6, " .,;"), (7, "b c d"), (7, "b c d")]
    found = {r.phrase: (r.a, r.l, r.r, r.n, r.score, r["rank"]) for r in collocations(docs_of(rows), least=2).collect()}
    # "a a" stands in "a a a" five and three times; every cut of "b c d" ties, so the first one counts.
    assert found["a a"] == (5, 7, 7, 22, 1000 * 5 * 22 // 49, 3)
    assert found["a a a"] == (3, 7, 5, 22, 1000 * 3 * 22 // 35, 4)
    assert found["b c"][:4] == (6, 6, 7, 22) and found["b c d"][:4] == (2, 6, 2, 22)
    assert "c b" not in found and "c d" not in found


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(1)
    parts = [np.minimum(rng.zipf(1.3, 4000), 10**6).astype(np.uint64) for _ in range(30)]
    exact = Counter(np.concatenate(parts).tolist())
    least, capacity = 400, 30 * 4000 // 400 + 1
    codes, counts, lowered = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for p in parts:
        codes, counts, lower = cut(*summed(np.r_[codes, p], np.r_[counts, np.ones(len(p), np.int64)]), capacity)
        lowered += lower
    estimate = dict(zip(codes.tolist(), counts.tolist()))
    assert len(codes) <= capacity and lowered < least
    for code, n in exact.items():
        assert estimate.get(code, 0) <= n <= estimate.get(code, 0) + lowered
        assert n < least or code in estimate


def test_mix_of_odd_texts(odd, con):
    assert differences(mix(odd), con, OP13_SQL) == []
    assert differences(mix(odd.repartition(7)), con, OP13_SQL) == []


def test_mix_takes_full_sources_twice_and_shares_the_rest(docs_of):  # noqa: F811
    small = [(i, "w " * 10) for i in range(10)]
    large = [(i, "w " * (1 + i % 7)) for i in range(100, 1100)]
    docs = docs_of(small + large).withColumn("source", F.when(F.col("doc_id") < 100, "a").when(F.col("doc_id") < 900, "b"))
    found = mix(docs).withColumn("source", F.when(F.col("doc_id") < 100, "a").when(F.col("doc_id") < 900, "b")).collect()
    words = sum(r.size for r in found)
    taken, target, largest = Counter(), {}, Counter()
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert taken["a"] == target["a"] == 200
    assert sum(target.values()) == pytest.approx(1.5 * words) and sum(taken.values()) <= 1.5 * words
    for source, n in taken.items():
        assert abs(n - target[source]) <= 3 * largest[source]


def test_empty_tables(empty, docs_of):  # noqa: F811
    assert audit(empty).count() == collocations(empty).count() == mix(empty).count() == 0
    nothing = docs_of([(1, None), (2, ""), (None, " \t")])
    assert audit(nothing).count() == collocations(nothing).count() == 0
    assert [(r.size, r.source_size, r.target, r.taken) for r in mix(nothing).collect()] == [(0, 0, 0.0, 0)] * 3


def test_input_columns_of_working_names_stay(docs_of):  # noqa: F811
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "token = abcdefghijkl12345 x")])
    docs = docs.withColumns({n: F.col("doc_id") * 10 for n in ("_hash", "_spans", "_score")})
    assert {(r.doc_id, r._hash) for r in one_of_each(docs).collect()} == {(1, 10), (3, 30)}
    assert {(r.doc_id, r._spans) for r in without_secrets(docs).collect()} == {(1, 10), (2, 20), (3, 30)}
    assert "[secret]" in without_secrets(docs).where("doc_id = 3").first().text
