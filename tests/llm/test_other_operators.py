"""Neighbours, revisits, components, the pipeline and the SQL of the registered queries."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from llm_fixtures import TESTDATA, docs_of, edges, empty  # noqa: F401
from oracle_check import differences
from pyspark.sql import functions as F

import corpus_pipeline
from forecast_duel.llm import neighbours as nearest
from forecast_duel.llm.components import components
from forecast_duel.llm.neighbours import chi_square_below, neighbours, stop_ratio
from forecast_duel.llm.queries import llm_oracle_sql, llm_queries
from forecast_duel.llm.revisits import canonical_url, resolve

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert differences(llm_queries()[name](spark, FOLDER), con, llm_oracle_sql()[name]) == []


def test_there_is_a_query_for_every_operator():
    assert {name.split("_")[0] for name in llm_queries()} == {f"op{n}" for n in range(1, 14)}


def brute_nearest(rows, k):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        vectors[i] = min(vectors.get(i, v), v)
    width = max(map(len, vectors.values()))
    full = {i: np.r_[np.array(v, np.float32).astype(float), np.zeros(width - len(v))] for i, v in vectors.items()}
    out = {}
    for q in (i for i in full if i % 20 == 0):
        out[q] = sorted(((-float(full[q] @ v), i) for i, v in full.items() if i != q))[:k]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 6), (140, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (160, [float("nan")] * 6), (180, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (200, [2.0, 1.0]), (61, rows[3][1]), (62, rows[3][1]), (63, [-x for x in rows[4][1]]), (20, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    found = {}
    for r in neighbours(df, "vec_id % 20 = 0", k=5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = brute_nearest(rows, 5)
    assert found.keys() == want.keys()
    for q, pairs in want.items():
        assert [i for _, i in found[q]] == [i for _, i in pairs]
        assert [s for s, _ in found[q]] == pytest.approx([s for s, _ in pairs], abs=1e-12)
    few = neighbours(df.where("vec_id IN (0, 1, 2)"), "vec_id % 20 = 0", k=5).collect()
    assert [r.rank for r in few] == [1, 2]
    assert neighbours(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_recall_over_many_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.7 * rng.normal(size=16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours(df, "vec_id % 20 = 0", k=10, cell_rows=200).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, 10)
    hits = sum(len(found[q] & {i for _, i in pairs}) for q, pairs in want.items())
    assert hits / (10 * len(want)) >= 0.9


def test_no_group_of_a_search_is_large(spark, monkeypatch):
    class Bounded(nearest.Cell):
        def __init__(self, ids, vectors, projected):
            assert len(ids) <= 200, f"a cell of {len(ids)} rows"
            super().__init__(ids, vectors, projected)

    monkeypatch.setattr(nearest, "Cell", Bounded)
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 16)  # cells of very different sizes
    monkeypatch.setattr(nearest, "CELL_SAMPLE", 1)
    rng = np.random.default_rng(5)
    same = rng.normal(size=16).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(1800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in neighbours(df, "vec_id % 20 = 0 OR vec_id % 3 = 0", k=10, cell_rows=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found.keys() == {i for i in range(1800) if i % 20 == 0 or i % 3 == 0}
    for q in range(0, 1800, 3):
        assert found[q] == [i for i in range(0, 36, 3) if i != q][:10]
    want = brute_nearest(rows, 10)
    odd = [q for q in want if q % 3]
    assert sum(len(set(found[q]) & {i for _, i in want[q]}) for q in odd) / (10 * len(odd)) >= 0.9


def test_chi_square():
    assert float(chi_square_below(np.array(15.50731), 8)) == pytest.approx(0.95, abs=1e-6)
    assert stop_ratio(0.05, 8) == pytest.approx(15.50731, abs=1e-4)


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: root(n) for e in edges for n in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


RECORD = "record_id long, url string, ts long, status int, etag string, last_modified long, headers map<string,string>, payload string, slice int, page string"


def revisit(spark, *rows):
    names = ("record_id", "url", "ts", "status", "etag", "last_modified", "headers", "payload")
    data = [tuple(dict(zip(names, (i, "http://a.org/x", i, 200, None, None, None, f"p{i}"))) | row for i, row in [(r["record_id"], r)]) for r in rows]
    df = spark.createDataFrame([tuple(d[0][n] for n in names) + (1, "clash") for d in data], RECORD)
    return {r.record_id: r for r in resolve(df, slices=4).collect()}


def test_revisits_take_the_latest_earlier_response(spark):
    found = revisit(
        spark,
        {"record_id": 1, "etag": '"a"', "headers": {"content-type": "text/html", "age": "1", "etag": '"a"'}},
        {"record_id": 2, "url": "https://www.A.org:443/x/?utm_source=1#top", "status": 304, "etag": 'W/"a"', "headers": {"age": "9", "content-type": "x"}, "payload": None},
        {"record_id": 3, "etag": '"b"', "last_modified": 5},
        {"record_id": 4, "status": 304, "etag": '"a"'}, {"record_id": 5, "status": 304, "last_modified": 5}, {"record_id": 6, "status": 304, "last_modified": 6},
        {"record_id": 7, "status": 304}, {"record_id": 8, "status": 304, "url": "http://a.org/y"}, {"record_id": 9, "status": 304, "url": None},
        {"record_id": 10, "status": 304, "ts": None}, {"record_id": 11, "status": 404}, {"record_id": 12, "ts": 2, "payload": "same time, larger id"})
    assert {i: (r.outcome, r.response_id) for i, r in found.items()} == {
        2: ("resolved", 1), 4: ("mismatch", None), 5: ("resolved", 3), 6: ("mismatch", None), 7: ("unchecked", 3), 8: ("no_response", None),
        9: ("no_response", None), 10: ("no_response", None)}
    assert found[2].headers == {"content-type": "text/html", "age": "9", "etag": '"a"'} and found[2].payload == "p1"
    assert found[7].headers == {} and found[4].payload is None


def test_header_names_are_folded_and_those_of_a_connection_dropped(spark):
    found = revisit(
        spark,
        {"record_id": 1, "headers": {"Content-Length": "10", "ETag": "a", "X-Trace": "1", "Keep-Alive": "5"}},
        {"record_id": 2, "status": 304, "headers": {"content-LENGTH": "0", "Connection": "close, X-Hop", "X-Hop": "1", "etag": "b", "ETAG": "c"}},
        {"record_id": 3, "url": "http://a.org:443/x", "status": 304})
    assert found[2].headers == {"content-length": "10", "etag": "c", "x-trace": "1"}
    assert found[3].outcome == "no_response"  # 443 is no default of http


def test_revisits_of_one_hot_page(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("record_id"), F.lit("http://hot.org/").alias("url"), (F.col("id") % 1000).alias("ts"),
        F.when(F.col("id") % 37 == 0, 200).otherwise(304).alias("status"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("long").alias("last_modified"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit("p").alias("payload"))
    order = sorted((i % 1000, i) for i in range(4000))
    want, last = {}, None
    for _, i in order:
        if i % 37 == 0:
            last = i
        else:
            want[i] = last
    assert {r.record_id: r.response_id for r in resolve(rows).collect()} == want
    assert resolve(rows.limit(0)).count() == 0


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Ex.org:80/A/b/?b=2&utm_x=1&a=1#f": "ex.org/A/b?a=1&b=2", "https://ex.org": "ex.org", "https://ex.org?ref=1": "ex.org", None: None}
    df = spark.createDataFrame([(u, v) for u, v in urls.items()], "u string, v string")
    assert all(r.c == r.v for r in df.select("v", canonical_url(F.col("u")).alias("c")).collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    before, ids = docs, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, FOLDER), name)
        assert after.schema == docs.schema
        kept = {r.doc_id for r in after.collect()}
        assert kept <= {r.doc_id for r in before.collect()} and after.count() == len(kept)
        before, ids = after, kept
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r.doc_id for r in packed.collect()} == ids
    assert packed.count() == corpus_pipeline.run(spark, FOLDER).count()


def test_pipeline_takes_nulls_and_empty_tables(spark, docs_of, edges, empty):
    plain = [edges.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")]
    for docs in plain:
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        docs.collect()


def test_the_stopping_test_spares_most_vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    directions = rng.standard_normal((64, nearest.DIMENSIONS))
    cell = nearest.Cell(np.arange(len(x)), x, x @ directions)
    ratio, hits = nearest.stop_ratio(nearest.MISS), 0
    for i in range(0, 6000, 120):
        scores = x @ x[i]
        scores[i] = -np.inf
        found, got = cell.nearest(i, x[i], x[i] @ directions, 20, ratio, 1.0, -np.inf)
        assert np.allclose(got, scores[found]) and i not in found
        hits += len(set(found.tolist()) & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.95 * 20 * 50 and cell.verified <= 0.7 * 6000 * 50
