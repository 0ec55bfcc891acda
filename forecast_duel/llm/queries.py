"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecast_duel.llm import secrets
from forecast_duel.llm.common import fold
from forecast_duel.llm.decontamination import build_index, contamination, search
from forecast_duel.llm.divergence import audit
from forecast_duel.llm.language import fit_language, identify
from forecast_duel.llm.mixing import mix
from forecast_duel.llm.neighbours import neighbours
from forecast_duel.llm.ngram_join import near_duplicates
from forecast_duel.llm.packing import pack
from forecast_duel.llm.phrases import collocations
from forecast_duel.llm.ppm import score_documents
from forecast_duel.llm.quality import THRESHOLD, fit_quality, score_quality
from forecast_duel.llm.repeats import removed
from forecast_duel.llm.revisits import crawl_of, resolve
from forecast_duel.llm.secrets import base_spans, scan, spans_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "family")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
    FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT u, v FROM pairs JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
    WHERE 100 * shared >= 75 * (nu.n + nv.n - shared)),
reach AS (
    WITH RECURSIVE r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, links.v FROM r JOIN links ON links.u = r.v)
    SELECT * FROM r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(v) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.u = d.doc_id
GROUP BY ALL
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 1)
    scored = score_documents(docs, "NOT held_out")
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return removed(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl_of(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(entries, ";"))


OP6_SQL = r"""
WITH base AS (SELECT page_id, url, md5(html) AS digest, page_id % 7 AS m FROM pages),
records AS (
    SELECT page_id * 8 AS record_id, url, page_id * 10 AS ts, 200 AS status, '"' || digest || '"' AS etag, page_id AS modified,
        'text/html' AS kind, '0' AS age, digest AS payload FROM base
    UNION ALL SELECT page_id * 8 + 1, url, page_id * 10 + 1 + page_id % 1000, 304,
        CASE WHEN m = 0 THEN '"other"' WHEN m = 1 THEN 'W/"' || digest || '"' WHEN m < 4 THEN NULL ELSE '"' || digest || '"' END,
        CASE WHEN m = 2 THEN page_id END, 'text/plain', '1', NULL FROM base
    UNION ALL SELECT page_id * 8 + 2, url, page_id * 10 + 500, 200, '"' || md5(digest) || '"', page_id + 1, 'text/html', '2', md5(digest)
        FROM base WHERE page_id % 3 = 0
    UNION ALL SELECT page_id * 8 + 3, url, page_id * 10 + 900, 304, '"' || md5(digest) || '"', NULL, 'text/html', '3', NULL
        FROM base WHERE page_id % 3 = 0
    UNION ALL SELECT page_id * 8 + 4, url, page_id * 10 - 3, 304, '"' || digest || '"', NULL, 'text/html', '4', NULL
        FROM base WHERE page_id % 5 = 0),
parts AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)),
            '^(http://.*):80$|^(https://.*):443$', '\1\2'), '^[a-z]+://(www\.)?', '') AS host,
        regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)='))) AS kept
    FROM records),
named AS (
    SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS page FROM parts),
found AS (
    SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'etag': etag, 'modified': modified, 'kind': kind, 'payload': payload} END IGNORE NULLS)
        OVER (PARTITION BY page ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f
    FROM named),
judged AS (
    SELECT *, CASE WHEN f IS NULL THEN 'no_response'
        WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
        WHEN modified IS NOT NULL THEN CASE WHEN modified = f.modified THEN 'resolved' ELSE 'mismatch' END
        ELSE 'unchecked' END AS outcome
    FROM found WHERE status = 304)
SELECT record_id, page AS canonical_url, outcome,
    CASE WHEN outcome IN ('resolved', 'unchecked') THEN f.id END AS response_id,
    CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'age=' || age || ';content-type=' || f.kind || ';etag=' || coalesce(etag, f.etag) END AS headers,
    CASE WHEN outcome IN ('resolved', 'unchecked') THEN f.payload END AS payload
FROM judged
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "documents"))
    found = contamination(search(index, table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS size,
        array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size)),
hits AS (SELECT doc_id, item_id, i, size FROM places JOIN windows USING (size, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(spans_text(base_spans(F.col("spans"))), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _located(pattern: str) -> str:
    """SQL for doc_id, start and hit of every match of a pattern."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, hits[i] AS hit,
        coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0) AS start
    FROM (SELECT doc_id, gaps, hits, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits FROM d))"""


def op8_sql() -> str:
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", letters)
    value = assign.replace("'", "''")
    allowed = "|".join(f"(?:{p})" for p in secrets.ALLOWED)
    most = [(pattern, int((log2(secrets.WINDOW) - bits) * secrets.WINDOW * 1e6)) for _, pattern, bits in secrets.CLASSES]
    of_class = " ".join(f"WHEN regexp_matches(hit, '{pattern}') THEN {n}" for pattern, n in most[:-1])
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
assign AS (SELECT doc_id, 0 AS kind, start, start + length(hit) AS stop FROM ({_located(assign)})
    WHERE length(regexp_extract(hit, '{value}', 2)) >= {secrets.ASSIGN_LEAST}),
access AS (SELECT doc_id, 1 AS kind, start, start + length(hit) AS stop FROM ({_located(secrets.ACCESS)})),
hex AS (SELECT doc_id, 2 AS kind, start, start + length(hit) AS stop FROM ({_located(secrets.HEX)})),
candidate AS (
    SELECT *, CASE {of_class} ELSE {most[-1][1]} END AS most
    FROM ({_located(secrets.CANDIDATE)})
    WHERE (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '{secrets.BORDER}')
        OR regexp_matches(hit, '^[A-Za-z]+$') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '{secrets.UNLIKE_WORDS}'))
        AND NOT regexp_matches(hit, '{allowed}')),
letter AS (
    SELECT doc_id, start, most, w, hit[w + k] AS c
    FROM (SELECT *, unnest(range(0, {secrets.WINDOW})) AS k
          FROM (SELECT *, unnest(range(1, length(hit) - {secrets.WINDOW} + 2)) AS w FROM candidate))),
high AS (
    SELECT doc_id, start, w FROM (SELECT doc_id, start, most, w, c, count(*) AS n FROM letter GROUP BY ALL)
    GROUP BY doc_id, start, most, w HAVING sum({secrets.TERMS}[n + 1]) <= most),
entropy AS (SELECT doc_id, 3 AS kind, start + min(w) - 1 AS start, start + max(w) - 1 + {secrets.WINDOW} AS stop FROM high GROUP BY doc_id, high.start),
span AS (
    SELECT *, {list(secrets.KINDS)}[kind + 1] || ':' || start || ':' || stop AS words
    FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM entropy))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex,
    sha256(coalesce(string_agg(words, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
    coalesce(string_agg(words, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.n, d.doc_id
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, trees)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
occurrences AS (
    SELECT id, lang, source, term, count(*) AS n
    FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS whole FROM occurrences GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT d.lang, count(DISTINCT term) AS v FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN kept USING (lang) GROUP BY d.lang),
grp AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM occurrences GROUP BY ALL),
cells AS (SELECT grp.lang, grp.source, term, coalesce(n, 0) AS n, whole FROM grp JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
priced AS (
    SELECT lang, source, term, n, 1 + CAST(CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p,
        1 + CAST(CAST(1000000000 AS HUGEINT) * (whole + 2) // (sum(whole) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS q
    FROM cells JOIN langs USING (lang)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
    FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS (
    SELECT lang, size, phrase, count(*) AS a
    FROM (SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
          FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
                FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size))
    GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
    SELECT c.lang, c.size, c.phrase, c.a, k, f.a AS l, s.a AS r, n,
        CAST(CAST(1000 AS HUGEINT) * c.a * n // (CAST(f.a AS HUGEINT) * s.a) AS BIGINT) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM counts WHERE size > 1) c
    JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(words[1:k], ' ')
    JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(words[k + 1:], ' ')
    JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM counts c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 100 * b.a
        AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT * FROM (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
WHERE rank <= 2000
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (
    SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap, 2 * source_size * 6 // [3, 1, 2][(place - 1) % 3 + 1] AS ratio
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source)),
level AS (
    SELECT *, CAST(sum(cap) OVER (ORDER BY ratio, place) AS BIGINT) AS cap_so_far, CAST(sum(weight) OVER (ORDER BY ratio, place) AS BIGINT) AS weight_so_far,
        CAST(sum(source_size) OVER () AS BIGINT) AS whole, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s),
filled AS (SELECT *, (cap_so_far * 6 + ratio * (weights - weight_so_far)) * 2 <= whole * 18 AS is_full FROM level),
rest AS (
    SELECT *, CAST(coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS BIGINT) AS full_cap,
        CAST(coalesce(sum(weight) FILTER (WHERE is_full) OVER (), 0) AS BIGINT) AS full_weight FROM filled),
targets AS (
    SELECT source, source_size, place, weight, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
        ELSE CAST(whole * 3 - full_cap * 2 AS DOUBLE) * weight / CAST((weights - full_weight) * 2 AS DOUBLE) END AS target FROM rest),
queue AS (
    SELECT id, size, source_size, target, place, weight, row_number() OVER () AS n,
        CAST(sum(size) OVER (PARTITION BY place ORDER BY shuffle, id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
    FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source),
items AS (
    SELECT n, size, place, (served + r * source_size) * 6 // weight AS finish FROM queue, (SELECT unnest([0, 1]) AS r) WHERE size > 0),
taken AS (
    SELECT n, sum(size) AS words
    FROM (SELECT *, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS total FROM items)
    WHERE total * 2 <= (SELECT sum(size) FROM d) * 3 GROUP BY n)
SELECT id AS doc_id, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken FROM queue LEFT JOIN taken USING (n)
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_decontamination": op7_decontamination,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_source_divergence": op11_source_divergence,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_mixing": op13_mixing,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": OP2_SQL,
        "op6_warc_revisits": OP6_SQL,
        "op7_decontamination": OP7_SQL,
        "op8_secret_scan": op8_sql(),
        "op11_source_divergence": OP11_SQL,
        "op12_phrase_collocations": OP12_SQL,
        "op13_mixing": OP13_SQL,
    }
