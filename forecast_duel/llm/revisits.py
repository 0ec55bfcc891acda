"""Resolution of not-modified revisits: an as-of join to the latest earlier full response of the same page.

A record has an id, a URL, a time, a status, validators and headers. A record of status 304 takes the payload of the
latest full response (200) of the same canonical URL before it, by time and then id. Its validators must agree: its entity
tag with the response's, a weak mark aside, or without a tag its modification time. Headers of the revisit
replace those of the response unless they describe the payload.

The join works by (URL, time slice): inside a slice by a window, across slices by the last response of each, which
is one row a slice. So the records of one URL that holds a third of all rows are worked on in as many tasks as there are slices.

Defined results: ``no_response`` without an earlier full response (also for a null URL or null time), ``mismatch`` if validators
disagree, ``unchecked`` if the revisit has none, else ``resolved``; equal times go by id, null ids first; repeated rows
are returned each; other statuses are no revisits and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parameters that do not change a page, and headers that describe a payload and stay with it.
DROPPED_PARAMETERS = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="
PAYLOAD_HEADERS = ("content-length", "content-type", "content-encoding", "content-range", "transfer-encoding")
#: Headers of one connection; those that a Connection header lists are dropped with them.
HOP_BY_HOP = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host without case, ``www.`` and its scheme's default port; path without a closing slash; sorted parameters; no fragment."""
    host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^(http://.*):80$|^(https://.*):443$", "$1$2"), r"^[a-z]+://(www\.)?", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(DROPPED_PARAMETERS)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def end_to_end(headers: Column) -> Column:
    """Headers with lower-case names and without those of one connection. Of names that differ in case alone the last stays."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                          lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    listed = F.flatten(F.transform(F.filter(entries, lambda e: (e["key"] == "connection") & e["value"].isNotNull()),
                                   lambda e: F.split(F.lower(F.regexp_replace(e["value"], r"\s", "")), ",")))
    names = F.transform(entries, lambda e: e["key"])
    kept = F.filter(entries, lambda e, i: ~e["key"].isin(*HOP_BY_HOP) & ~F.array_contains(listed, e["key"])
                    & ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.map_from_entries(kept)


def merged_headers(response: Column, revisit: Column) -> Column:
    """Headers of the response, replaced and joined by those of the revisit that a 304 may change; names become lower-case."""
    new = F.map_filter(end_to_end(revisit), lambda k, v: ~k.isin(*PAYLOAD_HEADERS))
    old = F.map_filter(end_to_end(response), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row a revisit of ``records`` (record_id, url, ts, status, etag, last_modified, headers, payload):
    record_id, canonical_url, response_id, outcome, headers and payload."""
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("page"), "ts", "status", "etag", "last_modified", "headers", "payload")
    # The slices follow the times of all records; any cut would be right, an even one spreads the work.
    cuts = rows.agg(F.percentile_approx("ts", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    cut = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("slice", F.size(F.filter(cut, lambda c: c < F.col("ts"))))
    full = F.col("status") == 200
    response = F.struct(*(F.col(c) for c in ("record_id", "etag", "last_modified", "headers", "payload")))
    before = Window.partitionBy("page", "slice").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    usable = rows.where("page IS NOT NULL AND ts IS NOT NULL AND status IN (200, 304)")
    inside = usable.withColumn("near", F.last(F.when(full, response), ignorenulls=True).over(before)).where("status = 304")
    last = usable.where(full).groupBy("page", "slice").agg(F.max_by(response, F.struct("ts", "record_id")).alias("last"))
    ever = usable.groupBy("page", "slice").agg(F.max(full).alias("any")).join(last, ["page", "slice"], "left")
    earlier = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ever.select("page", "slice", F.last("last", ignorenulls=True).over(earlier).alias("far"))
    joined = inside.join(carried, ["page", "slice"], "left").withColumn("found", F.coalesce("near", "far")).drop("near", "far")
    lost = rows.where("status = 304 AND (page IS NULL OR ts IS NULL)").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    every = joined.select(*lost.columns).unionByName(lost)
    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    outcome = (
        F.when(F.col("found").isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(strong("etag") == strong("found.etag"), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("found.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unchecked"))
    taken = F.col("outcome").isin("resolved", "unchecked")
    return every.withColumn("outcome", outcome).select(
        "record_id", F.col("page").alias("canonical_url"), "outcome", F.when(taken, F.col("found.record_id")).alias("response_id"),
        F.when(taken, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
        F.when(taken, F.col("found.payload")).alias("payload"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl derived from ``pages``: each page is fetched, revisited, for a part changed and revisited once more.

    Some revisits come before the first fetch, some bring another or a weak tag, some only a modification time. The
    payload is named by the digest of the page.
    """
    base = pages.select("page_id", "url", F.md5("html").alias("digest"))
    tag = lambda d: F.concat(F.lit('"'), d, F.lit('"'))

    def record(df, number, ts, status, etag, modified, kind, payload):
        headers = F.create_map(F.lit("etag"), etag, F.lit("content-type"), F.lit(kind), F.lit("age"), F.lit(str(number)))
        headers = F.map_filter(headers, lambda k, v: v.isNotNull())
        return df.select(
            (F.col("page_id") * 8 + number).alias("record_id"), "url", ts.cast("long").alias("ts"), F.lit(status).alias("status"),
            etag.alias("etag"), modified.cast("long").alias("last_modified"), headers.alias("headers"), payload.alias("payload"))

    at, none = F.col("page_id") * 10, F.lit(None).cast("string")
    m, digest = F.col("page_id") % 7, F.col("digest")
    own = F.when(m == 0, tag(F.lit("other"))).when(m == 1, F.concat(F.lit("W/"), tag(digest))).when(m < 4, none).otherwise(tag(digest))
    when_ = F.when(m == 2, F.col("page_id")).when(m == 3, F.lit(None))
    parts = [
        record(base, 0, at, 200, tag(digest), F.col("page_id"), "text/html", digest),
        record(base, 1, at + 1 + F.col("page_id") % 1000, 304, own, when_, "text/plain", none),
        record(base.where("page_id % 3 = 0"), 2, at + 500, 200, tag(F.md5(digest)), F.col("page_id") + 1, "text/html", F.md5(digest)),
        record(base.where("page_id % 3 = 0"), 3, at + 900, 304, tag(F.md5(digest)), F.lit(None), "text/html", none),
        record(base.where("page_id % 5 = 0"), 4, at - 3, 304, tag(digest), F.lit(None), "text/html", none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
