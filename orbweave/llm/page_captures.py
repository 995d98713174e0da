"""WARC captures made from the ``pages`` table: each page's full response, and a not-modified revisit a week later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.store import Written
from orbweave.llm.warc import resolve

START, WEEK = 1_704_067_200, 7 * 86_400

ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS h, strlen(html)::BIGINT AS n, 1704067200 + page_id * 60 AS ts FROM pages
), c AS (
  SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(=.*)?$'))), '&') AS query
  FROM p
), f AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www[0-9]*\.', '') || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS cu,
    CASE WHEN page_id % 7 <> 0 THEN '"' || h || '"' END AS etag, ts::VARCHAR AS modified
  FROM c
), r AS (
  SELECT 'revisit-' || page_id AS record_id, cu, ts + 604800 AS ts, ts AS page_ts, h,
    CASE page_id % 5 WHEN 0 THEN '"' || h || '"' WHEN 1 THEN 'W/"' || h || '"' WHEN 3 THEN '"stale"' END AS etag,
    CASE page_id % 5 WHEN 2 THEN ts::VARCHAR END AS modified
  FROM f
), j AS (
  SELECT r.record_id, r.cu AS url, r.ts, r.etag AS e1, r.modified AS m1, 'page-' || f.page_id AS matched, f.etag AS e2, f.modified AS m2, f.h, f.n, f.ts AS full_ts
  FROM r ASOF LEFT JOIN f ON r.cu = f.cu AND r.ts > f.ts
), o AS (
  SELECT *, CASE WHEN matched IS NULL THEN 'missing'
    WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN CASE WHEN ltrim(e1, 'W/') = e2 THEN 'resolved' ELSE 'changed' END
    WHEN m1 IS NOT NULL THEN CASE WHEN m1 = m2 THEN 'resolved' ELSE 'changed' END
    ELSE 'unchecked' END AS outcome
  FROM j
)
SELECT record_id, url, ts AS captured_at, outcome, matched,
  CASE WHEN outcome = 'resolved' THEN n END AS n_bytes, CASE WHEN outcome = 'resolved' THEN h END AS payload_md5,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=3600', 'content-type: text/html', 'date: ' || ts,
    'etag: ' || coalesce(e1, e2), 'last-modified: ' || coalesce(m1, m2), 'set-cookie: a=1', 'vary: accept') END AS headers
FROM o
"""


def _headers(*named: tuple[str, Column]) -> Column:
    every = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in named])
    return F.map_from_entries(F.filter(every, lambda x: x["value"].isNotNull()))


def captures(pages: DataFrame) -> DataFrame:
    """(record_id, kind, url, at, headers, n, h) for ``pages`` (page_id, url, html): no bodies, but their size and md5."""
    body = F.coalesce("html", F.lit("")).cast("string")
    light = Written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(body.cast("binary")).alias("h"), F.octet_length(body).cast("long").alias("n")), "pages").df
    when = F.lit(START) + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.col("h"), F.lit('"'))
    full = light.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("kind"), "url", F.timestamp_seconds(when).alias("at"),
        _headers(("etag", F.when(F.col("page_id") % 7 != 0, etag)), ("last-modified", when.cast("string")), ("content-type", F.lit("text/html")), ("cache-control", F.lit("max-age=60")), ("date", when.cast("string")), ("set-cookie", F.lit("a=1"))).alias("headers"), "n", "h",
    )
    kind = F.col("page_id") % 5
    later = when + WEEK
    tag = F.when(kind == 0, etag).when(kind == 1, F.concat(F.lit("W/"), etag)).when(kind == 3, F.lit('"stale"'))
    again = light.select(
        F.concat(F.lit("revisit-"), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("kind"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))).alias("url"), F.timestamp_seconds(later).alias("at"),
        _headers(("etag", tag), ("last-modified", F.when(kind == 2, when.cast("string"))), ("cache-control", F.lit("max-age=3600")), ("date", later.cast("string")), ("set-cookie", F.lit("b=2")), ("vary", F.lit("accept"))).alias("headers"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("h"),
    )
    return full.unionByName(again)


def resolved(pages: DataFrame) -> DataFrame:
    """(record_id, url, captured_at, outcome, matched, n_bytes, payload_md5, headers) of each page's revisit."""
    all_ = captures(pages)
    found = resolve(all_)
    bodies = all_.filter("kind = 'response'").select(F.col("record_id").alias("matched"), "n", "h")
    ok = F.col("outcome") == "resolved"
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.join(bodies, "matched", "left").select("record_id", "url", F.unix_seconds("at").alias("captured_at"), "outcome", "matched", F.when(ok, F.col("n")).alias("n_bytes"), F.when(ok, F.col("h")).alias("payload_md5"), F.when(ok, lines).alias("headers"))
