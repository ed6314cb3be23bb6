"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record stands for "304 Not Modified": its body is that of the latest earlier full response under the same
canonical URL, if the validators agree, and its headers update those of that response, as far as a 304 may.

The join takes time in chunks: the last full response of each (URL, chunk) is found by a partial aggregate, carried over
the chunks of a URL, and used where the revisit's own chunk has none earlier, so that a URL with very many captures is
dealt over as many tasks as it has chunks.

Defined cases: a null URL or time meets nothing; equal times are not earlier, and among equally late responses the
greatest record_id is taken; a revisit without validators, or with one that the response lacks, is a mismatch; header
names count without case and come out in lower case; a null header map counts as empty, a null value as no value; repeated
rows are resolved one by one; very long URLs and values stay whole; an empty table works; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 may not change, since they describe the body that it doesn't carry. Fixed values.
BODY_FIELDS = ["content-encoding", "content-length", "content-range", "content-type", "trailer", "transfer-encoding"]
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Without scheme, `www.`, default port, fragment, tracking parameters and final slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), f"^{TRACKING}(?:&|$)", ""), f"&{TRACKING}", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def field_map(headers: Column) -> Column:
    """Header fields by lower-case name, since names differ by case alone; values of one name in their order, with a comma
    between; a null map is empty."""
    kind = "array<struct<key:string,value:string>>"
    fields = F.coalesce(F.map_entries(headers), F.array()).cast(kind)
    names = F.array_distinct(F.transform(fields, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(fields, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """records (record_id, url, ts long, kind 'response' or 'revisit', etag, last_modified, headers map, digest). All of
    them with canonical_url, status (full, resolved, mismatch, orphan), refers_to, digest and merged headers."""
    rows = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", field_map(F.col("headers")).alias("headers"), "digest")
    rows = rows.withColumn("canonical_url", canonical_url(F.col("url")))
    # A record that can meet nothing is a group of its own, so that these are not gathered.
    lone = F.col("canonical_url").isNull() | F.col("ts").isNull()
    own = F.when(lone, F.struct(F.lit("").alias("url"), F.monotonically_increasing_id().alias("row"))).otherwise(F.struct(F.col("canonical_url").alias("url"), F.lit(-1).cast("long").alias("row")))
    rows = rows.withColumn("_lone", lone).withColumn("_own", own).withColumn("_chunk", F.when(~lone, F.floor(F.col("ts") / chunk_seconds)))
    body = F.struct("record_id", "etag", "last_modified", "headers", "digest")
    full, at = F.col("kind") == "response", F.struct("ts", "record_id")
    last = rows.filter(~F.col("_lone")).groupBy("canonical_url", "_chunk").agg(F.max_by(F.when(full, body), F.when(full, at)).alias("_last"))
    over = Window.partitionBy("canonical_url").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.struct(F.col("canonical_url").alias("url"), F.lit(-1).cast("long").alias("row")).alias("_key"), F.col("_chunk").alias("_at"), F.last("_last", ignorenulls=True).over(over).alias("_carried"))
    rows = rows.join(carried, (F.col("_own") == F.col("_key")) & (F.col("_chunk") == F.col("_at")), "left")
    inside = Window.partitionBy("_own", "_chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    met = F.max_by(F.when(full, body), F.when(full, at)).over(inside)
    rows = rows.withColumn("_met", F.when(~F.col("_lone"), F.coalesce(met, F.col("_carried"))))
    old = F.col("_met")
    # An entity tag decides if the revisit has one; the date counts only without it.
    agree = F.when(F.col("etag").isNotNull(), _weak(F.col("etag")) == _weak(old["etag"])).otherwise(F.col("last_modified") == old["last_modified"])
    agree = F.coalesce(agree, F.lit(False))
    status = F.when(full, "full").when(old.isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    own = F.col("headers")
    new = F.map_filter(own, lambda k, _: ~k.isin(BODY_FIELDS))
    kept = F.map_filter(old["headers"], lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    done = F.col("status") == "resolved"
    return rows.withColumn("status", status).select(
        "record_id", "url", "canonical_url", "ts", "kind", "status",
        F.when(F.col("status").isin("resolved", "mismatch"), old["record_id"]).alias("refers_to"),
        F.when(done, old["digest"]).when(full, F.col("digest")).alias("digest"),
        F.when(done, F.map_concat(kept, new)).otherwise(own).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """The pages as captures, one a minute: each a full response, and a revisit of the same URL (other scheme, no
    fragment) some hours later, or for each eleventh page a day earlier; each fifth has a stale entity tag, each next of
    five only a date."""
    page, at = F.col("page_id"), F.col("page_id") * 60
    tag, date = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 8), F.lit('"')), at.cast("string")
    pairs = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kv]), F.array(*[v for _, v in kv]))
    full = pages.select(
        (page * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
        pairs(("Content-Type", F.lit("text/html")), ("content-length", F.octet_length("html").cast("string")), ("Date", date), ("ETag", tag)).alias("headers"),
        F.sha2("html", 256).alias("digest"),
    )
    later = at + F.when(F.pmod(page, F.lit(11)) == 0, F.lit(-86_400)).otherwise(30 + F.pmod(page, F.lit(7)) * 3_600)
    seen = F.when(F.pmod(page, F.lit(5)) == 0, F.lit('"stale"')).when(F.pmod(page, F.lit(5)) == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), tag))
    url = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://", "HTTPS://")
    again = pages.select(
        (page * 2 + 1).alias("record_id"), url.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), seen.alias("etag"), date.alias("last_modified"),
        pairs(("Content-Length", F.lit("0")), ("date", later.cast("string")), ("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)


def op9_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", F.shiftright("record_id", 1).alias("page_id"), "canonical_url", "kind", "status", "refers_to", "digest", F.sha2(shown, 256).alias("headers_sha256"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, page_id * 60 AS sec, html, '"' || left(md5(html), 8) || '"' AS tag FROM pages),
rec AS (
  SELECT page_id * 2 AS record_id, url, sec AS ts, 'response' AS kind, tag AS etag, CAST(sec AS VARCHAR) AS last_modified, sha256(html) AS digest, CAST(strlen(html) AS VARCHAR) AS len, tag AS full_tag FROM p
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^https?://', 'HTTPS://'),
         sec + CASE WHEN page_id % 11 = 0 THEN -86400 ELSE 30 + page_id % 7 * 3600 END, 'revisit',
         CASE page_id % 5 WHEN 0 THEN '"stale"' WHEN 1 THEN NULL ELSE 'W/' || tag END, CAST(sec AS VARCHAR), NULL, NULL, NULL FROM p),
bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM rec),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^www\.|:(?:80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(b, '\?(.*)$', 1), '^(?:utm_[a-z]+|fbclid|gclid)=[^&]*(?:&|$)', ''), '&(?:utm_[a-z]+|fbclid|gclid)=[^&]*', '', 'g') AS q FROM bare),
c AS (SELECT *, host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM parts),
met AS (
  SELECT c.*, o.record_id AS o_id, o.etag AS o_tag, o.last_modified AS o_mod, o.digest AS o_digest, o.len AS o_len, o.ts AS o_ts
  FROM c LEFT JOIN c o ON c.kind = 'revisit' AND o.kind = 'response' AND o.canonical_url = c.canonical_url AND o.ts < c.ts
  QUALIFY row_number() OVER (PARTITION BY c.record_id ORDER BY o.ts DESC NULLS LAST, o.record_id DESC) = 1),
s AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN o_id IS NULL THEN 'orphan'
                 WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = o_tag ELSE last_modified = o_mod END THEN 'resolved'
                 ELSE 'mismatch' END AS status FROM met)
SELECT record_id, record_id // 2 AS page_id, canonical_url, kind, status, CASE WHEN status IN ('resolved', 'mismatch') THEN o_id END AS refers_to,
       CASE status WHEN 'resolved' THEN o_digest WHEN 'full' THEN digest END AS digest,
       sha256(CASE status
         WHEN 'full' THEN 'content-length: ' || len || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || full_tag
         WHEN 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || o_len || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || o_tag
         ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts END) AS headers_sha256
FROM s
"""
