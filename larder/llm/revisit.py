"""Resolution of not-modified revisit records in web archives.

A revisit carries no payload. It is resolved by an as-of join: among the captures
of the same canonical URL, the latest full response before it. The validators of
the two are compared, and the headers a 304 may update are merged into the stored
ones. Only ids, validators and headers move; payloads stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Header fields that describe a message body or one connection and that a 304 does not update.
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]
BUCKET_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, fragment, tracking parameters and final slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, overlaid by those of the 304 that it may update; names in lower case (see lower_names)."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(KEPT_FIELDS))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def lower_names(headers: Column) -> Column:
    """The headers with names in lower case; of names that differ in case alone the last in the map counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.aggregate(
        F.reverse(entries), F.slice(entries, F.lit(1), F.lit(0)),
        lambda kept, e: F.when(F.exists(kept, lambda k: k["key"] == e["key"]), kept).otherwise(F.concat(kept, F.array(e))),
    )
    return F.map_from_entries(last)


def resolve(captures: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, resolution, target_id, payload_digest, headers.

    captures: record_id, url, ts (seconds), kind ('response' or 'revisit'), headers
    (a map; of names that differ in case alone the last counts) and payload_digest; other
    columns are ignored. Earlier means a smaller (ts, record_id). resolution:
      resolved      the entity tags agree (weak comparison), or without one in the
                    revisit the last-modified dates do
      mismatch      the validator differs from the stored one or that is absent
      no_validator  the revisit names none
      missing       no earlier full response of this URL
    target_id is null for missing, payload_digest and headers only for resolved.
    A null url never matches and enters no window; rows with a null ts come before all others; null headers
    are empty; repeated rows are resolved each for itself. An empty table gives no rows.

    A hot URL is cut by time: each (URL, bucket) is sorted alone, and the last
    response of earlier buckets is carried over from one row per bucket.
    """
    none = F.expr("cast(map() as map<string,string>)")
    headers = lower_names(F.coalesce("headers", none))
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", headers.alias("headers"), "payload_digest",
    ).where(F.col("kind").isin("response", "revisit")).withColumn("bucket", F.floor(F.coalesce("ts", F.lit(-(1 << 40))) / bucket))
    stored = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "payload_digest", F.col("headers").alias("stored")))
    unnamed = rows.where("canonical_url is null and kind = 'revisit'").drop("kind", "payload_digest")
    rows = rows.where("canonical_url is not null").withColumn("full", stored)
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first()]
    inside = Window.partitionBy("canonical_url", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("full", "kind", "payload_digest")
    across = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("canonical_url", "bucket")
        .agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("latest"))
        .withColumn("far", F.last("latest", ignorenulls=True).over(across))
        .where("far is not null").select("canonical_url", "bucket", "far")
    )
    found = near.join(carried, ["canonical_url", "bucket"], "left").withColumn("target", F.coalesce("near", "far")).unionByName(unnamed, allowMissingColumns=True)
    tag = lambda c: F.regexp_replace(c["etag"], "^W/", "")
    mine, theirs = tag(F.col("headers")), tag(F.col("target.stored"))
    since, stored_since = F.col("headers")["last-modified"], F.col("target.stored")["last-modified"]
    resolution = (
        F.when(F.col("target").isNull(), "missing")
        .when(mine.isNotNull(), F.when(mine == theirs, "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(since == stored_since, "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    done = F.col("resolution") == "resolved"
    return found.withColumn("resolution", resolution).select(
        "record_id", "canonical_url", "ts", "resolution", F.col("target.record_id").alias("target_id"),
        F.when(done, F.col("target.payload_digest")).alias("payload_digest"),
        F.when(done, merged_headers(F.col("target.stored"), F.col("headers"))).alias("headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log made of the table of pages: a full response of each page, a revisit
    of it 50 seconds later under another spelling of its URL, and of every third page one
    shortly before it. Every fifth page's revisit names a stale entity tag, every seventh
    names only a date, every eleventh no validator at all."""
    n, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), (n % 365).cast("string"))
    text = lambda c: c.cast("string")
    response = pages.select(
        (n * 3).alias("record_id"), "url", (n * 100).alias("ts"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), text(F.octet_length("html")), F.lit("ETag"), tag,
            F.lit("Last-Modified"), date, F.lit("Cache-Control"), F.lit("max-age=600"),
        ).alias("headers"),
        F.sha1("html").alias("payload_digest"),
    )
    validators = (
        F.when(n % 11 == 0, F.expr("cast(map() as map<string,string>)"))
        .when(n % 7 == 0, F.create_map(F.lit("last-modified"), date))
        .when(n % 5 == 0, F.create_map(F.lit("etag"), F.lit('"stale"')))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag)))
    )
    update = F.map_concat(validators, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), text(n % 1000)), F.lit("Age"), F.lit("7")))
    revisit = pages.select(
        (n * 3 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://"), F.lit("#again")).alias("url"),
        (n * 100 + 50).alias("ts"), F.lit("revisit").alias("kind"), update.alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    early = revisit.where("(record_id - 1) div 3 % 3 = 0").withColumns({"record_id": F.col("record_id") + 1, "ts": F.col("ts") - 60})
    return response.unionByName(revisit).unionByName(early)


def resolved_pages(pages: DataFrame) -> DataFrame:
    """resolve() over captures_of_pages(), headers as sorted lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve(captures_of_pages(pages)).withColumn("headers", lines)


#: The same in DuckDB's SQL, by an as-of join.
ORACLE = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(html) || '"' AS tag, 'day ' || (page_id % 365) AS day, sha1(html) AS digest, octet_length(encode(html)) AS n,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest
  FROM pages
), c AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) AS kept FROM p)
), v AS (
  SELECT page_id * 3 + 1 AS record_id, page_id * 100 + 50 AS ts, * FROM c
  UNION ALL SELECT page_id * 3 + 2, page_id * 100 - 10, * FROM c WHERE page_id % 3 = 0
), j AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.page_id, v.tag, v.day, r.page_id AS other, r.tag AS their_tag, r.day AS their_day, r.n AS their_n, r.digest AS their_digest
  FROM v ASOF LEFT JOIN (SELECT canonical_url AS u, page_id * 100 AS at, page_id, tag, day, digest, n FROM c) r
    ON v.canonical_url = r.u AND v.ts > r.at
), k AS (
  SELECT *, CASE WHEN other IS NULL THEN 'missing'
    WHEN page_id % 11 = 0 THEN 'no_validator'
    WHEN page_id % 7 = 0 THEN CASE WHEN day = their_day THEN 'resolved' ELSE 'mismatch' END
    WHEN page_id % 5 = 0 THEN 'mismatch'
    ELSE CASE WHEN tag = their_tag THEN 'resolved' ELSE 'mismatch' END END AS resolution
  FROM j
)
SELECT record_id, canonical_url, ts, resolution, other * 3 AS target_id,
  CASE WHEN resolution = 'resolved' THEN their_digest END AS payload_digest,
  CASE WHEN resolution = 'resolved' THEN 'age: 7' || chr(10) || 'cache-control: max-age=' || (page_id % 1000) || chr(10)
    || 'content-length: ' || their_n || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE WHEN page_id % 7 = 0 THEN their_tag ELSE 'W/' || tag END || chr(10) || 'last-modified: ' || their_day END AS headers
FROM k
"""
