"""Operator 2: not-modified revisits of web captures, resolved by an as-of join on the canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import read, stage

#: Headers of a stored response that a not-modified answer may not change. Fixed values.
FIXED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in small letters without user, www and default port; path without a last slash; query; no scheme or fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", ""), F.regexp_extract(rest, "([?].*)$", 1))


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def small_names(headers: Column) -> Column:
    """The map with names in small letters; of names that then are equal the last stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last(entries))


def resolve_revisits(records: DataFrame, rows_a_window: int = 4000) -> DataFrame:
    """A row for each revisit of records(record_id, kind, url, time long, headers map<string,string>, digest).

    Columns: record_id, canonical, time, response_id, response_time, status, checked, headers. The response is the latest
    of the same canonical URL that is earlier (of equal times the largest record_id). Validators are compared in this
    order, the first that both have decides (checked): etag without its weakness, last-modified, digest of the payload.
    status: resolved, mismatch, unverified (none in common) or missing (no earlier response). headers: those of the
    response, changed by the revisit's but for FIXED ones; those of the revisit alone where it isn't resolved. Header
    names are in small letters; of names that differ by case alone the last stays. Records without a URL or time are missing; other kinds are left out.

    An empty table gives no rows; rows that share a record_id are records of their own. Other columns are not read.
    A URL's records are also parted by time, and what an earlier part leaves is carried by one row a part, so a URL
    with many records is spread over tasks. Bodies do not move; join them by response_id.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "time", "headers", "digest")
    rows = stage(rows, "captures")
    n, low, high = rows.agg(F.count("*"), F.min("time"), F.max("time")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n // rows_a_window) + 1)
    answer = F.col("kind") == "response"
    rows = rows.withColumn("_part", F.floor((F.col("time") - (low or 0)) / width))
    rows = rows.withColumn("_full", F.when(answer & F.col("time").isNotNull() & F.col("canonical").isNotNull(), F.struct("time", "record_id", "headers", "digest")))
    order = ["time", F.when(answer, 1).otherwise(0), "record_id"]
    rows = rows.withColumn("_salt", F.when(F.col("canonical").isNull() | F.col("time").isNull(), F.xxhash64("record_id", "kind")))  # these meet nothing
    near = F.last("_full", ignorenulls=True).over(Window.partitionBy("canonical", "_part", "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("_full is not null").groupBy("canonical", "_part").agg(F.max_by("_full", F.struct("time", "record_id")).alias("_end"))
    parts = rows.select("canonical", "_part").distinct().join(ends, ["canonical", "_part"], "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("canonical").alias("_c"), F.col("_part").alias("_p"), before.alias("_before"))
    found = rows.withColumn("_near", near).where("kind = 'revisit'")
    found = found.join(parts, (F.col("canonical") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left")
    known = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    found = found.withColumn("_r", F.when(known, F.coalesce("_near", "_before")))
    own, old = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.coalesce("_r.headers", F.create_map().cast("map<string,string>"))
    found = found.withColumn("_own", small_names(own)).withColumn("_old", small_names(old))
    pairs = [("etag", weak(F.col("_own")["etag"]), weak(F.col("_old")["etag"])), ("last-modified", F.col("_own")["last-modified"], F.col("_old")["last-modified"]), ("digest", F.col("digest"), F.col("_r.digest"))]
    checked, same = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, a, b in reversed(pairs):
        both = a.isNotNull() & b.isNotNull()
        checked, same = F.when(both, name).otherwise(checked), F.when(both, a == b).otherwise(same)
    status = F.when(F.col("_r").isNull(), "missing").when(checked.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("status", status).withColumn("checked", F.when(F.col("_r").isNotNull(), checked))
    new = F.map_filter("_own", lambda k, _: ~k.isin(*FIXED))
    merged = F.map_concat(F.map_filter("_old", lambda k, _: ~F.map_contains_key(new, k)), new)
    headers = F.when(F.col("status") == "resolved", merged).otherwise(F.col("_own"))
    return found.select("record_id", "canonical", "time", F.col("_r.record_id").alias("response_id"), F.col("_r.time").alias("response_time"), "status", "checked", headers.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page as a full response and as a revisit; four pages share a URL, spelled in two ways.

    A revisit comes 5 before its page's response, with it or 5 after it, so it meets the page's own response, an
    earlier page's or none. Validators come and go by page_id, so every status occurs.
    """
    k = F.col("page_id")
    digest, day = F.md5("html"), F.concat(F.lit("day "), (k % 6).cast("string"))
    real = lambda **m: F.map_filter(F.create_map(*[x for n, v in m.items() for x in (F.lit(n.replace("_", "-")), v)]), lambda _, v: v.isNotNull())
    date = lambda t: F.concat(F.lit("d"), t.cast("string"))
    at, group = 10 * k + 5 * (k % 3) - 5, F.floor(k / 4).cast("string")
    full = real(ETag=F.when(k % 5 != 0, F.concat(F.lit('"'), digest, F.lit('"'))), Last_Modified=F.when(k % 3 != 1, day), Content_Type=F.lit("text/html"), Date=date(10 * k))
    again = real(etag=F.when(k % 2 == 0, F.concat(F.lit('W/"'), digest, F.lit('"'))), last_modified=F.when(k % 4 != 1, day), content_type=F.lit("none"), date=date(at))
    rows = F.array(
        F.struct((2 * k).alias("record_id"), F.lit("response").alias("kind"), F.concat(F.lit("http://www.Site.example/"), group, F.lit("/")).alias("url"), (10 * k).alias("time"), full.alias("headers"), F.when(k % 7 != 0, digest).alias("digest")),
        F.struct((2 * k + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.lit("HTTPS://SITE.example:443/"), group, F.lit("#again")).alias("url"), at.alias("time"), again.alias("headers"), F.when(k % 3 == 0, digest).alias("digest")),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(read(spark, sf_dir, "pages").select("page_id", "html")))
    return out.select("record_id", "canonical", "response_id", "status", "checked", F.size("headers").cast("long").alias("n_headers"), F.col("headers")["content-type"].alias("content_type"), F.col("headers")["date"].alias("date"))


#: Validators are compared here by plain columns; the as-of join takes the latest response that is earlier.
OP2_SQL = """WITH k AS (SELECT page_id AS k, md5(html) AS h, 'day ' || page_id % 6 AS day, 'site.example/' || page_id // 4 AS c FROM pages),
    o AS (SELECT c, 2 * k AS id, 10 * k AS t, CASE WHEN k % 5 <> 0 THEN h END AS etag, CASE WHEN k % 3 <> 1 THEN day END AS day, CASE WHEN k % 7 <> 0 THEN h END AS digest FROM k),
    r AS (SELECT c, 2 * k + 1 AS id, 10 * k + 5 * (k % 3) - 5 AS t, CASE WHEN k % 2 = 0 THEN h END AS etag, CASE WHEN k % 4 <> 1 THEN day END AS day, CASE WHEN k % 3 = 0 THEN h END AS digest FROM k),
    m AS (SELECT r.*, o.id AS o_id, o.etag AS o_etag, o.day AS o_day, o.digest AS o_digest FROM r ASOF LEFT JOIN o ON r.c = o.c AND r.t > o.t),
    v AS (SELECT *, CASE WHEN etag IS NOT NULL AND o_etag IS NOT NULL THEN 'etag' WHEN day IS NOT NULL AND o_day IS NOT NULL THEN 'last-modified' WHEN digest IS NOT NULL AND o_digest IS NOT NULL THEN 'digest' END AS checked FROM m),
    s AS (SELECT *, CASE WHEN o_id IS NULL THEN 'missing' WHEN checked IS NULL THEN 'unverified' WHEN CASE checked WHEN 'etag' THEN etag = o_etag WHEN 'last-modified' THEN day = o_day ELSE digest = o_digest END THEN 'resolved' ELSE 'mismatch' END AS status FROM v)
    SELECT id AS record_id, c AS canonical, o_id AS response_id, status, checked, CAST(2 + CASE WHEN etag IS NOT NULL OR (status = 'resolved' AND o_etag IS NOT NULL) THEN 1 ELSE 0 END + CASE WHEN day IS NOT NULL OR (status = 'resolved' AND o_day IS NOT NULL) THEN 1 ELSE 0 END AS BIGINT) AS n_headers,
        CASE WHEN status = 'resolved' THEN 'text/html' ELSE 'none' END AS content_type, 'd' || t AS date FROM s"""
