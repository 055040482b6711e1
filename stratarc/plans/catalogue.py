"""The query catalogue over the test tables, each query with its SQL for DuckDB."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U
from stratarc.operators import asof, refs, resolve, search, stats, tree
from stratarc.operators import captures as C
from stratarc.operators.stored import shared_dir, stored
from stratarc.plans.fixture import CAPTURES_SQL, captures, captures_raw, events, pages
from stratarc.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = "") -> Callable[[Query], Query]:
    """Register a query; its SQL may use the derived tables captures, cap and raw, and those of ``more``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {CAPTURES_SQL}{',' + more if more else ''}\n{sql}"
        return f

    return add


# --- totals, groups and statistics

DEDUP_SQL = " ded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY custom_id ORDER BY file_name, byte_offset) AS rn FROM raw) WHERE rn = 1)"


@query("dedup_totals", "SELECT count(*) AS records, count(*) FILTER (rec_type = 'response') AS responses FROM ded", DEDUP_SQL)
def dedup_totals(spark, d):
    return C.totals(C.first_per_id(captures_raw(spark, d)))


@query("newest_per_uri", "SELECT custom_id, archived_ts, max(archived_ts) OVER (PARTITION BY uri) AS last_archived_ts FROM cap")
def newest_per_uri(spark, d):
    return C.with_newest(captures(spark, d)).select("custom_id", "archived_ts", "last_archived_ts")


@query("newest_per_host", "SELECT h AS host, max(archived_ts) AS newest_ts, count(*) AS n FROM (SELECT regexp_replace(host, '^www[.]', '') AS h, archived_ts FROM cap) GROUP BY ROLLUP (h)")
def newest_per_host(spark, d):
    return stats.newest_per_host(captures(spark, d))


@query("uri_groups", "SELECT uri, n, custom_id, archived_ts, rn AS pos FROM (SELECT *, count(*) OVER (PARTITION BY uri) AS n, row_number() OVER (PARTITION BY uri ORDER BY archived_ts DESC, custom_id DESC) AS rn FROM cap) WHERE rn <= 3")
def uri_groups(spark, d):
    return stats.uri_captures(captures(spark, d)).where("pos <= 3")


@query("uri_groups_all", "SELECT uri, count(*) OVER (PARTITION BY uri) AS n, custom_id, archived_ts, row_number() OVER (PARTITION BY uri ORDER BY archived_ts DESC, custom_id DESC) AS pos FROM cap")
def uri_groups_all(spark, d):
    """Every capture of every URL."""
    return stats.uri_captures(captures(spark, d))


@query("uri_stats", "SELECT uri, count(*) AS n, CAST(coalesce(sum(payload_size), 0) AS BIGINT) AS total_size, min(archived_ts) AS first_ts, max(archived_ts) AS last_ts FROM cap GROUP BY uri")
def uri_stats(spark, d):
    return stats.uri_stats(captures(spark, d))


@query("capture_pattern", "SELECT pattern, count(*) AS urls FROM (SELECT CASE WHEN count(*) = 1 THEN 'one' WHEN count(DISTINCT CAST(archived_ts AS DATE)) = 1 THEN 'one day' ELSE 'several days' END AS pattern FROM cap GROUP BY uri) GROUP BY pattern")
def capture_pattern(spark, d):
    return stats.capture_pattern(captures(spark, d))


@query("capture_pattern_all", "SELECT pattern, count(*) AS urls FROM (SELECT CASE WHEN count(*) = 1 THEN 'one' WHEN count(DISTINCT CAST(archived_ts AS DATE)) = 1 THEN 'one day' ELSE 'several days' END AS pattern FROM cap GROUP BY uri) GROUP BY pattern")
def capture_pattern_all(spark, d):
    return stats.capture_pattern(captures(spark, d))


@query(
    "host_overview",
    "SELECT host, count(*) AS responses, (SELECT count(DISTINCT host) FROM b) AS hosts, (SELECT min(archived_ts) FROM b) AS first_ts, (SELECT max(archived_ts) FROM b) AS last_ts FROM b GROUP BY host ORDER BY responses DESC, host LIMIT 12",
    " b AS (SELECT * FROM cap WHERE rec_type = 'response')",
)
def host_overview(spark, d):
    return stats.host_overview(captures(spark, d))


@query("timeline_days", "SELECT day, n, peak, greatest(4, CAST(floor(100.0 * n / peak) AS BIGINT)) AS bar FROM (SELECT *, max(n) OVER () AS peak FROM (SELECT strftime(archived_ts, '%Y-%m-%d') AS day, count(*) AS n FROM cap GROUP BY 1))")
def timeline_days(spark, d):
    return stats.timeline_days(captures(spark, d))


@query("timeline_rollup", "SELECT year, month, day, count(*) AS n FROM (SELECT strftime(archived_ts, '%Y') AS year, strftime(archived_ts, '%Y-%m') AS month, strftime(archived_ts, '%Y-%m-%d') AS day FROM cap) GROUP BY ROLLUP (year, month, day)")
def timeline_rollup(spark, d):
    return stats.timeline_rollup(captures(spark, d))


@query("timeline_zone", "SELECT strftime(archived_ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM cap GROUP BY 1")
def timeline_zone(spark, d):
    """Local days of a zone five hours behind."""
    moved = captures(spark, d).withColumn("archived_ts", F.col("archived_ts") - F.expr("INTERVAL 5 HOURS"))
    return moved.groupBy(stats.day_key(F.col("archived_ts")).alias("day")).agg(F.count("*").alias("n"))


#: New York: four hours behind from the second Sunday of March, 7:00 UTC, to the first one of November, 6:00 UTC; else five.
NEW_YORK_SQL = """ yearly AS (SELECT archived_ts + to_days(CAST((event_id % 12) * 30 AS INTEGER)) AS archived_ts FROM cap),
 starts AS (SELECT archived_ts, make_timestamp(year(archived_ts), 3, 1, 0, 0, 0) AS m, make_timestamp(year(archived_ts), 11, 1, 0, 0, 0) AS n FROM yearly),
 ny AS (SELECT archived_ts - CASE WHEN archived_ts >= m + to_days(CAST(14 - isodow(m) AS INTEGER)) + INTERVAL 7 HOUR AND archived_ts < n + to_days(CAST(7 - isodow(n) AS INTEGER)) + INTERVAL 6 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS local_ts FROM starts)"""


@query("timeline_zone_named", "SELECT year, month, day, count(*) AS n FROM (SELECT strftime(local_ts, '%Y') AS year, strftime(local_ts, '%Y-%m') AS month, strftime(local_ts, '%Y-%m-%d') AS day FROM ny) GROUP BY ROLLUP (year, month, day)", NEW_YORK_SQL)
def timeline_zone_named(spark, d):
    """Local days of New York, with captures spread over the year, so that both changes of the clock are met."""
    spread = captures(spark, d).withColumn("archived_ts", F.col("archived_ts") + F.make_dt_interval((F.col("event_id") % 12 * 30).cast("int")))
    return stats.timeline_rollup(spread, "America/New_York")


PATH_SQL = """ tree0 AS (SELECT *, list_transform(range(0, len(segs) + 1), lambda i: CASE WHEN i = 0 THEN origin || '/' ELSE origin || '/' || array_to_string(segs[1:i], '/') END) AS steps FROM cap),
 treed AS (SELECT *, CASE WHEN query <> '' THEN list_append(steps, steps[len(steps)] || '?' || query) ELSE steps END AS path FROM tree0),
 treen0 AS (SELECT *, list_transform(range(0, len(segs) + 1), lambda i: CASE WHEN i = 0 THEN nhost || '/' ELSE nhost || '/' || array_to_string(segs[1:i], '/') END) AS steps FROM (SELECT *, regexp_replace(host, '^www[.]', '') AS nhost FROM cap)),
 treen AS (SELECT *, CASE WHEN query <> '' THEN list_append(steps, steps[len(steps)] || '?' || query) ELSE steps END AS path FROM treen0)"""


@query("content_types", "SELECT content_type, count(DISTINCT path[len(path)]) AS nodes, count(*) AS captures FROM treed WHERE content_type <> '' GROUP BY content_type", PATH_SQL)
def content_types(spark, d):
    return stats.content_types(captures(spark, d))


@query("usable_types", "SELECT DISTINCT content_type FROM cap WHERE regexp_full_match(content_type, '[a-z0-9.+-]+/[a-z0-9.+*-]+') AND split_part(content_type, '/', 1) IN ('application', 'audio', 'font', 'image', 'message', 'model', 'multipart', 'text', 'video')")
def usable_types(spark, d):
    return stats.usable_types(captures(spark, d))


@query("type_filter", "SELECT 'text' AS wanted, count(*) AS n FROM cap WHERE content_type LIKE 'text/%' UNION ALL SELECT 'audio/ogg', count(*) FROM cap")
def type_filter(spark, d):
    c = captures(spark, d)
    return search.type_filter(c, "text").agg(F.lit("text").alias("wanted"), F.count("*").alias("n")).unionByName(search.type_filter(c, "audio/ogg").agg(F.lit("audio/ogg").alias("wanted"), F.count("*").alias("n")))


@query("type_local", "SELECT DISTINCT path[len(path)] AS node FROM treed WHERE content_type = 'text/html'", PATH_SQL)
def type_local(spark, d):
    return tree.find_type(captures(spark, d), "text/html")


@query(
    "worst_status",
    "SELECT node, CASE WHEN count(*) FILTER (rec_type = 'response') = 0 THEN 0 WHEN max(s) IS NULL THEN 1 WHEN max(s) < 300 THEN min(s) ELSE max(s) END AS worst FROM (SELECT unnest(path) AS node, rec_type, CASE WHEN rec_type = 'response' THEN status END AS s FROM treed) GROUP BY node",
    PATH_SQL,
)
def worst_status(spark, d):
    return stats.worst_status(captures(spark, d))


@query("redirect_bodies", "SELECT count(*) AS redirects, count(*) FILTER (payload_size >= 1) AS with_body, count(*) FILTER (payload_size >= 1 AND payload_size < 256) AS small_bodies FROM cap WHERE status BETWEEN 300 AND 399")
def redirect_bodies(spark, d):
    return stats.redirect_bodies(captures(spark, d))


@query("status_classes", "SELECT CASE WHEN status IS NULL THEN 'none' WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx' WHEN status < 500 THEN '4xx' ELSE '5xx' END AS class, coalesce(status BETWEEN 300 AND 399, false) AS redirect, count(*) AS n FROM cap GROUP BY ALL")
def status_classes(spark, d):
    return captures(spark, d).groupBy(H.status_class(F.col("status")).alias("class"), H.is_redirect(F.col("status")).alias("redirect")).agg(F.count("*").alias("n"))


@query("header_lookup", "SELECT custom_id, content_type_raw, location FROM cap")
def header_lookup(spark, d):
    return captures(spark, d).select("custom_id", H.header(F.col("headers"), "content-type").alias("content_type_raw"), H.header(F.col("headers"), "LOCATION").alias("location"))


@query("type_forms", "SELECT content_type_raw, content_type AS essence, CASE WHEN content_type_raw LIKE 'text/css%' THEN 'text/css; charset=UTF-8' ELSE content_type_raw END AS whole, count(*) AS n FROM cap GROUP BY ALL")
def type_forms(spark, d):
    t = F.col("content_type_raw")
    return captures(spark, d).groupBy("content_type_raw", H.content_essence(t).alias("essence"), H.content_type_full(t).alias("whole")).agg(F.count("*").alias("n"))


@query("id_parts", "SELECT custom_id, file_name, uri AS url, uuid FROM cap")
def id_parts(spark, d):
    p = H.custom_id_parts(F.col("custom_id"))
    return captures(spark, d).select("custom_id", p.file_name.alias("file_name"), p.url.alias("url"), p.uuid.alias("uuid"))


LOG_SQL = """ log AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 502 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 418 END AS status,
 CASE event_id % 9 WHEN 6 THEN 'SyntaxError' WHEN 7 THEN 'TimeoutError' ELSE 'TypeError' END AS error_name FROM events WHERE event_type = 'error')"""


@query(
    "failure_kinds",
    "SELECT kind, kind IN ('timeout', 'throttled', 'server', 'offline') AS retryable, count(*) AS n FROM (SELECT CASE WHEN status = 502 THEN 'timeout' WHEN status = 404 THEN 'missing' WHEN status = 403 THEN 'denied' WHEN status = 429 THEN 'throttled' WHEN status = 500 THEN 'server' WHEN status = 418 THEN 'rejected' WHEN error_name = 'SyntaxError' THEN 'malformed' WHEN error_name = 'TimeoutError' THEN 'timeout' ELSE 'offline' END AS kind FROM log) GROUP BY kind",
    LOG_SQL,
)
def failure_kinds(spark, d):
    i = F.col("event_id") % 9
    codes = F.element_at(F.array(*(F.lit(x) for x in (502, 404, 403, 429, 500, 418, None, None, None))), (i + 1).cast("int"))
    log = events(spark, d).where("event_type = 'error'").select(codes.alias("status"), F.when(i == 6, "SyntaxError").when(i == 7, "TimeoutError").otherwise("TypeError").alias("error_name"), F.lit("it failed").alias("message"))
    return stats.failures(log)


@query("number_forms", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN CAST(event_id AS DOUBLE) ELSE event_id / 10.0 END AS number FROM events")
def number_forms(spark, d):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.lit(" ")).when(i % 4 == 1, F.concat(i.cast("string"), F.lit(" kB"))).when(i % 4 == 2, F.concat(F.lit(" "), i.cast("string"))).otherwise((i / 10.0).cast("string"))
    return events(spark, d).select("event_id", H.number_or_null(text).alias("number"))


@query("date_forms", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS date FROM events")
def date_forms(spark, d):
    """ISO dates, HTTP dates, and text that is no date."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    text = F.when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 3 == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("Someday, 2024")
    return events(spark, d).select("event_id", H.date_or_null(text).cast("timestamp_ntz").alias("date"))


@query("quality_flags", "SELECT custom_id, event_id % 3 = 1 AS chunked, event_id % 5 = 0 AS truncated, CASE WHEN event_id % 7 = 0 THEN custom_id ELSE uuid END AS shown_id FROM cap")
def quality_flags(spark, d):
    i = F.col("event_id")
    chunks = F.when(i % 3 == 0, F.array().cast("array<bigint>")).when(i % 3 == 1, F.array(F.lit(4).cast("long"), i))
    flags = H.quality_flags(chunks, F.when(i % 5 == 0, "length"), F.when(i % 7 == 0, "").otherwise(F.col("uuid")), F.col("custom_id"))
    return captures(spark, d).select("custom_id", flags.alias("f")).select("custom_id", "f.*")


@query("all_files", "SELECT file_name, count(*) AS n FROM cap GROUP BY file_name")
def all_files(spark, d):
    """Captures of even and odd files, of which only one has the header bags, as one table."""
    c = captures(spark, d)
    return C.all_files(c.where("event_id % 2 = 0"), c.where("event_id % 2 = 1").drop("headers")).groupBy("file_name").agg(F.count("*").alias("n"))


@query("json_rows", "SELECT custom_id, archived_ts, status, content_type, byte_offset, location FROM cap")
def json_rows(spark, d):
    """The captures as JSON rows, read back: header bags as objects or as JSON text, offsets as numbers or text."""
    from stratarc.sources.rows import read_rows

    c, at = captures(spark, d), f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    even = F.col("event_id") % 2 == 0
    plain = c.select("custom_id", "uri", F.date_format("archived_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("archived_ts"), "status", F.col("content_type_raw").alias("content_type"), "byte_offset", "headers", even.alias("even"))
    plain.where("even").drop("even").write.json(f"{at}/even")
    plain.where("NOT even").drop("even").withColumn("byte_offset", F.col("byte_offset").cast("string")).withColumn("headers", F.to_json("headers")).write.json(f"{at}/odd")
    rows = read_rows(spark, f"{at}/even").unionByName(read_rows(spark, f"{at}/odd"))
    return rows.select("custom_id", F.col("archived_ts").cast("timestamp_ntz").alias("archived_ts"), "status", "content_type", "byte_offset", H.header(F.col("headers"), "location").alias("location"))


@query("archive_detail", "SELECT custom_id, has_request, redirect, uri FROM (SELECT r.custom_id, r.uri, count(q.custom_id) > 0 AS has_request, coalesce(r.status BETWEEN 300 AND 399, false) AS redirect FROM cap r LEFT JOIN cap q ON q.rec_type = 'request' AND q.concurrent_uuid = r.uuid WHERE r.rec_type = 'response' GROUP BY r.custom_id, r.uri, r.status) WHERE custom_id = (SELECT min(custom_id) FROM cap WHERE rec_type = 'response')")
def archive_detail(spark, d):
    """The named function for one capture."""
    from stratarc import api

    c = captures(spark, d)
    one = c.where("rec_type = 'response'").agg(F.min("custom_id")).first()[0]
    return api.get_capture_detail(c, one).select("custom_id", "has_request", "redirect", "uri")


# --- search and paging

FOUND_SQL = " found AS (SELECT DISTINCT uri, CAST(len(segs) AS INTEGER) AS level FROM cap WHERE contains(lower(uri), 'th'))"


INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, d: str):
    """The stored order of the captures' URLs, written once for a session and input."""
    from stratarc.operators.searchindex import build_index, open_index

    key = (spark.sparkContext.applicationId, d)
    if key not in INDEXES:
        at = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        build_index(captures(spark, d), at)
        INDEXES[key] = at
    return open_index(spark, INDEXES[key])


@query("search_index", "SELECT level, uri FROM (SELECT DISTINCT uri, len(segs) AS level FROM cap)")
def search_index(spark, d):
    return _index(spark, d).uris.select("level", "uri")


@query("search_page_offset", "SELECT level, uri FROM found ORDER BY level, uri LIMIT 16 OFFSET 32", FOUND_SQL)
def search_page_offset(spark, d):
    return _index(spark, d).offset_page("TH", 3)


@query("search_page_keyset", "SELECT level, uri FROM found WHERE level > 1 OR (level = 1 AND uri > 'http://m') ORDER BY level, uri LIMIT 16", FOUND_SQL)
def search_page_keyset(spark, d):
    return _index(spark, d).keyset_page("th", 1, "http://m")


@query("search_grams", "SELECT uri, len(segs) AS level FROM cap WHERE contains(lower(uri), 'example.net/e') GROUP BY ALL")
def search_grams(spark, d):
    """By postings of grams."""
    return _index(spark, d).found("Example.NET/e").select("uri", "level")


@query("search_groups", "SELECT uri, level, count(*) AS n, CAST(coalesce(sum(payload_size), 0) AS BIGINT) AS total_size, min(archived_ts) AS first_ts, max(archived_ts) AS last_ts FROM cap JOIN (SELECT * FROM found ORDER BY level, uri LIMIT 16) USING (uri) GROUP BY uri, level", FOUND_SQL)
def search_groups(spark, d):
    c = captures(spark, d)
    return search.page_groups(c, search.offset_page(c, "th", 1))


@query("search_capped", "SELECT least(count(*), 10001) AS total, count(*) >= 10001 AS capped, CASE WHEN count(*) >= 10001 THEN '10,000+' ELSE CAST(count(*) AS VARCHAR) END AS label FROM found", FOUND_SQL)
def search_capped(spark, d):
    return _index(spark, d).capped_count("th")


@query("search_exact", "SELECT count(*) AS total FROM found", FOUND_SQL)
def search_exact(spark, d):
    return _index(spark, d).exact_count("th")


@query(
    "search_summary",
    "SELECT (SELECT count(*) FROM pg) AS shown, t AS total, t >= 10001 AS capped, 1 AS page, CAST(least(greatest(ceil(t / 16.0), 1), 626) AS INTEGER) AS pages, (SELECT level FROM pg ORDER BY level DESC, uri DESC LIMIT 1) AS next_level, (SELECT uri FROM pg ORDER BY level DESC, uri DESC LIMIT 1) AS next_uri FROM (SELECT least(count(*), 10001) AS t FROM found)",
    FOUND_SQL + ", pg AS (SELECT * FROM found ORDER BY level, uri LIMIT 16)",
)
def search_summary(spark, d):
    return search.search_summary(captures(spark, d), "th")


@query("latest_html", "SELECT custom_id, archived_ts FROM cap WHERE content_type = 'text/html' ORDER BY archived_ts DESC, custom_id LIMIT 8")
def latest_html(spark, d):
    return search.latest(captures(spark, d)).select("custom_id", "archived_ts")


ONE_URI = " one AS (SELECT min(url) AS u FROM pages)"


@query("captures_of_uri", "SELECT custom_id, archived_ts, CAST(row_number() OVER (ORDER BY archived_ts, byte_offset, custom_id) AS INTEGER) AS n FROM cap, one WHERE uri = u", ONE_URI)
def captures_of_uri(spark, d):
    return search.captures_of(captures(spark, d), pages(spark, d).agg(F.min("url")).first()[0]).select("custom_id", "archived_ts", "n")


@query("same_site", "SELECT custom_id FROM cap WHERE uri IN (SELECT uri FROM cap WHERE event_id % 50 = 0)")
def same_site(spark, d):
    c = captures(spark, d)
    return search.same_site(c, c.where("event_id % 50 = 0").select("custom_id")).select("custom_id")  # the stated set of queries


@query(
    "anchors",
    "SELECT uri, pos, base || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS anchor, regexp_replace(regexp_replace(regexp_replace(uri, '^https?://', ''), '#.*$', ''), '/$', '') AS label FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS rn FROM (SELECT url AS uri, page_id AS pos, 'site-' || substr(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS base FROM pages))",
)
def anchors(spark, d):
    return search.anchors(pages(spark, d).select(F.col("url").alias("uri"), F.col("page_id").alias("pos")))


@query(
    "byte_budget",
    "SELECT file_name, count(*) FILTER (used <= 12000) AS included, count(*) FILTER (used > 12000) AS dropped FROM (SELECT file_name, 9 - 1 + sum(1 + 4 + length(url_encode(custom_id))) OVER (PARTITION BY file_name ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM cap) GROUP BY file_name",
)
def byte_budget(spark, d):
    return search.byte_budget(captures(spark, d), "file_name", "custom_id", "event_id")


@query("canonical_urls", "SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, url AS canonical, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages")
def canonical_urls(spark, d):
    odd = F.concat(F.upper(F.regexp_extract("url", "^(https?)", 1)), F.lit("://"), F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/", "/./x/../"))
    default = F.when(F.col("url").startswith("https"), ":443").otherwise(":80")
    odd = F.regexp_replace(odd, "^([A-Z]+://[^/]+)", F.concat(F.lit("$1"), default))
    p = pages(spark, d).withColumn("canonical", U.canonical_url(odd)).withColumn("parts", U.url_parts(F.col("canonical")))
    return p.select("page_id", "parts.scheme", "parts.host", "canonical", "parts.query")


@query("url_forms", "SELECT page_id, url = regexp_replace(url, '#.*$', '') AS bare, CAST(1 + (url LIKE '%#%')::INT AS INTEGER) AS keys, true AS same FROM pages")
def url_forms(spark, d):
    u, bare = F.col("url"), U.without_fragment(F.col("url"))
    return pages(spark, d).select("page_id", (u == bare).alias("bare"), F.size(U.lookup_keys(u)).alias("keys"), U.same_target(u, bare).alias("same"))


@query("slugs", "SELECT page_id, true AS same, url_encode(url) AS slug FROM pages")
def slugs(spark, d):
    slug = U.query_slug(F.col("url"))
    return pages(spark, d).select("page_id", (U.query_from_slug(slug) == F.col("url")).alias("same"), slug.alias("slug"))


ODD_URLS_SQL = r""" web AS (SELECT page_id, regexp_extract(url, '^(https?)', 1) AS s, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p, regexp_extract(url, '([?#].*)?$', 0) AS r FROM pages)"""


@query(
    "odd_urls",
    """SELECT page_id, page_id % 9 <> 7 AS web, CASE page_id % 9
 WHEN 2 THEN s || '://' || h || p || '%C3%A9%20b%7B' || r
 WHEN 3 THEN s || '://xn--bcher-kva.' || h || p || r
 WHEN 4 THEN 'http://10.' || (page_id // 65536) % 256 || '.' || (page_id // 256) % 256 || '.' || page_id % 256 || p
 WHEN 5 THEN 'http://[::' || format('{:x}', page_id % 60000 + 1) || ']' || p
 WHEN 7 THEN s || '://' || h || ':65536' || p
 WHEN 8 THEN s || '://' || h || p || '?q=%27x%20y%22'
 ELSE s || '://' || h || p || r END AS canonical FROM web""",
    ODD_URLS_SQL,
)
def odd_urls(spark, d):
    """Backslashes, escaped dots, letters above ASCII, addresses as hosts, missing slashes, a port too large, quotes."""
    part = lambda e: F.regexp_extract("url", r"^(https?)://([^/?#]+)([^?#]*)(.*)$", e)
    s, h, p, r = (part(i) for i in range(1, 5))
    forms = [
        [s, ":\\\\", h, F.translate(p, "/", "\\"), r],
        [s, "://", h, "/x/%2e%2E", p, r],
        [s, "://", h, p, "é b{", r],
        [s, "://BÜcher.", h, p, r],
        ["http://", (F.lit(10 << 24) + F.col("page_id")).cast("string"), p],
        ["http://[0:0::", F.lpad(F.hex(F.col("page_id") % 60000 + 1), 4, "0"), "]", p],
        [" \t", s, ":", h, p, r],
        [s, "://", h, ":65536", p],
        [s, "://", h, p, "?q='x y\""],
    ]
    odd = F.coalesce(*(F.when(F.col("page_id") % len(forms) == i, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in f))) for i, f in enumerate(forms)))
    p = pages(spark, d).select("page_id", U.canonical_url(odd).alias("canonical"))
    return p.select("page_id", U.url_parts(F.col("canonical")).reason.isNull().alias("web"), "canonical")


@query("same_targets", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN url NOT LIKE '%?%' WHEN 2 THEN false ELSE contains(url, '?') END AS same FROM pages")
def same_targets(spark, d):
    """Another fragment is the same target; no query for a query, another path, one more parameter are not; order of parameters is not looked at."""
    bare = F.regexp_replace("url", "#.*$", "")
    page, search = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    turned = F.concat(page, F.lit("?"), F.array_join(F.reverse(F.split(search, "&")), "&"), F.when(search == "", "z=1").otherwise(""))
    other = F.when(F.col("page_id") % 4 == 0, F.concat(bare, F.lit("#other"))).when(F.col("page_id") % 4 == 1, page).when(F.col("page_id") % 4 == 2, F.concat(page, F.lit("/x"))).otherwise(turned)
    return pages(spark, d).select("page_id", U.same_target(F.col("url"), other).alias("same"))


@query("odd_slugs", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '%2561ll' WHEN 1 THEN '%252E' WHEN 2 THEN '%252E%252E' WHEN 3 THEN url_encode(url_encode('100% ' || url)) ELSE url_encode(url) END AS slug,
 CASE page_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN '.' WHEN 2 THEN '..' WHEN 3 THEN '100% ' || url ELSE url END AS back FROM pages""")
def odd_slugs(spark, d):
    """Texts whose slugs would clash with reserved ones, hold percent signs or blanks around them, and the texts read back."""
    k = F.col("page_id") % 5
    text = F.when(k == 0, "all").when(k == 1, ".").when(k == 2, "..").when(k == 3, F.concat(F.lit("100% "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    slug = U.query_slug(text)
    return pages(spark, d).select("page_id", slug.alias("slug"), U.query_from_slug(slug).alias("back"))


@query("export_names", "SELECT custom_id, regexp_replace(regexp_replace(regexp_replace(rtrim(concat_ws('-', regexp_replace(host, '^www[.]', ''), nullif(array_to_string(segs, '-'), '')), '') || '-' || uuid, '[<>:\"|?*\\\\/]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') || '.zip' AS name FROM cap")
def export_names(spark, d):
    return captures(spark, d).select("custom_id", U.export_name(F.col("uri"), F.col("uuid")).alias("name"))


# --- lookups in time, revisits, redirects

RESOLVE_SQL = """ donors AS (SELECT * FROM cap WHERE rec_type <> 'revisit' AND payload_size IS NOT NULL),
 rev AS (SELECT * FROM cap WHERE rec_type = 'revisit'),
 by_digest AS (SELECT * FROM (SELECT r.custom_id AS id, d.*, row_number() OVER (PARTITION BY r.custom_id ORDER BY abs(epoch_us(d.archived_ts) - epoch_us(r.archived_ts)), d.file_name, d.byte_offset, d.custom_id) AS rn FROM rev r JOIN donors d ON d.digest = r.digest) WHERE rn = 1),
 by_uri AS (SELECT * FROM (SELECT r.custom_id AS id, d.*, row_number() OVER (PARTITION BY r.custom_id ORDER BY abs(epoch_us(d.archived_ts) - epoch_us(coalesce(r.refers_to_date, r.archived_ts))), d.file_name, d.byte_offset, d.custom_id) AS rn FROM rev r JOIN donors d ON d.uri = r.refers_to_uri WHERE r.custom_id NOT IN (SELECT id FROM by_digest)) WHERE rn = 1),
 donor AS (SELECT *, 'digest' AS via FROM by_digest UNION ALL SELECT *, 'uri' AS via FROM by_uri),
 shown AS (
  SELECT uri, file_name, byte_offset, custom_id, archived_ts, status, location, payload_size, content_type, target FROM cap WHERE rec_type = 'response' AND (payload_size IS NOT NULL OR target IS NOT NULL)
  UNION ALL
  SELECT r.uri, d.file_name, r.byte_offset, r.custom_id, r.archived_ts, d.status, d.location, d.payload_size, CASE WHEN r.content_type <> '' THEN r.content_type ELSE d.content_type END,
   CASE WHEN d.status IN (301, 302, 303, 307, 308) THEN CASE WHEN d.location LIKE '/%' THEN r.origin || d.location ELSE d.location END END
  FROM rev r JOIN donor d ON d.id = r.custom_id),
 groups AS (SELECT DISTINCT uri FROM cap)"""


@query("revisit_resolution", "SELECT r.custom_id, d.custom_id AS donor_id, d.file_name AS donor_file, d.payload_size AS payload_size, d.via FROM rev r LEFT JOIN donor d ON d.id = r.custom_id", RESOLVE_SQL)
def revisit_resolution(spark, d):
    r = resolve.resolve_revisits(captures(spark, d))
    return r.select("custom_id", F.col("donor.custom_id").alias("donor_id"), F.col("donor.file_name").alias("donor_file"), F.col("donor.payload_size").alias("payload_size"), "via")


@query(
    "revisit_rate",
    "SELECT 'all files' AS scope, count(*) AS revisits, count(*) FILTER (custom_id IN (SELECT id FROM donor)) AS resolved FROM rev UNION ALL SELECT 'own file', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM donors d WHERE d.file_name = rev.file_name AND (d.digest = rev.digest OR d.uri = rev.refers_to_uri))) FROM rev",
    RESOLVE_SQL,
)
def revisit_rate(spark, d):
    return resolve.revisit_rate(captures(spark, d))


def lookups(spark: SparkSession, d: str) -> DataFrame:
    """A lookup for every event: some page, with or without a fragment, at the event's time; and URLs that are not held."""
    p = pages(spark, d)
    times = events(spark, d).select("event_id", F.col("ts").alias("near"), ((F.col("event_id") * 13 + 5) % F.lit(p.count())).alias("page_id"))
    held = times.join(p.select("page_id", "url"), "page_id")
    url = F.when(F.col("event_id") % 3 == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#part"))).when(F.col("event_id") % 11 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url"))
    return held.select(F.col("event_id").cast("string").alias("lookup_id"), url.alias("url"), "near")


LOOKUP_SQL = """ lk AS (SELECT CAST(e.event_id AS VARCHAR) AS lookup_id, CASE WHEN e.event_id % 3 = 0 THEN regexp_replace(p.url, '#.*$', '') || '#part' WHEN e.event_id % 11 = 0 THEN p.url || 'x' ELSE p.url END AS url, e.ts AS near FROM events e, np JOIN pages p ON p.page_id = (e.event_id * 13 + 5) % np.n)"""


def _hop_sql(n: int, start: str, follow: int, stop: str = "false") -> str:
    """One unrolled hop: h{n} from the open rows of the one before."""
    return f""" k{n} AS (SELECT lookup_id, near, seen, url, CASE WHEN url IN (SELECT uri FROM groups) THEN url WHEN regexp_replace(url, '#.*$', '') IN (SELECT uri FROM groups) THEN regexp_replace(url, '#.*$', '') END AS key FROM {start}),
 f{n} AS (SELECT * FROM (SELECT k.lookup_id AS lid, s.*, row_number() OVER (PARTITION BY k.lookup_id ORDER BY abs(epoch_us(s.archived_ts) - epoch_us(k.near)), s.file_name, s.byte_offset, s.custom_id) AS rn FROM k{n} k JOIN shown s ON s.uri = k.key) WHERE rn = 1),
 h{n} AS (SELECT k.*, f.custom_id, f.status, f.location, f.target, f.payload_size, f.content_type, CASE WHEN key IS NULL THEN 'not-archived' WHEN f.custom_id IS NULL THEN 'no-payload' WHEN list_contains(seen, f.custom_id) THEN 'loop' WHEN f.target IS NULL OR ({stop} AND f.payload_size >= 1) THEN 'hit' WHEN {n} = {follow} THEN 'limit' ELSE 'open' END AS state FROM k{n} k LEFT JOIN f{n} f ON f.lid = k.lookup_id),
 o{n} AS (SELECT lookup_id, target AS url, near, list_append(seen, custom_id) AS seen FROM h{n} WHERE state = 'open')"""


def _chain_sql(follow: int = 5, stop: str = "false", source: str = "lk") -> str:
    first = f" s0 AS (SELECT lookup_id, url, near, CAST([] AS VARCHAR[]) AS seen FROM {source}),"
    hops = ",".join(_hop_sql(i, f"o{i - 1}" if i else "s0", follow, stop) for i in range(follow + 1))
    final = " UNION ALL ".join(
        f"SELECT lookup_id, CASE WHEN state IN ('loop', 'limit') THEN 'redirect' ELSE state END AS outcome, CASE WHEN state = 'hit' THEN custom_id END AS custom_id, CAST({i} + (state = 'limit')::INT AS INTEGER) AS hops, CASE WHEN state = 'limit' THEN target ELSE url END AS final_url, CASE WHEN state = 'hit' THEN target END AS redirects_to, CASE WHEN state = 'hit' THEN content_type END AS content_type, CASE WHEN state = 'hit' THEN payload_size END AS payload_size, CASE WHEN state = 'hit' THEN status END AS status FROM h{i} WHERE state <> 'open'"
        for i in range(follow + 1)
    )
    listing = " UNION ALL ".join(f"SELECT lookup_id, {i} AS hop, url, custom_id, status, location, target AS resolved FROM h{i} WHERE state NOT IN ('not-archived', 'no-payload')" for i in range(follow + 1))
    return f"{first}{hops}, final AS ({final}), hops AS ({listing})"


FINAL = ("lookup_id", "outcome", "custom_id", "hops", "final_url", "redirects_to")


SHOWN: dict[tuple[str, str], asof.TimeIndex] = {}


def _shown(spark: SparkSession, d: str) -> asof.TimeIndex:
    """The time index of what lookups may end at, written once for a session and input."""
    key = (spark.sparkContext.applicationId, d)
    if key not in SHOWN:
        c = captures(spark, d)
        SHOWN[key] = asof.keyed_time_index(resolve.candidates(c), c.select("uri").where("uri <> ''").distinct())
    return SHOWN[key]


@query("time_index", "SELECT uri, count(DISTINCT archived_ts) AS moments, min(archived_ts) AS first_ts, max(archived_ts) AS last_ts FROM shown GROUP BY uri", RESOLVE_SQL)
def time_index(spark, d):
    """The index itself: the distinct moments of every URL."""
    at = _shown(spark, d).leaves.select(F.col("__key").alias("uri"), F.explode("__moments").alias("us")).distinct()
    ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return at.groupBy("uri").agg(F.count("*").alias("moments"), ts(F.min("us")).alias("first_ts"), ts(F.max("us")).alias("last_ts"))


@query("nearest_capture", "SELECT lookup_id, url, f.custom_id, f.archived_ts FROM lk LEFT JOIN (SELECT * FROM (SELECT l.lookup_id AS lid, s.*, row_number() OVER (PARTITION BY l.lookup_id ORDER BY abs(epoch_us(s.archived_ts) - epoch_us(l.near)), s.file_name, s.byte_offset, s.custom_id) AS rn FROM lk l JOIN shown s ON s.uri = l.url) WHERE rn = 1) f ON f.lid = lookup_id", RESOLVE_SQL + "," + LOOKUP_SQL)
def nearest_capture(spark, d):
    found = asof.nearest(lookups(spark, d).withColumn("key", F.col("url")), _shown(spark, d))
    return found.select("lookup_id", "url", F.col("hit.custom_id").alias("custom_id"), F.col("hit.archived_ts").alias("archived_ts"))


@query("newest_capture", "SELECT url, arg_max(custom_id, archived_ts) AS custom_id FROM (SELECT DISTINCT url FROM lk) JOIN (SELECT uri, archived_ts, arg_min(custom_id, (file_name, byte_offset, custom_id)) AS custom_id FROM shown GROUP BY ALL) ON uri = url GROUP BY url", RESOLVE_SQL + "," + LOOKUP_SQL)
def newest_capture(spark, d):
    """Lookups without a date take the newest capture."""
    asked = lookups(spark, d).select("url").distinct().select("url", F.col("url").alias("lookup_id"), F.col("url").alias("key"), F.lit(None).cast("timestamp_ntz").alias("near"))
    return asof.nearest(asked, _shown(spark, d)).where("hit IS NOT NULL").select("url", F.col("hit.custom_id").alias("custom_id"))


@query("nearest_by_keys", "SELECT lookup_id, key, custom_id, CASE WHEN state IN ('not-archived', 'no-payload') THEN state ELSE 'hit' END AS outcome FROM h0", RESOLVE_SQL + "," + LOOKUP_SQL + "," + _chain_sql(0))
def nearest_by_keys(spark, d):
    c = captures(spark, d)
    found = asof.nearest_by_keys(lookups(spark, d), c.select("uri").distinct(), _shown(spark, d))
    return found.select("lookup_id", "key", F.col("hit.custom_id").alias("custom_id"), "outcome")


@query("redirect_final", f"SELECT {', '.join(FINAL)} FROM final", RESOLVE_SQL + "," + LOOKUP_SQL + "," + _chain_sql())
def redirect_final(spark, d):
    return resolve.follow_redirects(lookups(spark, d), captures(spark, d), shown=_shown(spark, d))[0].select(*FINAL)


@query("redirect_hops", "SELECT * FROM hops", RESOLVE_SQL + "," + LOOKUP_SQL + "," + _chain_sql())
def redirect_hops(spark, d):
    return resolve.follow_redirects(lookups(spark, d), captures(spark, d), shown=_shown(spark, d))[1]


@query("redirect_stop_bodied", f"SELECT {', '.join(FINAL)} FROM final", RESOLVE_SQL + "," + LOOKUP_SQL + "," + _chain_sql(5, "true"))
def redirect_stop_bodied(spark, d):
    return resolve.follow_redirects(lookups(spark, d), captures(spark, d), stop_at_body=True, shown=_shown(spark, d))[0].select(*FINAL)


@query("one_hop", "SELECT lookup_id AS custom_id, url AS target, h0.custom_id AS target_id FROM h0", RESOLVE_SQL + ", mv AS (SELECT custom_id AS lookup_id, target AS url, archived_ts AS near FROM cap WHERE rec_type = 'response' AND target IS NOT NULL)," + _chain_sql(0, source="mv"))
def one_hop(spark, d):
    return resolve.one_hop(captures(spark, d), _shown(spark, d))


@query("from_page", "SELECT lookup_id, outcome, custom_id FROM final", RESOLVE_SQL + """, fp AS (SELECT p.page_id AS lookup_id, p.url, q.url AS from_url FROM pages p JOIN pages q ON q.page_id = p.page_id + 1),
 d0 AS (SELECT f.lookup_id, CAST('2100-01-01' AS TIMESTAMP) AS near, f.from_url AS url FROM fp f),""" + _chain_sql(source="d0").replace("final AS", "page_final AS").replace("hops AS (", "page_hops AS (") + """, fp2 AS (SELECT CAST(f.lookup_id AS VARCHAR) AS lookup_id, f.url, coalesce(s.archived_ts, CAST('2024-02-01' AS TIMESTAMP)) AS near FROM fp f LEFT JOIN page_final pf ON pf.lookup_id = f.lookup_id LEFT JOIN shown s ON s.custom_id = pf.custom_id),""" + re.sub(r"\b([skfho])(\d)\b", r"\1\g<2>b", _chain_sql(source="fp2")))
def from_page(spark, d):
    p, q = pages(spark, d), pages(spark, d)
    asked = p.join(q.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("from_url")), "page_id").select(F.col("page_id").cast("string").alias("lookup_id"), "url", "from_url")
    c = captures(spark, d)
    return resolve.from_page(asked, c, _shown(spark, d), F.lit("2024-02-01").cast("timestamp_ntz"))[0].select("lookup_id", "outcome", "custom_id")


@query("request_pairs", "SELECT r.custom_id, r.uuid, count(q.custom_id) AS requests, count(q.custom_id) > 0 AS has_request, coalesce(r.status BETWEEN 300 AND 399, false) AS redirect FROM cap r LEFT JOIN cap q ON q.rec_type = 'request' AND q.concurrent_uuid = r.uuid WHERE r.rec_type = 'response' GROUP BY r.custom_id, r.uuid, r.status")
def request_pairs(spark, d):
    return resolve.request_pairs(captures(spark, d))


# --- trees

NODES_SQL = """ x{0} AS (SELECT unnest(path) AS node, generate_subscripts(path, 1) - 1 AS depth, len(path) AS size FROM tree{0}),
 y{0} AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth, CAST(count(*) FILTER (depth = size - 1) AS BIGINT) AS records FROM x{0} GROUP BY node),
 z{0} AS (SELECT *, CASE WHEN contains(node, '?') THEN split_part(node, '?', 1) WHEN depth = 0 THEN NULL WHEN depth = 1 THEN regexp_replace(node, '[^/]*$', '') ELSE regexp_replace(node, '/[^/]*$', '') END AS parent FROM y{0}),
 nodes{0} AS (SELECT *, CASE WHEN parent IS NULL THEN regexp_replace(regexp_replace(node, '^[^/]*://', ''), '/$', '') WHEN contains(node, '?') THEN regexp_extract(node, '([?].*)$', 1) ELSE regexp_extract(node, '([^/]*)$', 1) END AS segment, coalesce((SELECT count(*) FROM z{0} c WHERE c.parent = z{0}.node), 0) AS children FROM z{0})"""
NODES = "node, depth, records, parent, segment, children"


@query("tree_nodes_raw", f"SELECT {NODES} FROM nodesd", PATH_SQL + "," + NODES_SQL.format("d"))
def tree_nodes_raw(spark, d):
    return tree.nodes(captures(spark, d))


@query("tree_nodes_normal", f"SELECT {NODES} FROM nodesn", PATH_SQL + "," + NODES_SQL.format("n"))
def tree_nodes_normal(spark, d):
    return tree.nodes(captures(spark, d), True)


@query("tree_segments", "SELECT segment, count(*) AS nodes FROM nodesd GROUP BY segment", PATH_SQL + "," + NODES_SQL.format("d"))
def tree_segments(spark, d):
    return tree.segments(tree.nodes(captures(spark, d)))


FILTER_SQL = NODES_SQL.format("d") + """, m AS (SELECT node FROM nodesd WHERE contains(lower(segment), 'page=2') INTERSECT SELECT path[len(path)] FROM treed WHERE content_type = 'text/html'),
 kept AS (SELECT node, bool_or(node = me) AS matched FROM (SELECT DISTINCT unnest(path) AS node, path[len(path)] AS me FROM treed WHERE path[len(path)] IN (SELECT node FROM m)) GROUP BY node)"""

#: A node's way from its root, with the natural key of each segment.
ORDER_SQL = """ way AS (SELECT DISTINCT path[d + 1] AS node, path[1:d + 1] AS steps FROM (SELECT path, unnest(range(len(path))) AS d FROM treed)),
 bit AS (SELECT node, list_transform(steps, lambda u: {'k': array_to_string(list_transform(regexp_extract_all(lower(regexp_extract(regexp_replace(u, '/$', ''), '([^/]*)$', 1)), '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(regexp_replace(p, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+([0-9])', '\\1') ELSE p END), ''), 'u': u}) AS sort_key FROM way)"""


@query("tree_filter", "SELECT node, matched FROM kept", PATH_SQL + "," + FILTER_SQL)
def tree_filter(spark, d):
    c = captures(spark, d)
    t = tree.nodes(c)
    return tree.tree_filter(t, tree.intersect(tree.find_segments(t, "PAGE=2"), tree.find_type(c, "text/html")))


@query("tree_rows", "SELECT k.node, depth, records, row_number() OVER (ORDER BY sort_key) - 1 AS pos FROM kept k JOIN nodesd USING (node) JOIN bit USING (node)", PATH_SQL + "," + FILTER_SQL + "," + ORDER_SQL)
def tree_rows(spark, d):
    c = captures(spark, d)
    t = stored(tree.nodes(c), "nodes")
    kept = tree.tree_filter(t, tree.intersect(tree.find_segments(t, "page=2"), tree.find_type(c, "text/html")))
    return tree.numbered(tree.visible_rows(t, None, kept)).select("node", "depth", "records", "pos")


@query("tree_open", "SELECT node, depth, records, row_number() OVER (ORDER BY sort_key) - 1 AS pos FROM nodesd JOIN bit USING (node) WHERE depth <= 1", PATH_SQL + "," + NODES_SQL.format("d") + "," + ORDER_SQL)
def tree_open(spark, d):
    """All roots opened, nothing below."""
    t = stored(tree.nodes(captures(spark, d)), "nodes")
    return tree.numbered(tree.visible_rows(t, t.where("parent IS NULL").select("node"))).select("node", "depth", "records", "pos")


@query("tree_positions", "SELECT node, depth, row_number() OVER (ORDER BY sort_key) - 1 AS pos FROM nodesd JOIN bit USING (node)", PATH_SQL + "," + NODES_SQL.format("d") + "," + ORDER_SQL)
def tree_positions(spark, d):
    """All nodes in the order of an open tree."""
    return tree.numbered(tree.visible_rows(tree.nodes(captures(spark, d)))).select("node", "depth", "pos")


@query("untreed", "SELECT rec_type, 'not-a-web-url' AS reason, count(*) AS n, false AS expected FROM cap WHERE event_id % 7 = 0 GROUP BY rec_type UNION ALL SELECT rec_type, 'no url', count(*), false FROM cap WHERE event_id % 7 = 1 GROUP BY rec_type UNION ALL SELECT rec_type, 'unparseable', count(*), false FROM cap WHERE event_id % 7 = 2 GROUP BY rec_type")
def untreed(spark, d):
    i = F.col("event_id") % 7
    c = captures(spark, d).withColumn("uri", F.when(i == 0, F.concat(F.lit("dns:"), F.regexp_replace("uri", "^https?://([^/]+).*$", "$1"))).when(i == 1, "").when(i == 2, F.regexp_replace("uri", "^https?://", "")).otherwise(F.col("uri")))
    return tree.untreed(c)


@query("search_loaded", "SELECT uri, count(*) AS n, max(archived_ts) AS newest_ts, arg_max(content_type, (archived_ts, custom_id)) AS content_type FROM treed WHERE rec_type = 'response' AND path[len(path)] IN (SELECT node FROM nodesd WHERE contains(lower(segment), 'utm')) GROUP BY uri ORDER BY n DESC, uri LIMIT 25", PATH_SQL + "," + NODES_SQL.format("d"))
def search_loaded(spark, d):
    c = captures(spark, d)
    return tree.search_loaded(c, tree.nodes(c), "utm")


@query("search_fallback", "SELECT uri, count(*) AS n, max(archived_ts) AS newest_ts, arg_max(content_type, (archived_ts, custom_id)) AS content_type FROM cap WHERE rec_type = 'response' AND contains(lower(uri), '.com/en') GROUP BY uri ORDER BY n DESC, uri LIMIT 25")
def search_fallback(spark, d):
    c = captures(spark, d)
    return tree.search_loaded(c, tree.nodes(c), ".com/en")


# --- references and exports

REFS_SQL = RESOLVE_SQL + """, r0 AS (SELECT url AS page_uri, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS ref, generate_subscripts(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
 r1 AS (SELECT page_uri, CAST(min(pos) AS INTEGER) AS pos, regexp_extract(page_uri, '^(https?://[^/?#]+)', 1) || array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END FOR c IN string_split(ref, '')], '') AS target FROM r0 WHERE ref <> '' GROUP BY ALL)"""


def _resolved_refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References of every page, a third of them bent to held pages, resolved at the page's newest date."""
    c = captures(spark, d)
    n = pages(spark, d).count()
    found = refs.page_refs(pages(spark, d))
    held = pages(spark, d).select(F.col("page_id").alias("__to"), F.col("url").alias("__url"))
    bent = found.withColumn("__to", F.when(F.col("pos") % 3 == 0, (F.length("page_uri") * 13 + F.length("ref") * 7) % n)).join(held, "__to", "left")
    dates = c.groupBy("uri").agg(F.max("archived_ts").alias("near"))
    return refs.resolve_refs(bent.withColumn("target", F.coalesce("__url", "target")), c, dates, _shown(spark, d)), c


BENT_SQL = RESOLVE_SQL + """, r0 AS (SELECT url AS page_uri, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS ref, generate_subscripts(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
 r1 AS (SELECT r0.page_uri, CAST(min(pos) AS INTEGER) AS pos, coalesce(p.url, regexp_extract(page_uri, '^(https?://[^/?#]+)', 1) || array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END FOR c IN string_split(ref, '')], '')) AS target FROM r0 CROSS JOIN np LEFT JOIN pages p ON pos % 3 = 0 AND p.page_id = (length(page_uri) * 13 + length(ref) * 7) % np.n WHERE ref <> '' GROUP BY ALL),
 r2 AS (SELECT page_uri, target, min(pos) AS pos FROM r1 GROUP BY ALL),
 dates AS (SELECT uri, max(archived_ts) AS near FROM cap GROUP BY uri),
 rl AS (SELECT page_uri || ' ' || target AS lookup_id, target AS url, near, page_uri, pos FROM r2 JOIN dates ON dates.uri = page_uri),""" + _chain_sql(source="rl") + ", res AS (SELECT rl.page_uri, rl.url AS target, rl.pos, final.* FROM rl JOIN final USING (lookup_id))"


@query("page_refs", "SELECT page_uri, CAST(pos AS INTEGER) AS pos, ref, regexp_extract(page_uri, '^(https?://[^/?#]+)', 1) || array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END FOR c IN string_split(ref, '')], '') AS target FROM r0", REFS_SQL)
def page_refs(spark, d):
    return refs.page_refs(pages(spark, d))


@query("page_refs_all", "SELECT page_uri, CAST(pos AS INTEGER) AS pos, ref, regexp_extract(page_uri, '^(https?://[^/?#]+)', 1) || array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END FOR c IN string_split(ref, '')], '') AS target FROM r0", REFS_SQL)
def page_refs_all(spark, d):
    """References of every page."""
    return refs.page_refs(pages(spark, d))


@query("missing_refs", "SELECT page_uri, target, pos, CASE WHEN outcome <> 'hit' THEN outcome ELSE 'error-status' END AS reason FROM res WHERE outcome <> 'hit' OR status >= 400", BENT_SQL)
def missing_refs(spark, d):
    return refs.missing_refs(_resolved_refs(spark, d)[0])


@query("missing_refs_all", "SELECT page_uri, target, pos, CASE WHEN outcome <> 'hit' THEN outcome ELSE 'error-status' END AS reason FROM res WHERE outcome <> 'hit' OR status >= 400", BENT_SQL)
def missing_refs_all(spark, d):
    return refs.missing_refs(_resolved_refs(spark, d)[0])


@query("resolved_refs", "SELECT page_uri, target AS asked, final_url AS served, custom_id, coalesce(status, 200) AS status, coalesce(nullif(content_type, ''), 'application/octet-stream') AS content_type, coalesce(payload_size, 0) AS bytes, hops, false AS differs FROM res WHERE outcome = 'hit'", BENT_SQL)
def resolved_refs(spark, d):
    return refs.resolved_refs(_resolved_refs(spark, d)[0])


@query(
    "notices_top",
    "SELECT target AS url, reason, spot.p AS page_uri, spot.k AS pos FROM (SELECT target, reason, min({'p': page_uri, 'k': pos}) AS spot FROM (SELECT page_uri, target, pos, CASE WHEN outcome <> 'hit' THEN outcome ELSE 'error-status' END AS reason FROM res WHERE outcome <> 'hit' OR status >= 400) GROUP BY ALL) ORDER BY page_uri DESC, pos DESC, url, reason LIMIT 500",
    BENT_SQL,
)
def notices_top(spark, d):
    return refs.notices(refs.missing_refs(_resolved_refs(spark, d)[0]))


@query(
    "export_manifest",
    """SELECT page_uri, target, pos, custom_id, CASE WHEN twins > 1 THEN path || '-' || split_part(custom_id, '::', 3) ELSE path END AS entry,
 CASE WHEN outcome <> 'hit' THEN 'missing' WHEN merged THEN 'merged' WHEN NOT inside THEN 'limit' WHEN redirects_to IS NOT NULL OR coalesce(status BETWEEN 300 AND 399, false) THEN 'redirect-stub' WHEN twins > 1 THEN 'path-collision' END AS notice, inside AS included
 FROM (SELECT *, count(path) OVER (PARTITION BY page_uri, path) AS twins FROM (SELECT *, take AND n <= 5 AND bytes <= 20000 AS inside,
   CASE WHEN take THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(final_url, '^https?://', ''), '#.*$', ''), '/$', ''), '[<>:"|?*]', '-', 'g') END AS path
  FROM (SELECT *, sum(take::INT) OVER w AS n, sum(CASE WHEN take THEN coalesce(payload_size, 0) ELSE 0 END) OVER w AS bytes FROM (SELECT *, outcome = 'hit' AND NOT merged AS take FROM (
   SELECT *, outcome = 'hit' AND row_number() OVER (PARTITION BY page_uri, custom_id ORDER BY pos, target) > 1 AS merged FROM res)) WINDOW w AS (PARTITION BY page_uri ORDER BY pos, target ROWS UNBOUNDED PRECEDING))))""",
    BENT_SQL,
)
def export_manifest(spark, d):
    return refs.export_manifest(_resolved_refs(spark, d)[0], 5, 20000)


@query("site_index", "SELECT host, max(archived_ts) AS newest_ts, host AS slug FROM cap JOIN (SELECT DISTINCT uri, len(segs) AS level FROM cap ORDER BY level, uri LIMIT 500) USING (uri) GROUP BY host")
def site_index(spark, d):
    return refs.site_index(captures(spark, d))


# --- progress and streams

PROGRESS_SQL = """ rep AS (SELECT 'f' || (event_id % 8) AS file_name, CAST(event_id % 4 AS INTEGER) AS segment, (event_id % 4) * 1000 + event_id % 1200 AS place, event_id % 50 AS records, event_id % 20 AS responses, event_id % 97 = 0 AS done FROM events),
 seg AS (SELECT f.file_name, CAST(s AS INTEGER) AS segment, s * 1000 AS st, s * 1000 + 1000 AS en FROM (SELECT 'f' || unnest(range(0, 8)) AS file_name) f, (SELECT unnest(range(0, 3)) AS s)),
 best AS (SELECT file_name, segment, max(place) AS place, max(records) AS records, max(responses) AS responses, max(done) AS done FROM rep GROUP BY ALL),
 files AS (SELECT file_name, CAST(sum(least(greatest(coalesce(place, st), st), en) - st) AS BIGINT) AS bytes, CAST(sum(en - st) AS BIGINT) AS size, CAST(sum(coalesce(records, 0)) AS BIGINT) AS records, CAST(sum(coalesce(responses, 0)) AS BIGINT) AS responses, min(coalesce(done, false)) AS done FROM seg LEFT JOIN best USING (file_name, segment) GROUP BY file_name)"""
PROGRESS = "SELECT *, CASE WHEN done THEN 100 ELSE least(CAST(floor(100.0 * bytes / size) AS INTEGER), 99) END AS percent FROM files"


def _reports(rows: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return rows.select(F.concat(F.lit("f"), (i % 8).cast("string")).alias("file_name"), (i % 4).cast("int").alias("segment"), ((i % 4) * 1000 + i % 1200).alias("at"), (i % 50).alias("records"), (i % 20).alias("responses"), (i % 97 == 0).alias("done"))


def _segments(spark: SparkSession) -> DataFrame:
    """Segments 0 to 2 of 8 files; reports for segment 3 are unknown."""
    return spark.range(24).select(F.concat(F.lit("f"), (F.col("id") % 8).cast("string")).alias("file_name"), F.expr("CAST(id DIV 8 AS INT)").alias("segment"), F.expr("(id DIV 8) * 1000").alias("start"), F.expr("(id DIV 8) * 1000 + 1000").alias("end"))


@query("segment_progress", PROGRESS, PROGRESS_SQL)
def segment_progress(spark, d):
    return stats.segment_progress(_reports(events(spark, d)), _segments(spark))


def _stream(spark: SparkSession, rows: DataFrame, batches: int = 4) -> tuple[DataFrame, str]:
    """The rows as files of a stream, dealt at random but fixed places; a micro-batch has a file for each core, so that no task writes or reads all of it."""
    files = spark.sparkContext.defaultParallelism
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    typed = rows.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes))
    typed.repartition(batches * files, F.xxhash64("event_id")).write.parquet(f"{at}/in")
    return spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in"), at


@query("stream_dedup_totals", "SELECT count(*) AS records, count(*) FILTER (rec_type = 'response') AS responses FROM ded", DEDUP_SQL)
def stream_dedup_totals(spark, d):
    rows, at = _stream(spark, captures_raw(spark, d).drop("headers"))
    return C.totals(live.drain(live.deduped(rows), "append", None, at))


@query("stream_newest", "SELECT uri, max(archived_ts) AS last_archived_ts FROM cap GROUP BY uri")
def stream_newest(spark, d):
    rows, at = _stream(spark, captures_raw(spark, d).drop("headers"))
    return live.drain(live.live_newest(rows), "update", ["uri"], at).withColumn("last_archived_ts", F.col("last_archived_ts").cast("timestamp_ntz"))


@query("stream_progress", PROGRESS, PROGRESS_SQL)
def stream_progress(spark, d):
    rows, at = _stream(spark, events(spark, d))
    seen = live.drain(live.live_progress(_reports(rows)), "update", ["file_name", "segment"], at)
    return live.progress_of_files(seen, _segments(spark))


@query("stream_timeline", "SELECT strftime(archived_ts, '%Y-%m-%d') AS day, count(*) AS n FROM cap GROUP BY 1")
def stream_timeline(spark, d):
    rows, at = _stream(spark, captures(spark, d).drop("headers"))
    return live.drain(live.live_timeline(rows), "update", ["day"], at)


@query("stream_changed_nodes", "SELECT path[len(path)] AS node, count(*) AS records FROM treed GROUP BY 1", PATH_SQL)
def stream_changed_nodes(spark, d):
    rows, at = _stream(spark, captures(spark, d).drop("headers"))
    return live.drain(live.live_nodes(rows), "update", ["node"], at)


@query("stream_totals", "SELECT count(*) AS records, count(*) FILTER (rec_type = 'response') AS responses FROM cap")
def stream_totals(spark, d):
    rows, at = _stream(spark, captures(spark, d).drop("headers"))
    return live.drain(live.live_totals(rows), "complete", None, at)


@query("stream_newest_host", "SELECT regexp_replace(host, '^www[.]', '') AS host, max(archived_ts) AS last_archived_ts FROM cap GROUP BY 1")
def stream_newest_host(spark, d):
    rows, at = _stream(spark, captures(spark, d).drop("headers"))
    return live.drain(live.live_newest_host(rows), "update", ["host"], at).withColumn("last_archived_ts", F.col("last_archived_ts").cast("timestamp_ntz"))


@query("stream_notices", "SELECT uri AS target, CASE WHEN status >= 400 THEN 'error-status' ELSE 'no-payload' END AS reason, min(event_id) AS event_id FROM cap WHERE status >= 400 OR (rec_type = 'response' AND payload_size IS NULL) GROUP BY ALL")
def stream_notices(spark, d):
    """All distinct notices with their first event; none is trimmed."""
    c = captures(spark, d).where("status >= 400 OR (rec_type = 'response' AND payload_size IS NULL)")
    reason = F.when(F.col("status") >= 400, "error-status").otherwise("no-payload")
    rows, at = _stream(spark, c.select(F.col("uri").alias("target"), reason.alias("reason"), "event_id"))
    return live.live_notices(rows, at, "event_id", keep=None)


@query("stream_late_revisits", "SELECT r.custom_id, d.custom_id AS donor_id, d.file_name AS donor_file, d.payload_size AS payload_size, d.via FROM rev r JOIN donor d ON d.id = r.custom_id", RESOLVE_SQL)
def stream_late_revisits(spark, d):
    rows, at = _stream(spark, captures(spark, d).drop("headers"))
    found = live.late_revisits(rows, at)
    return found.select("custom_id", F.col("donor.custom_id").alias("donor_id"), F.col("donor.file_name").alias("donor_file"), F.col("donor.payload_size").alias("payload_size"), "via")


# --- sources


def _as_records(spark: SparkSession, d: str) -> DataFrame:
    """The captures as the text of WARC records, one a row, with whole payloads."""
    c = captures(spark, d)
    nl = F.lit("\r\n")
    line = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, nl)).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 "), F.coalesce("status", F.lit(200)).cast("string"), F.lit(" Ok"), nl, line("Content-Type", F.col("content_type_raw")), line("Location", F.col("location")), nl, F.repeat(F.lit("x"), F.coalesce("payload_size", F.lit(0)).cast("int")))
    body = F.when(F.col("rec_type") == "response", http).otherwise("")
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("rec_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("uuid"), F.lit(">"))),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Date", F.date_format("archived_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.col("digest")),
        line("Content-Type", F.when(F.col("rec_type") == "response", F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        nl,
        body,
    )
    return c.select(record.alias("value"))


def _as_warc(spark: SparkSession, d: str) -> str:
    """Plain WARC files, written by Spark."""
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    _as_records(spark, d).write.option("lineSep", "\r\n\r\n").text(at)
    return at


def _as_members(spark: SparkSession, d: str, container: bool) -> str:
    """Files of a gzip member a record, or containers with two stored archives each; a task writes the same file again if it runs again."""
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    _as_records(spark, d).limit(0).write.text(at)  # makes the folder

    def run(batches):
        import gzip
        import io
        import zipfile

        from pyarrow import RecordBatch, array
        from pyspark import TaskContext

        from stratarc.sources.warc import created

        halves = [io.BytesIO(), io.BytesIO()]
        for b in batches:
            for k, v in enumerate(b.column(0).to_pylist()):
                halves[k % 2].write(gzip.compress(v.encode() + b"\r\n\r\n", 1))
        name = f"{at}/part-{TaskContext.get().partitionId()}"
        if container:
            with created(f"{name}.wacz") as f, zipfile.ZipFile(f, "w") as z:
                for k, h in enumerate(halves):
                    z.writestr(f"archive/{k}.warc.gz", h.getvalue())
        else:
            with created(f"{name}.warc.gz") as f:
                f.write(b"".join(h.getvalue() for h in halves))
        yield RecordBatch.from_arrays([array([name])], names=["name"])

    files = max(4, captures(spark, d).count() // 50_000)  # a task holds its file
    _as_records(spark, d).repartition(files).mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
    return at


def _scanned(spark: SparkSession, at: str) -> DataFrame:
    from stratarc.sources.warc import ACCEPTED, read_warc

    return read_warc(spark, at, names=rf"{ACCEPTED}|\.txt$", splitFrom=200_000, splitFloor=100_000)


SCANNED_SQL = "SELECT uuid, uri AS url, rec_type, digest, content_type, CASE WHEN rec_type = 'response' THEN coalesce(status, 200) END AS status, CASE WHEN rec_type = 'response' THEN nullif(coalesce(payload_size, 0), 0) END AS size FROM (SELECT * REPLACE (CASE WHEN rec_type = 'response' THEN content_type ELSE '' END AS content_type) FROM cap)"


def _seen(wire: DataFrame) -> DataFrame:
    from stratarc.sources.warc import records

    c = C.to_captures(records(wire))
    return c.select("uuid", "url", "rec_type", "digest", "content_type", F.col("http.status").alias("status"), F.col("payload.size").alias("size"))


@query("warc_scan", SCANNED_SQL)
def warc_scan(spark, d):
    """Plain files, each in several ranges."""
    return _seen(_scanned(spark, _as_warc(spark, d)))


@query("warc_gz_scan", SCANNED_SQL)
def warc_gz_scan(spark, d):
    """Files of a member a record, each in several ranges of members."""
    return _seen(_scanned(spark, _as_members(spark, d, False)))


@query("wacz_scan", SCANNED_SQL)
def wacz_scan(spark, d):
    """Containers, whose stored archives are read by ranges."""
    return _seen(_scanned(spark, _as_members(spark, d, True)))


@query("stream_warc_progress", "SELECT count(*) AS records, count(*) FILTER (rec_type = 'response') AS responses, 'parsed' AS status FROM cap")
def stream_warc_progress(spark, d):
    """Records and failures of a folder, kept current while its files are read as a stream."""
    from stratarc.sources.warc import ACCEPTED, ingest_report, stream_warc

    wire = stream_warc(spark, _as_warc(spark, d), rf"{ACCEPTED}|\.txt$", files_at_once=1)
    seen = live.drain(ingest_report(wire), "update", ["file_name"], f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return seen.groupBy("status").agg(F.sum("records").alias("records"), F.sum("responses").alias("responses"))


@query("ingest_report", "SELECT 'parsed' AS status, count(*) AS records, count(*) FILTER (rec_type = 'response') AS responses FROM cap")
def ingest_report(spark, d):
    from stratarc.sources.warc import ingest_report as report

    return report(_scanned(spark, _as_warc(spark, d))).groupBy("status").agg(F.sum("records").alias("records"), F.sum("responses").alias("responses"))


@query("snapshot_roundtrip", "SELECT content_type, nodes, captures, true AS stale FROM (SELECT content_type, count(DISTINCT path[len(path)]) AS nodes, count(*) AS captures FROM treed WHERE content_type <> '' GROUP BY content_type)", PATH_SQL)
def snapshot_roundtrip(spark, d):
    from stratarc.sources.snapshots import publish, read_newest

    root = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    types = stats.content_types(captures(spark, d))
    publish(types.limit(1), root, "content-types", "2024-01-01 00:00:00")
    publish(types, root, "content-types", "2024-01-02 00:00:00")
    publish(types.where("false"), root, "content-types", "2024-01-03 00:00:00")
    return read_newest(spark, root, "content-types").drop("saved_at")


@query("corpus_status", "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, 'ok' AS status FROM (SELECT file_name, max(byte_offset) AS size FROM cap GROUP BY file_name)")
def corpus_status(spark, d):
    files = captures(spark, d).groupBy("file_name").agg(F.max("byte_offset").alias("size"))
    return stats.corpus_status(files, F.lit("2024-01-31")).drop("date")


@query("new_files", "SELECT DISTINCT file_name FROM cap WHERE event_id % 8 >= 5")
def new_files(spark, d):
    from stratarc.sources.warc import accepted

    listing = captures(spark, d).groupBy("file_name").agg(F.lit(1).alias("modified"), F.max("byte_offset").alias("size"))
    known = listing.where("substring(file_name, 6, 1) < '5'")
    odd = listing.withColumn("file_name", F.concat("file_name", F.lit(".txt")))
    return C.new_files(accepted(listing.unionByName(odd))[0], known).select("file_name")
