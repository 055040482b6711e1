"""References of pages: missing, resolved, exported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import urls as U
from stratarc.operators.asof import TimeIndex
from stratarc.operators.resolve import follow_redirects

MAX_ENTRIES, MAX_BYTES = 1000, 256 << 20


def page_refs(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_uri, pos, ref, target): what href and src attributes name, resolved against the page."""
    found = pages.select(F.col(url).alias("page_uri"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("pos", "ref"))
    return found.withColumn("target", U.resolve_reference(F.col("page_uri"), F.col("ref")))


def resolve_refs(refs: DataFrame, captures: DataFrame, dates: DataFrame, shown: DataFrame | TimeIndex | None = None) -> DataFrame:
    """Distinct (page_uri, target) with the outcome of the lookup at the page's own date (``dates``: uri, near)."""
    asked = refs.where("target IS NOT NULL").groupBy("page_uri", "target").agg(F.min("pos").alias("pos"))
    asked = asked.join(dates.withColumnRenamed("uri", "page_uri"), "page_uri")
    lookups = asked.select(F.concat_ws(" ", "page_uri", "target").alias("lookup_id"), F.col("target").alias("url"), "near")
    final, _ = follow_redirects(lookups, captures, shown=shown)
    return asked.withColumn("lookup_id", F.concat_ws(" ", "page_uri", "target")).join(final, "lookup_id").drop("lookup_id")


def missing_refs(resolved: DataFrame) -> DataFrame:
    """References without a capture to show: not-archived, no-payload, redirect, or an error status at the end."""
    reason = F.when(F.col("outcome") != "hit", F.col("outcome")).when(F.col("status") >= 400, "error-status")
    return resolved.select("page_uri", "target", "pos", reason.alias("reason")).where("reason IS NOT NULL")


def resolved_refs(resolved: DataFrame) -> DataFrame:
    """Asked and served URL, status, type, bytes, hops; flagged if served under another address without a redirect."""
    rows = resolved.where("outcome = 'hit'")
    other = (F.col("final_url") != F.col("target")) & (F.col("hops") == 0) & ~U.same_target(F.col("final_url"), F.col("target"))
    return rows.select(
        "page_uri",
        F.col("target").alias("asked"),
        F.col("final_url").alias("served"),
        "custom_id",
        F.coalesce("status", F.lit(200)).alias("status"),
        F.coalesce(F.nullif(F.col("content_type"), F.lit("")), F.lit("application/octet-stream")).alias("content_type"),
        F.coalesce("payload_size", F.lit(0)).cast("long").alias("bytes"),
        "hops",
        other.alias("differs"),
    )


def export_manifest(resolved: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per page its references in page order with entry names, notices, and whether they are inside the caps.

    Notices: missing, redirect-stub (the chain ends at a small redirect), merged (a capture named before), limit.
    """
    page = Window.partitionBy("page_uri")
    order = page.orderBy("pos", "target")
    hit = F.col("outcome") == "hit"
    named = resolved.withColumn("merged", hit & (F.row_number().over(Window.partitionBy("page_uri", "custom_id").orderBy("pos", "target")) > 1))
    take = hit & ~F.col("merged")
    size = F.when(take, F.coalesce("payload_size", F.lit(0))).otherwise(0)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = named.withColumn("n", F.sum(take.cast("int")).over(run)).withColumn("bytes", F.sum(size).over(run))
    inside = take & (F.col("n") <= max_entries) & (F.col("bytes") <= max_bytes)
    path = F.regexp_replace(U.site_label(F.col("final_url")), r'[<>:"|?*\\]', "-")
    rows = rows.withColumn("path", F.when(take, path)).withColumn("twins", F.count("path").over(Window.partitionBy("page_uri", "path")))
    name = F.when(F.col("twins") > 1, F.concat_ws("-", "path", F.substring_index("custom_id", "::", -1))).otherwise(F.col("path"))
    notice = (
        F.when(~hit, "missing")
        .when(F.col("merged"), "merged")
        .when(~inside, "limit")
        .when(F.col("redirects_to").isNotNull() | F.coalesce(F.col("status").between(300, 399), F.lit(False)), "redirect-stub")
        .when(F.col("twins") > 1, "path-collision")
    )
    return rows.select("page_uri", "target", "pos", "custom_id", name.alias("entry"), notice.alias("notice"), F.coalesce(inside, F.lit(False)).alias("included"))


def notices(missing: DataFrame, keep: int = 500) -> DataFrame:
    """Distinct by (URL, reason), the first occurrence kept; the newest ``keep``."""
    first = missing.groupBy(F.col("target").alias("url"), "reason").agg(F.min(F.struct("page_uri", "pos")).alias("at"))
    rows = first.select("url", "reason", F.col("at.page_uri").alias("page_uri"), F.col("at.pos").alias("pos"))
    return rows.orderBy(F.desc("page_uri"), F.desc("pos"), "url", "reason").limit(keep)


def site_index(captures: DataFrame, limit: int = 500) -> DataFrame:
    """The first URIs in search order folded to hostnames: landing slug and newest capture."""
    from stratarc.operators.search import found_uris

    page = found_uris(captures, "").orderBy("level", "uri").limit(limit)
    rows = captures.join(F.broadcast(page), "uri", "left_semi")  # at most ``limit`` rows
    host = U.url_parts(F.col("uri")).hostname
    return rows.groupBy(host.alias("host")).agg(F.max("archived_ts").alias("newest_ts")).withColumn("slug", U.query_slug(F.col("host")))
