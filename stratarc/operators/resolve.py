"""Revisits and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U
from stratarc.operators.asof import TimeIndex, keyed_time_index, nearest, nearest_by_keys, time_indexes
from stratarc.operators.stored import stored

CARRIED = ("file_name", "byte_offset", "custom_id", "archived_ts", "status", "location", "payload_size", "content_type")


def target_of(url: Column = None) -> Column:
    return U.redirect_target(F.col("status"), F.col("location"), F.col("uri") if url is None else url)


def resolve_revisits(captures: DataFrame, same_file: bool = False) -> DataFrame:
    """All revisits with ``donor``: by digest the nearest in time; without any such donor, by the URI they refer to.

    ``same_file`` allows only donors from the revisit's own file.
    """
    donors = captures.where("rec_type <> 'revisit' AND payload_size IS NOT NULL")
    revisits = captures.where("rec_type = 'revisit'").withColumn("lookup_id", F.col("custom_id"))
    if same_file:
        join = lambda c: F.concat_ws("\x00", "file_name", c)
    else:
        join = F.col
    key = lambda c: F.when(F.col(c).isNotNull(), join(c))
    digests, uris = time_indexes(donors.select(key("digest").alias("__digest"), key("uri").alias("__uri"), *CARRIED), ["__digest", "__uri"])
    by_digest = nearest(revisits.withColumn("key", key("digest")), digests, near="archived_ts")
    by_digest = stored(by_digest, "by-digest")  # both branches below read it
    found = by_digest.where("hit IS NOT NULL").withColumn("via", F.lit("digest"))
    rest = by_digest.where("hit IS NULL").drop("hit", "key").withColumn("key", key("refers_to_uri")).withColumn("__at", F.coalesce("refers_to_date", "archived_ts"))
    by_uri = nearest(rest, uris, near="__at").drop("__at").withColumn("via", F.when(F.col("hit").isNotNull(), "uri"))
    return found.unionByName(by_uri).drop("key", "lookup_id").withColumnRenamed("hit", "donor")


def candidates(captures: DataFrame) -> DataFrame:
    """What a lookup may end at: responses with a payload or a target, and resolved revisits under their own identity."""
    shown = ["uri", *CARRIED]
    plain = captures.where("rec_type = 'response'").where(F.col("payload_size").isNotNull() | target_of().isNotNull()).select(*shown)
    asked = captures.select("uri", "rec_type", "digest", "refers_to_uri", "refers_to_date", *CARRIED)
    resolved = resolve_revisits(asked).where("donor IS NOT NULL")
    http = F.col("status").isNotNull()
    resolved = resolved.select(
        "uri",
        F.col("donor.file_name").alias("file_name"),
        "byte_offset",
        "custom_id",
        "archived_ts",
        F.coalesce("status", "donor.status").alias("status"),
        F.when(http, F.col("location")).otherwise(F.col("donor.location")).alias("location"),
        F.col("donor.payload_size").alias("payload_size"),
        F.when(F.col("content_type") != "", F.col("content_type")).otherwise(F.col("donor.content_type")).alias("content_type"),
    )
    return plain.unionByName(resolved)


def revisit_rate(captures: DataFrame) -> DataFrame:
    """Resolved of all revisits, within the own file and over all files.

    Whether there is a donor, not which: distinct keys of donors, looked up.
    """
    donors = captures.where("rec_type <> 'revisit' AND payload_size IS NOT NULL")
    revisits = captures.where("rec_type = 'revisit'").select("file_name", "digest", "refers_to_uri")

    def rate(scope: str, *file: str) -> DataFrame:
        held = lambda c, name: donors.where(f"{c} IS NOT NULL").select(*file, F.col(c).alias(name)).distinct().withColumn(f"__{name}", F.lit(True))
        rows = revisits.join(held("digest", "digest"), [*file, "digest"], "left").join(held("uri", "refers_to_uri"), [*file, "refers_to_uri"], "left")
        return rows.agg(F.lit(scope).alias("scope"), F.count("*").alias("revisits"), F.count_if(F.col("__digest").isNotNull() | F.col("__refers_to_uri").isNotNull()).alias("resolved"))

    return rate("own file", "file_name").unionByName(rate("all files"))


def follow_redirects(lookups: DataFrame, captures: DataFrame, follow: int = 5, stop_at_body: bool = False, shown: DataFrame | TimeIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """(final, hops) of lookups (lookup_id, url, near).

    Each hop takes the nearest capture of the URL at the lookup's own date.  A chain ends at a capture that leads no
    further (hit), with not-archived or no-payload, or with redirect: at a capture seen before, or past ``follow``
    hops.  With ``stop_at_body`` the first redirect with a body ends it, its target in ``redirects_to``.  The
    candidates' time index is made once (or given as ``shown``); a hop only joins what is still asked for.
    """
    groups = captures.select("uri").where("uri <> ''").distinct()
    shown = (shown if isinstance(shown, TimeIndex) else keyed_time_index(candidates(captures) if shown is None else shown, groups)).dealt()
    open_ = lookups.select("lookup_id", "url", "near", F.array().cast("array<string>").alias("seen"))
    finals, hops = [], []
    target = U.redirect_target(F.col("hit.status"), F.col("hit.location"), F.col("hit.uri"))
    for hop in range(follow + 1):
        step = nearest_by_keys(open_, groups, shown)
        step = step.withColumn("target", target)
        again = F.array_contains("seen", F.col("hit.custom_id"))
        stops = F.lit(stop_at_body) & H.has_body(F.col("hit.payload_size"))
        state = (
            F.when(F.col("outcome") != "hit", F.col("outcome"))
            .when(again, "redirect")
            .when(F.col("target").isNull() | stops, "hit")
            .when(F.lit(hop == follow), "redirect")
            .otherwise("open")
        )
        step = stored(step.withColumn("state", state), f"hop{hop}")
        ended = step.where("state <> 'open'")
        last = F.col("state") == "redirect"
        finals.append(
            ended.select(
                "lookup_id",
                F.col("state").alias("outcome"),
                F.when(F.col("state") == "hit", F.col("hit.custom_id")).alias("custom_id"),
                # past the limit the last target counts as walked
                (F.lit(hop) + F.when(last & ~again, 1).otherwise(0)).cast("int").alias("hops"),
                F.when(last & ~again, F.col("target")).otherwise(F.col("url")).alias("final_url"),
                F.when(F.col("state") == "hit", F.col("target")).alias("redirects_to"),
                F.when(F.col("state") == "hit", F.col("hit.content_type")).alias("content_type"),
                F.when(F.col("state") == "hit", F.col("hit.payload_size")).alias("payload_size"),
                F.when(F.col("state") == "hit", F.col("hit.status")).alias("status"),
            )
        )
        hops.append(
            step.where("outcome = 'hit'").select(
                "lookup_id", F.lit(hop).alias("hop"), "url", F.col("hit.custom_id").alias("custom_id"), F.col("hit.status").alias("status"), F.col("hit.location").alias("location"), F.col("target").alias("resolved")
            )
        )
        open_ = step.where("state = 'open'").select("lookup_id", F.col("target").alias("url"), "near", F.concat("seen", F.array("hit.custom_id")).alias("seen"))
        if open_.isEmpty():
            break
    final, listing = finals[0], hops[0]
    for f, h in zip(finals[1:], hops[1:]):
        final, listing = final.unionByName(f), listing.unionByName(h)
    return final, listing


def from_captures(captures: DataFrame, starts: DataFrame, follow: int = 5, shown: DataFrame | None = None) -> DataFrame:
    """Chains from given captures (custom_id): one is shown itself if it has a body or leads nowhere, else followed."""
    shown = stored(candidates(captures), "candidates") if shown is None else shown
    rows = shown.join(starts, "custom_id", "left_semi").withColumn("target", target_of())
    own = rows.where(F.col("target").isNull() | H.has_body(F.col("payload_size")))
    onward = rows.where(F.col("target").isNotNull() & ~H.has_body(F.col("payload_size")))
    final, _ = follow_redirects(onward.select(F.col("custom_id").alias("lookup_id"), F.col("target").alias("url"), F.col("archived_ts").alias("near")), captures, follow, True, shown)
    return own.select(F.col("custom_id").alias("lookup_id"), F.lit("hit").alias("outcome"), "custom_id").unionByName(final.select("lookup_id", "outcome", "custom_id"))


def one_hop(captures: DataFrame, shown: DataFrame | TimeIndex | None = None) -> DataFrame:
    """For every redirect capture its target and the nearest capture there at the same date, or null."""
    shown = candidates(captures) if shown is None else shown
    moves = captures.where("rec_type = 'response'").select(F.col("custom_id").alias("lookup_id"), target_of().alias("url"), F.col("archived_ts").alias("near")).where("url IS NOT NULL")
    found = nearest_by_keys(moves, captures.select("uri").distinct(), shown)
    return found.select(F.col("lookup_id").alias("custom_id"), F.col("url").alias("target"), F.col("hit.custom_id").alias("target_id"))


def from_page(lookups: DataFrame, captures: DataFrame, shown: DataFrame | TimeIndex, now: Column, follow: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lookups (lookup_id, url, from_url): ``near`` is the newest capture the referring page ends at, else now."""
    index = shown if isinstance(shown, TimeIndex) else keyed_time_index(shown, captures.select("uri").where("uri <> ''").distinct())
    shown = index.candidates()
    pages, _ = follow_redirects(lookups.select("lookup_id", F.col("from_url").alias("url"), F.lit(None).cast(shown.schema["archived_ts"].dataType).alias("near")), captures, follow, False, index)
    dates = pages.where("custom_id IS NOT NULL").join(shown.select("custom_id", "archived_ts"), "custom_id").select("lookup_id", F.col("archived_ts").alias("near"))
    return follow_redirects(lookups.join(dates, "lookup_id", "left").select("lookup_id", "url", F.coalesce("near", now).alias("near")), captures, follow, False, index)


def request_pairs(captures: DataFrame) -> DataFrame:
    """Responses with whether a request points to them by WARC-Concurrent-To, and the redirect flag."""
    requests = captures.where("rec_type = 'request'").select(H.record_uuid(F.col("concurrent_to")).alias("__to")).where("__to <> ''").groupBy("__to").agg(F.count("*").alias("requests"))
    rows = captures.where("rec_type = 'response'").join(requests, F.col("uuid") == F.col("__to"), "left")
    return rows.select("custom_id", "uuid", F.coalesce("requests", F.lit(0)).alias("requests"), F.col("requests").isNotNull().alias("has_request"), H.is_redirect(F.col("status")).alias("redirect"))
