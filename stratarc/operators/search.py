"""Search, filters, paging and anchors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions import headers as H
from stratarc.functions import urls as U

PAGE, LAST_PAGE, COUNTED = 16, 626, 10_001
#: Latin letters with an accent and what they are without (by Unicode decomposition).
ACCENTS = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xE0, 0x180) if chr(c).islower() and len(unicodedata.normalize("NFD", chr(c))) > 1}


def matches(uri: Column, query: str) -> Column:
    """The text is literal; the empty one matches all."""
    return F.contains(F.lower(uri), F.lit(query.lower())) if query else F.lit(True)


def has_type(t: Column, wanted: str) -> Column:
    """A full type, or a top-level one such as ``image``."""
    return (t == wanted) | t.startswith(f"{wanted}/")


def type_filter(captures: DataFrame, wanted: str) -> DataFrame:
    """A type that the corpus does not hold is no filter."""
    t = H.content_essence(F.col("content_type_raw"))
    held = captures.agg(F.coalesce(F.bool_or(has_type(t, wanted)), F.lit(False)).alias("__held"))
    return captures.crossJoin(F.broadcast(held)).where(~F.col("__held") | has_type(t, wanted)).drop("__held")


def level(uri: Column) -> Column:
    """Path segments: shallow URLs come first."""
    return F.size(U.url_parts(uri).segments)


def found_uris(captures: DataFrame, query: str) -> DataFrame:
    return captures.where(matches(F.col("uri"), query)).select("uri").distinct().withColumn("level", level(F.col("uri")))


def page_count(total: Column) -> Column:
    t = F.coalesce(F.nanvl(total.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.greatest(F.ceil(F.least(t, F.lit(1e9)) / PAGE), F.lit(1)), F.lit(LAST_PAGE)).cast("int")


def offset_page(captures: DataFrame, query: str, page: float, size: int = PAGE) -> DataFrame:
    n = min(max(int(page), 1), LAST_PAGE)
    return found_uris(captures, query).orderBy("level", "uri").offset((n - 1) * size).limit(size)


def keyset_page(captures: DataFrame, query: str, after_level: int | None, after_uri: str | None, size: int = PAGE) -> DataFrame:
    """Rows after a cursor; half a cursor is none."""
    rows = found_uris(captures, query)
    if after_level is not None and after_uri:
        rows = rows.where((F.col("level") > after_level) | ((F.col("level") == after_level) & (F.col("uri") > after_uri)))
    return rows.orderBy("level", "uri").limit(size)


def page_groups(captures: DataFrame, page: DataFrame) -> DataFrame:
    """A page's URIs with their statistics."""
    from stratarc.operators.stats import uri_stats

    return uri_stats(captures.join(F.broadcast(page), "uri", "left_semi")).join(F.broadcast(page), "uri")  # a page has 16 rows


def capped_count(captures: DataFrame, query: str, cap: int = COUNTED) -> DataFrame:
    """Counting stops at the cap."""
    n = found_uris(captures, query).limit(cap).agg(F.count("*").alias("total"))
    return n.select("total", (F.col("total") >= cap).alias("capped"), F.when(F.col("total") >= cap, "10,000+").otherwise(F.col("total").cast("string")).alias("label"))


def search_summary(captures: DataFrame, query: str, page: int = 1) -> DataFrame:
    shown = offset_page(captures, query, page)
    last = shown.agg(F.count("*").alias("shown"), F.max(F.struct("level", "uri")).alias("last"))
    total = capped_count(captures, query)
    return last.crossJoin(total).select(
        "shown", "total", "capped", F.lit(page).alias("page"), page_count(F.col("total")).alias("pages"), F.col("last.level").alias("next_level"), F.col("last.uri").alias("next_uri")
    )


def latest(captures: DataFrame, content_type: str = "text/html", limit: int = 8) -> DataFrame:
    t = H.content_essence(F.col("content_type_raw"))
    return captures.where(has_type(t, content_type)).orderBy(F.desc("archived_ts"), "custom_id").limit(limit)


def captures_of(captures: DataFrame, uri: str) -> DataFrame:
    """All captures of one exact URL, in timeline order."""
    rows = captures.where(F.col("uri") == uri)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("uri").orderBy("archived_ts", "byte_offset", "custom_id")))


def capture_by_id(captures: DataFrame, id_: str) -> DataFrame:
    return captures.where(F.col("custom_id") == id_)


def same_site(captures: DataFrame, ids: DataFrame) -> DataFrame:
    """All captures that share the URL of a given id."""
    asked = captures.join(ids, "custom_id", "left_semi").select("uri").distinct()
    return captures.join(asked, "uri", "left_semi")


def anchors(uris: DataFrame, uri: str = "uri", position: str = "pos") -> DataFrame:
    """Anchors, unique in page order: the second equal one gets -2, and so on."""
    named = uris.withColumn("base", U.site_anchor(F.col(uri)))
    n = F.row_number().over(Window.partitionBy("base").orderBy(position))
    return named.withColumn("__n", n).select(uri, position, F.when(F.col("__n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "__n")).alias("anchor"), U.site_label(F.col(uri)).alias("label"))


def byte_budget(ids: DataFrame, group: str, id_column: str, order: str, budget: int = 12_000, path: int = 9) -> DataFrame:
    """Per group the longest prefix of ids whose request stays within the budget: included and dropped counts."""
    cost = F.length(F.concat(F.lit("ids="), U._encoded(F.col(id_column))))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = ids.withColumn("__used", F.lit(path) + F.sum(cost + 1).over(w) - 1)
    fits = F.col("__used") <= budget
    return sized.groupBy(group).agg(F.count_if(fits).alias("included"), F.count_if(~fits).alias("dropped"))


def natural_key(segment: Column) -> Column:
    """Digit runs compare as numbers: each follows its length; letters are lower-case and without accents."""
    plain = F.translate(F.lower(segment), "".join(ACCENTS), "".join(ACCENTS.values()))
    parts = F.regexp_extract_all(plain, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def numbered(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, numbered), "")
