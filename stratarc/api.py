"""Named query functions over a captures table and over loaded archives.

Each takes typed arguments and gives a DataFrame, of at most ``limit`` rows where it takes one; an empty result is an empty DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratarc.operators import captures as C
from stratarc.operators import resolve, search, stats, tree
from stratarc.operators.asof import nearest_by_keys

MAX_ROWS = 25


def _one_lookup(captures: DataFrame, url: str, near: Column | None) -> DataFrame:
    spark = captures.sparkSession
    kind = captures.schema["archived_ts"].dataType
    return spark.range(1).select(F.lit("0").alias("lookup_id"), F.lit(url).alias("url"), (near if near is not None else F.lit(None)).cast(kind).alias("near"))


def search_archive(captures: DataFrame, query: str, content_type: str | None = None, after: tuple[int, str] | None = None, page: int = 1, limit: int = search.PAGE) -> DataFrame:
    """URLs with their statistics; ``limit`` is held within 1 and 25, and a page has so many."""
    size = min(max(int(limit), 1), MAX_ROWS)
    rows = search.type_filter(captures, content_type) if content_type else captures
    found = search.keyset_page(rows, query, *after, size=size) if after else search.offset_page(rows, query, page, size)
    return search.page_groups(rows, found)


def get_capture_timeline(captures: DataFrame, url: str, limit: int = 25) -> DataFrame:
    return search.captures_of(captures, url).orderBy("n").limit(limit)


def get_capture_as_of(captures: DataFrame, url: str, date: Column | None = None) -> DataFrame:
    found = nearest_by_keys(_one_lookup(captures, url, date), captures.select("uri").distinct(), resolve.candidates(captures))
    return found.select("url", "outcome", "hit.*")


def list_content_types(captures: DataFrame, limit: int | None = None) -> DataFrame:
    """The types held, by name; all of them without a limit."""
    types = stats.content_types(captures).orderBy(F.lower("content_type"), "content_type")
    return types if limit is None else types.limit(limit)


def get_capture_detail(captures: DataFrame, custom_id: str) -> DataFrame:
    return resolve.request_pairs(captures).where(F.col("custom_id") == custom_id).join(captures.drop("uuid"), "custom_id")


def resolve_redirect_chain(captures: DataFrame, url: str, near: Column | None = None, max_hops: int = 20) -> DataFrame:
    return resolve.follow_redirects(_one_lookup(captures, url, near), captures, max_hops)[1].drop("lookup_id").orderBy("hop")


def get_archive_status(files: DataFrame, day: Column) -> DataFrame:
    return stats.corpus_status(files, day)


def list_loaded_archives(report: DataFrame) -> DataFrame:
    return report.orderBy("file_name")


def describe_loaded_archive(captures: DataFrame, top: int = 12) -> DataFrame:
    return stats.host_overview(captures, top)


def search_loaded_records(captures: DataFrame, query: str, content_type: str | None = None, limit: int = 25) -> DataFrame:
    return tree.search_loaded(captures, tree.nodes(captures), query, content_type, limit)


def get_loaded_timeline(captures: DataFrame, url: str, limit: int = 25) -> DataFrame:
    return get_capture_timeline(C.browsable(captures), url, limit)


def find_loaded_capture_as_of(captures: DataFrame, url: str, date: Column | None = None, stop_at_body: bool = False) -> DataFrame:
    return resolve.follow_redirects(_one_lookup(captures, url, date), captures, stop_at_body=stop_at_body)[0].drop("lookup_id")
