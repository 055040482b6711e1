"""Header, number, date and identity columns of a capture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses whose Location is followed (fixed values of HTTP).
FOLLOWED = (301, 302, 303, 307, 308)
#: Top-level media types (fixed values).
TOP_LEVEL = ("application", "audio", "font", "image", "message", "model", "multipart", "text", "video")


def header(bag: Column, name: str) -> Column:
    """First value whose key equals the name in any case, in the bag's order."""
    return F.get(F.filter(F.map_entries(bag), lambda e: F.lower(e.key) == name.lower()), F.lit(0))["value"]


def header_text(bag: Column) -> Column:
    """A header bag kept as JSON text, as a map; null where the text is no JSON object."""
    return F.from_json(bag, "map<string,string>")


def number_or_null(s: Column) -> Column:
    return F.when(F.trim(s) == "", F.lit(0.0)).otherwise(F.trim(s).try_cast("double"))


def date_or_null(s: Column) -> Column:
    """ISO or HTTP date, as a timestamp of the session's zone."""
    http = F.regexp_extract(s, r"^\w+, (.*)$", 1)
    return F.coalesce(s.try_cast("timestamp"), F.try_to_timestamp(http, F.lit("dd MMM yyyy HH:mm:ss z")))


def record_uuid(s: Column) -> Column:
    bare = F.regexp_extract(s, r"(?i)^<?urn:uuid:([^>]*)>?$", 1)
    return F.when(s.isNull(), "").when(bare != "", bare).otherwise(s)


def unwrap_angle(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"^<(.*)>$", "$1")


def content_essence(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(s, F.lit(";"), F.lit(1)))), F.lit(""))


def content_type_full(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, ";"), lambda part: F.trim(part)), "; ")


def custom_id(file_name: Column, url: Column, uuid: Column) -> Column:
    return F.concat_ws("::", file_name, url, uuid)


def custom_id_parts(id_: Column) -> Column:
    """(file_name, url, uuid): the first and the last separator count, so that URLs may hold one."""
    pattern = r"(?s)^(.*?)::(.*)::(.*?)$"
    return F.struct(*(F.regexp_extract(id_, pattern, i + 1).alias(n) for i, n in enumerate(("file_name", "url", "uuid"))))


def is_redirect(status: Column) -> Column:
    return F.coalesce(status.between(300, 399), F.lit(False))


def status_class(status: Column, low_is_ok: bool = True) -> Column:
    """none, 2xx, 3xx, 4xx or 5xx; below 200 counts as ok, or as none where ``low_is_ok`` is false."""
    return (
        F.when(status.isNull() | ((status < 200) & F.lit(not low_is_ok)), "none")
        .when(status < 300, "2xx")
        .when(status < 400, "3xx")
        .when(status < 500, "4xx")
        .otherwise("5xx")
    )


def payload_bytes(full_size: Column, size: Column) -> Column:
    return F.coalesce(full_size, size)


def has_body(size: Column) -> Column:
    return F.coalesce(size >= 1, F.lit(False))


def usable_content_type(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^[a-z0-9.+-]+/[a-z0-9.+*-]+$") & F.split_part(t, F.lit("/"), F.lit(1)).isin(*TOP_LEVEL), F.lit(False))


def failure_kind(status: Column, error_name: Column, message: Column) -> Column:
    """(kind, retryable) of a failed request."""
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = (
        F.when(status.isin(502, 503, 504), "timeout")
        .when(status == 404, "missing")
        .when(status.isin(401, 403), "denied")
        .when(status == 429, "throttled")
        .when(status >= 500, "server")
        .when(status.isNotNull(), "rejected")
        .when(error_name == "SyntaxError", "malformed")
        .when(error_name.isin("AbortError", "TimeoutError") | text.contains("timed out"), "timeout")
        .otherwise("offline")
    )
    return F.struct(kind.alias("kind"), kind.isin("timeout", "throttled", "server", "offline").alias("retryable"))


def quality_flags(chunks: Column, truncated: Column, uuid: Column, id_: Column) -> Column:
    return F.struct((F.coalesce(F.size(chunks), F.lit(0)) > 0).alias("chunked"), truncated.isNotNull().alias("truncated"), F.coalesce(F.nullif(uuid, F.lit("")), id_).alias("shown_id"))
