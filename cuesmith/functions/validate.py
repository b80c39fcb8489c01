"""Checks and classes of requests and captures, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import error, no_error
from ..profile import DEFAULT, SiteProfile
from .jsre import js_length, js_trim
from .urls import decode_component


def validate_query(query: Column, profile: SiteProfile = DEFAULT) -> Column:
    """Null if the query is fine, else its error: it needs a character and at most so many UTF-16 units, untrimmed."""
    bad = query.isNull() | (js_trim(query) == "") | (js_length(query) > profile.max_query_units)
    return F.when(bad, error("INVALID_QUERY")).otherwise(no_error())


def normalize_page(page: Column, profile: SiteProfile = DEFAULT) -> Column:
    """``struct<page, error>``: none or '' is page 1, a blank is an error."""
    text = js_trim(page.cast("string"))
    number = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("bigint"))
    good = number.between(1, profile.max_search_page)
    value = F.when(page.isNull() | (page.cast("string") == ""), F.lit(1)).when(good, number.cast("int"))
    return F.struct(value.alias("page"), F.when(value.isNull(), error("INVALID_PAGE")).otherwise(no_error()).alias("error"))


def validate_id(id_: Column) -> Column:
    """Null if the id is 1 to 12 digits, else its error."""
    good = F.coalesce(id_.rlike(r"\A[0-9]{1,12}\z"), F.lit(False))
    return F.when(good, no_error()).otherwise(error("INVALID_ID"))


def classify_capture(status: Column, location: Column) -> Column:
    """``struct<kind, error>`` of a capture: redirect, page, or an error."""
    moved, found = status.between(300, 399), status.between(200, 299)
    has = F.coalesce(location != "", F.lit(False))
    kind = F.when(moved & has, "redirect").when(found, "page").otherwise("error")
    why = (
        F.when(moved & ~has, error("UPSTREAM_ERROR", "redirect without a location"))
        .when(moved | found, no_error())
        .when(status == 404, error("UPSTREAM_NOT_FOUND"))
        .otherwise(error("UPSTREAM_ERROR"))
    )
    return F.struct(kind.alias("kind"), why.alias("error"))


def _parameter(query: Column, name: str) -> Column:
    """The first value of a parameter, form-decoded; null without it."""
    pairs = F.filter(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)) == name)
    first = F.get(pairs, F.lit(0))
    raw = F.regexp_replace(first, r"\A[^=]*=?", "")
    return F.coalesce(F.try_url_decode(raw), raw)


def route_requests(requests: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``requests(method, target)`` with ``route, id, query, page, error``.

    Only GET and HEAD are served; OPTIONS is a preflight, without error. A search's page is checked before its query.
    """
    path = F.regexp_extract("target", r"\A([^?#]*)", 1)
    query = F.regexp_extract("target", r"\A[^?#]*\?([^#]*)", 1)
    raw = F.regexp_extract(path, r"\A/download/([^/]+?)(?:\.(?i:srt))?/?\z", 1)
    page = normalize_page(_parameter(query, "page"), profile)
    id_ = decode_component(raw)
    served = F.col("method").isin("GET", "HEAD")
    route = (
        F.when(F.col("method") == "OPTIONS", "preflight")
        .when(~F.coalesce(served, F.lit(False)), "refused")
        .when(path == "/search", "search")
        .when(raw != "", "download")
        .otherwise("unknown")
    )
    routed = requests.withColumns({"route": route, "__id": id_, "__q": _parameter(query, "q"), "__page": page})
    is_search, is_download = F.col("route") == "search", F.col("route") == "download"
    why = (
        F.when(F.col("route") == "refused", error("METHOD_NOT_ALLOWED"))
        .when(F.col("route") == "unknown", error("NOT_FOUND"))
        .when(is_search, F.coalesce(F.col("__page.error"), validate_query(F.col("__q"), profile)))
        .when(is_download, validate_id(F.col("__id")))
    )
    return routed.withColumns(
        {
            "id": F.when(is_download, F.col("__id")),
            "query": F.when(is_search, F.col("__q")),
            "page": F.when(is_search, F.col("__page.page")),
            "error": why,
        }
    ).drop("__id", "__q", "__page")
