"""The three jobs: harvest pages, resolve subtitles, replay requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import error, no_error
from ..functions.urls import search_url, secure_url
from ..functions.validate import normalize_page, route_requests, validate_id, validate_query
from ..operators.cache import distinct_ids, fan_out, replay_cache, split_cache
from ..operators.hits import first_download_link, parse_hits
from ..operators.payload import Extractor, decode_bytes, extract_first_srt
from ..operators.resolve import asof_detail_url, attach_archives, attach_pages, detail_candidates, first_link_per_id, follow, redirect_closure
from ..profile import DEFAULT, SiteProfile
from ..session import materialize
from ..sources.io import checked_captures, within_limit


def harvest_pages(captures: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """Captures of result pages -> hits by url and pos. No shuffle: pages are checked, decoded and parsed where they are."""
    good = checked_captures(captures, profile.max_page_bytes).where("kind = 'page'")
    pages = decode_bytes(good.select("url", "body"), "body").select("url", F.col("text").alias("html"))
    return parse_hits(pages, profile)


def harvest_searches(
    searches: DataFrame, captures: DataFrame, profile: SiteProfile = DEFAULT, closure: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``searches(search_id, q, page)`` -> hits by search, page and pos, and ``search_id, url, error`` of all searches.

    However many searches lead to a page, it is decoded and parsed once, and its body moves once at most: searches meet
    its hits by its url. ``closure`` is the captures' ``redirect_closure``, if it is there already.
    """
    page = normalize_page(F.col("page"), profile)
    checked = searches.select(
        "search_id", "q", page["page"].alias("page_no"), F.coalesce(page["error"], validate_query(F.col("q"), profile)).alias("error")
    ).withColumn("url", F.when(F.col("error").isNull(), search_url(F.col("q"), F.col("page_no"), profile)))
    closure = redirect_closure(captures, profile) if closure is None else closure
    ends = materialize(follow(checked.select("url"), closure, profile).withColumnRenamed("error", "moved_error"))
    pages = checked_captures(captures, profile.max_page_bytes).select(F.col("url").alias("final_url"), "kind", F.col("error").alias("page_error"), "body")
    wanted = ends.where("final_url is not null").select("final_url").distinct()
    read = decode_bytes(pages.where("kind = 'page'").join(wanted, "final_url", "left_semi").select("final_url", "body"), "body")
    found = parse_hits(read.select("final_url", F.col("text").alias("html")), profile)
    asked = checked.where("url is not null").join(ends, "url")
    hits = asked.select("search_id", "page_no", "final_url").join(found, "final_url").drop("final_url")
    met = asked.join(pages.select("final_url", "kind", "page_error"), "final_url", "left")
    why = F.coalesce("moved_error", "page_error", F.when(F.col("kind").isNull(), error("UPSTREAM_ERROR", "not captured")))
    state = met.select("search_id", why.alias("late"))
    return hits, checked.join(state, "search_id", "left").select("search_id", "url", F.coalesce("error", "late").alias("error"))


def page_results(urls: DataFrame, captures: DataFrame, profile: SiteProfile = DEFAULT, closure: DataFrame | None = None) -> DataFrame:
    """``urls(url)`` -> ``url, download_url, error``: redirects followed, then one look for a link per distinct url.

    A page is parsed once for each url that leads to it, as its links resolve against the url that was asked for.
    """
    closure = redirect_closure(captures, profile) if closure is None else closure
    ends = materialize(follow(urls, closure, profile))
    pages = checked_captures(captures, profile.max_page_bytes).select(
        F.col("url").alias("final_url"), "kind", F.col("error").alias("page_error"), "body"
    )
    met = ends.join(pages, "final_url", "left")
    texts = decode_bytes(met.where("kind = 'page' and error is null").select("url", "body"), "body")
    links = first_download_link(texts.select("url", F.col("text").alias("html")), profile=profile)
    why = F.coalesce("error", "page_error", F.when(F.col("kind").isNull(), error("UPSTREAM_ERROR", "not captured")))
    return met.select("url", why.alias("error")).join(links, "url", "left").select("url", "download_url", "error")


def resolve_downloads(ids: DataFrame, captures: DataFrame, profile: SiteProfile = DEFAULT, closure: DataFrame | None = None) -> DataFrame:
    """``ids(id, known)`` -> ``id, detail_url, download_url, error``; each distinct candidate page is read once."""
    candidates = materialize(detail_candidates(ids, profile))
    return first_link_per_id(attach_pages(candidates, page_results(candidates.select("url"), captures, profile, closure)))


def resolve_subtitles(
    requests: DataFrame,
    captures: DataFrame,
    archives: DataFrame,
    profile: SiteProfile = DEFAULT,
    *,
    cached: DataFrame | None = None,
    now: Column | None = None,
    ttl_ms: float | None = None,
    searches: DataFrame | None = None,
    details: DataFrame | None = None,
    rar_extractor: Extractor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Requests for subtitles -> what each is served, and the subtitles that were made.

    ``requests(request_id, id)``, with instance and ts if ``searches`` and ``details`` are given (see
    ``asof_detail_url``); ``archives(url, content)``, one row per url; ``cached(id, cached_at, n_bytes)``, one row per
    id, is looked up at ``now`` (the current time if not given). The first result is ``request_id, id, source, n_bytes,
    error`` with source cache or site; texts don't travel with requests. The second is ``id, name, encoding, text,
    n_bytes, cached_at``, good ones only, as ``write_subtitles`` takes them.

    Ids are checked and made distinct first, and those with a fresh cached subtitle leave. The detail URL that an
    id's first request knows decides alone. Archives move only for the links that some id has.
    """
    now = F.current_timestamp() if now is None else now
    checked = requests.withColumn("bad", validate_id(F.col("id")))
    good = checked.where("bad is null")
    ids = distinct_ids(good)
    fresh = None
    if cached is not None:
        hit, ids = split_cache(ids, cached.select("id", "cached_at", "n_bytes"), now, ttl_ms, profile)
        fresh = hit.select("id", F.lit("cache").alias("source"), F.col("n_bytes").cast("long").alias("n_bytes"), no_error().alias("error"))
    if searches is not None and details is not None:
        known = asof_detail_url(good.select("request_id", "instance", "ts", "id"), searches, details)
        first = known.groupBy("id").agg(F.min_by(F.struct("known"), F.struct("ts", "request_id"))["known"].alias("known"))
        ids = ids.join(first, "id", "left")
    closure = materialize(redirect_closure(captures, profile))
    found = materialize(resolve_downloads(ids, captures, profile, closure))
    ends = follow(found.select(F.col("download_url").alias("url")), closure, profile)
    linked = found.join(ends.select(F.col("url").alias("download_url"), "final_url", F.col("error").alias("moved")), "download_url", "left")
    large = F.octet_length("content") > profile.max_archive_bytes
    stored = archives.select(secure_url(F.col("url"), profile).alias("url"), F.col("url").alias("archive_id"), large.alias("large"))
    met = attach_archives(linked.withColumn("download_url", F.col("final_url")), stored, profile)
    at = materialize(met.join(stored.select("archive_id", "large"), "archive_id", "left"))
    wanted = at.where("archive_id is not null and not large").select("archive_id").distinct()
    payloads = archives.select(F.col("url").alias("archive_id"), "content").join(wanted, "archive_id", "left_semi")
    texts = decode_bytes(extract_first_srt(payloads, profile, rar_extractor), "data").drop("data")
    done = at.join(texts, "archive_id", "left").withColumn(
        "error",
        F.coalesce(
            "error",
            "moved",
            F.when(F.col("archive_id").isNull(), error("UPSTREAM_ERROR", "not captured")),
            F.when(F.col("large"), error("UPSTREAM_TOO_LARGE")),
            F.when(F.col("problem").isNotNull(), error("INVALID_ARCHIVE", F.col("problem"))),
            no_error(),
        ),
    )
    result = materialize(within_limit(done.select("id", "name", "encoding", "text", "error"), profile))
    slim = result.select("id", F.lit("site").alias("source"), F.when(F.col("error").isNull(), F.col("n_bytes")).alias("n_bytes"), "error")
    served = fan_out(checked.select("request_id", "id", "bad"), slim if fresh is None else slim.unionByName(fresh))
    source = F.when(F.coalesce("bad", "error").isNull(), F.col("source")).alias("source")
    made = result.where("error is null and text is not null").drop("error").withColumn("cached_at", now.cast("timestamp"))
    return served.select("request_id", "id", source, "n_bytes", F.coalesce("bad", "error").alias("error")), made


def replay_requests(
    requests: DataFrame,
    ttl_ms: float | None = None,
    profile: SiteProfile = DEFAULT,
    searches: DataFrame | None = None,
    details: DataFrame | None = None,
) -> DataFrame:
    """``requests(request_id, ts, method, target)`` -> route, id, query, page, error, and the cache's outcome of good downloads.

    Columns latency_ms and ok tell how long a download's task runs and whether it succeeds: requests meanwhile are
    coalesced, and failures aren't cached. With ``searches`` and ``details`` (and a column instance), ``known`` is the
    detail URL that a download's process knew.
    """
    routed = route_requests(requests, profile)
    good = routed.where("route = 'download' and error is null")
    served = replay_cache(good, ttl_ms, profile).select("request_id", "outcome")
    if searches is not None and details is not None:
        known = asof_detail_url(good.select("request_id", "instance", "ts", "id"), searches, details)
        served = served.join(known.select("request_id", "known"), "request_id", "left")
    return routed.join(served, "request_id", "left")
