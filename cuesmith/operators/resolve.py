"""Subtitle ids to download links: candidates, redirects, the first link, and why there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import error, no_error
from ..functions.urls import allowed, resolve_url, secure_url, url_parts
from ..profile import DEFAULT, SiteProfile
from ..session import materialize


def detail_candidates(ids: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``ids(id, known)`` -> ``id, ord, url``: the known detail URL alone, else the site's forms of the id in order."""
    group, at = F.substring("id", 1, 3), profile.origin
    derived = F.concat(
        F.array(
            F.concat(F.lit(f"{at}/xml/sub/"), group, F.lit("/"), "id", F.lit(".xml")),
            F.concat(F.lit(f"{at}/sub/"), "id", F.lit(".html")),
            F.concat(F.lit(f"{at}/sub/"), "id"),
        ),
        F.when(F.length("id") > 3, F.array(F.concat(F.lit(f"{at}/xml/sub/"), "id", F.lit("/"), "id", F.lit(".xml")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    known = F.col("known") if "known" in ids.columns else F.lit(None).cast("string")
    urls = F.when(known.isNotNull(), F.array(known)).otherwise(derived)
    return ids.select("id", F.posexplode(urls).alias("ord", "url"))


def redirect_closure(captures: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``captures(url, status, location)``, one row per url -> ``url, final_url, hops, error`` of each url that moved.

    A url is followed while its capture is a 3xx, at most max_redirects times. Per hop: no location is an upstream
    error, a location off the list an invalid redirect; one redirect more than allowed is too many. A url without a
    capture is where it ends. Each location is resolved once. Paths are then doubled: those of up to two hops come
    from a join of single hops, those of four from a join of these, and so on by the binary digits of one hop more
    than allowed, so five hops take three joins, of redirects alone. One closure serves all who ask.
    """
    moved = captures.where(F.col("status").between(300, 399) & F.col("url").isNotNull())
    to = moved.select("url", "location", resolve_url(F.col("location"), F.col("url")).alias("to"))
    why = (
        F.when(F.coalesce(F.col("location") == "", F.lit(True)), error("UPSTREAM_ERROR", "redirect without a location"))
        .when(~allowed(F.col("to"), profile), error("INVALID_REDIRECT"))
        .otherwise(no_error())
    )
    step = to.withColumn("error", why).select(
        "url",
        F.when(F.col("error").isNull(), secure_url(F.col("to.url"), profile)).otherwise(F.col("url")).alias("at"),
        F.col("error").isNull().cast("int").alias("hops"),
        "error",
    )
    power, path, digits = materialize(step), None, profile.max_redirects + 1
    while True:
        if digits & 1:
            path = power if path is None else _then(path, power)
        digits >>= 1
        if not digits:
            break
        power = _then(power, power)
    late = (F.col("hops") > profile.max_redirects) & F.col("error").isNull()
    ended = path.withColumns({"error": F.when(late, error("TOO_MANY_REDIRECTS")).otherwise(F.col("error")), "hops": F.least("hops", F.lit(profile.max_redirects))})
    return ended.select("url", F.when(F.col("error").isNull(), F.col("at")).alias("final_url"), "hops", "error")


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths that go on, where they end, by those that begin there; one with an error is over."""
    goes_on = F.when(F.col("error").isNull(), F.col("at"))
    more = second.select(F.col("url").alias("__at"), F.col("at").alias("__to"), F.col("hops").alias("__hops"), F.col("error").alias("__error"))
    met = first.withColumn("__at", goes_on).join(more, "__at", "left")
    return met.select("url", F.coalesce("__to", "at").alias("at"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.coalesce("error", "__error").alias("error"))


def follow(urls: DataFrame, closure: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``urls(url)`` -> ``url, final_url, hops, error``, each url once, by a closure of redirects.

    A url is allow-listed and made https first. One that didn't move, or has no capture, stays where it is.
    """
    asked = urls.where("url is not null").select("url").distinct().select(
        "url",
        secure_url(F.col("url"), profile).alias("__at"),
        F.when(allowed(url_parts(F.col("url")), profile), no_error()).otherwise(error("INVALID_URL")).alias("__bad"),
    )
    ends = closure.select(F.col("url").alias("__key"), "final_url", "hops", "error")
    met = asked.withColumn("__key", F.when(F.col("__bad").isNull(), F.col("__at"))).join(ends, "__key", "left")
    why = F.coalesce("__bad", "error")
    final = F.when(why.isNull(), F.coalesce("final_url", "__at"))
    return met.select("url", final.alias("final_url"), F.coalesce("hops", F.lit(0)).alias("hops"), why.alias("error"))


def resolve_redirects(urls: DataFrame, captures: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``follow`` by a closure of its own; who asks more than once makes the closure once."""
    return follow(urls, redirect_closure(captures, profile), profile)


def attach_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with what their page gave: ``pages(url, download_url, error)``, one row per url; no page is an upstream error."""
    null = candidates.where("url is null").select("*", F.lit(None).cast("string").alias("download_url"), error("UPSTREAM_ERROR").alias("error"))
    met = candidates.where("url is not null").join(pages.select("url", "download_url", "error", F.lit(True).alias("__met")), "url", "left")
    missing = F.when(F.col("__met").isNull(), error("UPSTREAM_ERROR", "not captured")).otherwise(F.col("error"))
    return met.withColumn("error", missing).select(*candidates.columns, "download_url", "error").unionByName(null)


def first_link_per_id(attached: DataFrame) -> DataFrame:
    """``attached(id, ord, url, download_url, error)`` -> ``id, detail_url, download_url, error``.

    The first candidate with a link decides. Without any, the last failing candidate's error is passed on if its
    status is 500 or more; otherwise the subtitle wasn't found.
    """
    linked = F.col("download_url").isNotNull()
    best = F.min_by(F.struct("url", "download_url"), F.when(linked, F.col("ord")))
    last = F.max_by("error", F.when(F.col("error").isNotNull(), F.col("ord")))
    picked = attached.groupBy("id").agg(best.alias("b"), last.alias("e"))
    why = (
        F.when(F.col("b.download_url").isNotNull(), no_error())
        .when(F.col("e.status") >= 500, F.col("e"))
        .otherwise(error("SUBTITLE_NOT_FOUND"))
    )
    return picked.select("id", F.col("b.url").alias("detail_url"), F.col("b.download_url").alias("download_url"), why.alias("error"))


def asof_detail_url(downloads: DataFrame, searches: DataFrame, details: DataFrame) -> DataFrame:
    """Downloads with ``known``: the URL that the latest successful search of the same instance before them gave the id.

    ``downloads(instance, ts, id, ...)``, ``searches(search_id, instance, ts, ok)``, ``details(search_id, id, detail_url)``
    with one row per search and id. A search that doesn't list the id makes it unknown. Rows are cut by number into
    ranges of (instance, time), so a busy instance's day is many tasks; the latest search is found within a range, and
    for downloads before a range's first one the last search of the ranges before is carried over, of which an
    instance has no more rows than there are ranges. Then it is an equi-join on search and id. Without an instance
    nothing is known.
    """
    none = F.lit(None)
    found = searches.where("ok and instance is not null").select("instance", "ts", F.col("search_id").alias("sid"), F.lit(0).alias("last"))
    asked = downloads.select("instance", "ts", none.cast(found.schema["sid"].dataType).alias("sid"), F.lit(1).alias("last"), F.struct(*downloads.columns).alias("row"))
    both = found.withColumn("row", none.cast(asked.schema["row"].dataType)).unionByName(asked)
    # Written, as the cut must be the same for all that follows.
    cut = materialize(both.repartitionByRange("instance", "ts", "last", "sid").withColumn("range", F.spark_partition_id()))
    order = W.partitionBy("instance", "range").orderBy("ts", "last", "sid").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = cut.withColumn("sid", F.last("sid", True).over(order)).where("last = 1")
    ends = cut.where("instance is not null").groupBy("instance", "range").agg(F.max_by("sid", F.when(F.col("last") == 0, F.struct("ts", "sid"))).alias("sid"))
    before = W.partitionBy("instance").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("instance", "range", F.last("sid", True).over(before).alias("carried")).where("carried is not null")
    at = here.join(carried, ["instance", "range"], "left").select("row", F.coalesce("sid", "carried").alias("sid"))
    met = at.join(
        details.select(F.col("search_id").alias("__sid"), F.col("id").alias("__id"), F.col("detail_url").alias("known")),
        (F.col("sid") == F.col("__sid")) & (F.col("row.id") == F.col("__id")),
        "left",
    )
    return met.select("row.*", "known")


def attach_archives(resolved: DataFrame, archives: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """Resolved ids with the archive at their link, https for file hosts: ``archives(url, archive_id)``, left."""
    keyed = resolved.withColumn("__key", secure_url(F.col("download_url"), profile))
    return keyed.join(archives.select(F.col("url").alias("__key"), "archive_id"), "__key", "left").drop("__key")
