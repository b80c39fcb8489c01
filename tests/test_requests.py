"""Checks of parameters, routes, captures; redirects, candidates and as-of URLs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import validate
from cuesmith.operators import resolve
from cuesmith.profile import SiteProfile
from cuesmith.sources import io

SITE = SiteProfile()


def test_pages(spark):
    cases = [(None, 1), ("", 1), (" 7 ", 7), ("100", 100), ("007", 7)]
    cases += [(x, None) for x in ["0", "101", "-1", "1.5", "abc", "2e3", " ", "0x2", "NaN", "Infinity", "99999999999999999999", "1\n2"]]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p string").select("p", validate.normalize_page(F.col("p"), SITE).alias("r"))
    for (p, want), row in zip(cases, df.collect(), strict=True):
        assert row["p"] == p and row["r"]["page"] == want
        assert (row["r"]["error"] is None) == (want is not None)


def test_queries_and_ids(spark):
    cases = [("x", None), ("x" * 100, None), ("x" * 101, 1), ("😀" * 50, None), ("😀" * 51, 1), (" 　", 1), ("", 1), (None, 1)]
    df = spark.createDataFrame([(q,) for q, _ in cases], "q string").select(validate.validate_query(F.col("q"), SITE).alias("e"))
    assert [r["e"] is not None for r in df.collect()] == [bool(w) for _, w in cases]
    ids = ["1", "0" * 12, "1" * 13, "", "1\n", "a", None, "١"]
    df = spark.createDataFrame([(x,) for x in ids], "i string").select(validate.validate_id(F.col("i")).alias("e"))
    assert [r["e"] is None for r in df.collect()] == [True, True, False, False, False, False, False, False]


@pytest.mark.parametrize(
    ("method", "target", "route", "id_", "code"),
    [
        ("GET", "/download/665025.srt", "download", "665025", None),
        ("GET", "/download/665025.SRT/", "download", "665025", None),
        ("HEAD", "/download/665025?x=1", "download", "665025", None),
        ("GET", "/download/%31%32", "download", "12", None),
        ("GET", "/download/665025.zip", "download", "665025.zip", "INVALID_ID"),
        ("GET", "/download/%zz", "download", None, "INVALID_ID"),
        ("GET", "/download/1/2", "unknown", None, "NOT_FOUND"),
        ("GET", "/DOWNLOAD/1", "unknown", None, "NOT_FOUND"),
        ("GET", "/search", "search", None, "INVALID_QUERY"),
        ("GET", "/search?page=0", "search", None, "INVALID_PAGE"),
        ("GET", "/search?q=a+b&page=", "search", None, None),
        ("DELETE", "/search?q=x", "refused", None, "METHOD_NOT_ALLOWED"),
        ("OPTIONS", "/anything", "preflight", None, None),
        (None, "/search?q=x", "refused", None, "METHOD_NOT_ALLOWED"),
    ],
)
def test_routes(spark, method, target, route, id_, code):
    row = validate.route_requests(spark.createDataFrame([(method, target)], "method string, target string"), SITE).first()
    assert (row["route"], row["id"], row["error"] and row["error"]["code"]) == (route, id_, code)


def test_captures(spark):
    rows = [("a", 200, None, 10, b"x"), ("b", 200, None, None, b"x" * 11), ("c", 200, None, 11, b"x"), ("d", 302, "", None, None), ("e", 304, "/x", None, None), ("f", 404, None, None, None), ("g", 500, None, 99, b"x")]
    df = spark.createDataFrame(rows, "url string, status int, location string, content_length long, body binary")
    got = {r["url"]: (r["kind"], r["error"] and r["error"]["code"]) for r in io.checked_captures(df, 10).collect()}
    assert got == {
        "a": ("page", None), "b": ("error", "UPSTREAM_TOO_LARGE"), "c": ("error", "UPSTREAM_TOO_LARGE"), "d": ("error", "UPSTREAM_ERROR"),
        "e": ("redirect", None), "f": ("error", "UPSTREAM_NOT_FOUND"), "g": ("error", "UPSTREAM_ERROR"),
    }


def test_candidates(spark):
    df = spark.createDataFrame([("695516", None), ("12", None), ("7", "https://k")], "id string, known string")
    got: dict = {}
    for r in resolve.detail_candidates(df, SITE).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append(r["url"].removeprefix(SITE.origin))
    assert got["695516"] == ["/xml/sub/695/695516.xml", "/sub/695516.html", "/sub/695516", "/xml/sub/695516/695516.xml"]
    assert got["12"] == ["/xml/sub/12/12.xml", "/sub/12.html", "/sub/12"] and got["7"] == ["https://k"]


def test_redirects(spark):
    at = "https://file1.subs.example"
    hops = [(f"{at}/{i}", 302, f"/{i + 1}") for i in range(7)]
    rows = [*hops, (f"{at}/7", 200, None), (f"{at}/loop", 301, "loop"), (f"{at}/off", 302, "https://evil.example/"), (f"{at}/bare", 302, None), (f"{at}/x", 307, "http://file2.subs.example/y")]
    captures = spark.createDataFrame(rows, "url string, status int, location string")
    asked = spark.createDataFrame([(u,) for u in [f"{at}/0", f"{at}/2", f"{at}/loop", f"{at}/off", f"{at}/bare", "http://file1.subs.example/x", "https://evil.example/", f"{at}/gone", None]], "url string")
    got = {r["url"]: (r["final_url"], r["hops"], r["error"] and r["error"]["code"]) for r in resolve.resolve_redirects(asked, captures, SITE).collect()}
    assert got == {
        f"{at}/0": (None, 5, "TOO_MANY_REDIRECTS"), f"{at}/2": (f"{at}/7", 5, None), f"{at}/loop": (None, 5, "TOO_MANY_REDIRECTS"),
        f"{at}/off": (None, 0, "INVALID_REDIRECT"), f"{at}/bare": (None, 0, "UPSTREAM_ERROR"),
        "http://file1.subs.example/x": ("https://file2.subs.example/y", 1, None), "https://evil.example/": (None, 0, "INVALID_URL"), f"{at}/gone": (f"{at}/gone", 0, None),
    }


@pytest.mark.parametrize(
    ("pages", "code", "link"),
    [
        ([(None, 502), (None, 404)], "SUBTITLE_NOT_FOUND", None),
        ([(None, 502), (None, None)], "X", None),
        ([(None, 404), (None, None)], "SUBTITLE_NOT_FOUND", None),
        ([(None, None), (None, None)], "SUBTITLE_NOT_FOUND", None),
        ([(None, 502), ("l", None), ("m", None)], None, "l"),
    ],
)
def test_last_failing_candidate_decides(spark, pages, code, link):
    rows = [("1", i, f"u{i}", dl, None if st is None else (st, "X", "m")) for i, (dl, st) in enumerate(pages)]
    df = spark.createDataFrame(rows, "id string, ord int, url string, download_url string, error struct<status: int, code: string, message: string>")
    row = resolve.first_link_per_id(df).first()
    assert (row["error"] and row["error"]["code"], row["download_url"]) == (code, link)


def test_asof_uses_the_latest_search_only(spark):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    searches = spark.createDataFrame([(1, "a", t(0), True), (2, "a", t(10), True), (3, "a", t(20), False), (4, "b", t(0), True)], "search_id long, instance string, ts timestamp, ok boolean")
    details = spark.createDataFrame([(1, "5", "u1"), (2, "6", "u2"), (4, "5", "u4")], "search_id long, id string, detail_url string")
    downloads = spark.createDataFrame([("a", t(5), "5"), ("a", t(10), "5"), ("a", t(25), "6"), ("b", t(99), "5"), ("a", t(-1), "5")], "instance string, ts timestamp, id string")
    got = {(r["instance"], r["ts"], r["id"]): r["known"] for r in resolve.asof_detail_url(downloads, searches, details).collect()}
    assert list(map(got.get, [("a", t(5), "5"), ("a", t(10), "5"), ("a", t(25), "6"), ("b", t(99), "5"), ("a", t(-1), "5")])) == ["u1", None, "u2", "u4", None]


def test_asof_carries_searches_over_days(spark):
    import random

    random.seed(6)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=random.randrange(24 * 9))
    searches = [(i, random.choice("ab"), at(), random.random() < 0.7) for i in range(60)]
    details = [(i, str(k), f"u{i}/{k}") for i in range(60) for k in range(3) if random.random() < 0.6]
    downloads = [(i, random.choice(["a", "b", "c", None]), at(), str(random.randrange(3))) for i in range(200)]
    got = resolve.asof_detail_url(
        spark.createDataFrame(downloads, "n long, instance string, ts timestamp, id string"),
        spark.createDataFrame(searches, "search_id long, instance string, ts timestamp, ok boolean"),
        spark.createDataFrame(details, "search_id long, id string, detail_url string"),
    )
    urls = {(i, k): u for i, k, u in details}
    want = {}
    for n, instance, ts, id_ in downloads:
        last = max(((t, i) for i, who, t, ok in searches if ok and who == instance and t <= ts), default=None)
        want[n] = last and urls.get((last[1], id_))
    assert {r["n"]: r["known"] for r in got.collect()} == want


def plain_follow(url: str, moved: dict[str, str | None], most: int) -> tuple:
    """Hop by hop; locations are absolute, ``off`` is one that isn't allowed."""
    hops = 0
    while url in moved:
        to = moved[url]
        if not to:
            return None, hops, "UPSTREAM_ERROR"
        if to == "off":
            return None, hops, "INVALID_REDIRECT"
        if hops == most:
            return None, hops, "TOO_MANY_REDIRECTS"
        url, hops = to, hops + 1
    return url, hops, None


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5, 6, 8])
def test_redirect_closure_equals_plain_steps(spark, most):
    """Random graphs of redirects with chains, loops, ends and errors, for several limits."""
    rng = random.Random(most)
    profile = SiteProfile(max_redirects=most)
    at = lambda i: f"https://subs.example/p/{i}"
    moved = {at(i): rng.choice([at(i + 1), at(i + 1), at(i + 1), at(rng.randrange(90)), "off", None, ""]) for i in range(80)}
    captures = [(u, 302, "https://evil.example/" if to == "off" else to) for u, to in moved.items()] + [(at(i), 200, at(3)) for i in range(80, 90)]
    df = spark.createDataFrame(captures, "url string, status int, location string")
    asked = spark.createDataFrame([(at(i),) for i in range(95)], "url string")
    got = {r["url"]: (r["final_url"], r["hops"], r["error"] and r["error"]["code"]) for r in resolve.resolve_redirects(asked, df, profile).collect()}
    assert got == {at(i): plain_follow(at(i), moved, most) for i in range(95)}
    assert resolve.redirect_closure(df.limit(0), profile).count() == 0


def test_asof_of_a_hot_instance_is_cut_into_even_ranges(spark, monkeypatch):
    """One instance, many requests: found as plain steps find it, and no range has twice the median's rows."""
    rng = random.Random(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(3000)), i % 5 == 0) for i in range(4000)]
    log = spark.createDataFrame(rows, "n long, ts timestamp, search boolean").withColumn("instance", F.lit("p"))
    searches = log.where("search and n % 400 = 0").selectExpr("n as search_id", "instance", "ts", "n % 800 = 0 as ok")
    details = searches.selectExpr("search_id", "'7' as id", "concat('/', search_id) as detail_url")
    downloads = log.where("not search").selectExpr("n", "instance", "ts", "'7' as id")
    cuts = []
    monkeypatch.setattr(resolve, "materialize", lambda df: cuts.append(df.cache()) or cuts[-1])
    got = {r["n"]: r["known"] for r in resolve.asof_detail_url(downloads, searches, details).collect()}
    good = sorted((ts, n) for n, ts, s in rows if s and n % 800 == 0)
    last = lambda ts: next((f"/{n}" for t, n in reversed(good) if t <= ts), None)
    assert got == {n: last(ts) for n, ts, s in rows if not s}
    counts = sorted(r["count"] for r in cuts[0].groupBy("range").count().collect())
    assert len(counts) > 1 and counts[-1] < 2 * counts[len(counts) // 2]
