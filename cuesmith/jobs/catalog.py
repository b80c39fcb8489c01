"""The library's queries over the driver's tables, each with the same result in DuckDB SQL.

Captures of a site aren't among the tables: a query builds site-shaped rows from known columns, runs the operator
over them, and its SQL reads the columns directly. Each works on every row of its tables.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.html import visible_text
from ..functions.text import decode_score, labeled_value, looks_like_srt, normalize_text
from ..functions.validate import normalize_page, route_requests, validate_id, validate_query
from ..operators import cache, hits, payload, resolve
from ..profile import SiteProfile
from ..session import spread
from ..sources.io import hits_json, to_kv
from . import workloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SITE = SiteProfile()
PUBLIC = SiteProfile(site="example.com")
SRT = "1\n00:00:01,000 --> 00:00:02,000\n"


def _query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


# --- Pages --------------------------------------------------------------------------------------------------------


def result_pages(orders: DataFrame) -> DataFrame:
    """A result page for each customer, with a card for each order and two banners."""
    fmt = F.when(F.col("o_orderkey") % 5 == 0, "Advanced SubStation Alpha").otherwise("Subrip(srt)")
    card = _text(
        '<div class="subitem"><a href="/sub/', _s("o_orderkey"), '/t.html"><b>Order ', _s("o_orderkey"), " &amp; more</b></a><p>版本：",
        F.col("o_orderpriority"), " <span>格式： ", fmt, "</span> 语言：", F.col("o_orderstatus"), "</p> <p>日期：",
        F.date_format("o_orderdate", "yyyy-MM-dd"), "</p></div>",
    )
    cards = F.sort_array(F.collect_list(F.struct("o_orderkey", card.alias("card"))))
    return orders.groupBy("o_custkey").agg(
        _text(
            '<section class="resultcard"><div class="subitem" id="top-banner">格式：Subrip(srt)</div>',
            F.array_join(F.transform(cards, lambda x: x["card"]), ""),
            '<div class="subitem" id="bottom-banner"></div></section>',
        ).alias("html")
    )


HITS = """
SELECT o_custkey, CAST(pos AS INTEGER) AS pos, CAST(o_orderkey AS VARCHAR) AS id,
       'Order ' || o_orderkey || ' & more' AS title, o_orderpriority AS version, 'Subrip(srt)' AS format,
       o_orderstatus AS language, strftime(o_orderdate, '%Y-%m-%d') AS date,
       'https://subs.example/sub/' || o_orderkey || '/t.html' AS detail_url
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
WHERE o_orderkey % 5 <> 0
"""


@_query(HITS)
def parse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.parse_hits(result_pages(_table(spark, sf_dir, "orders")), SITE)


@_query(
    "SELECT url, pos, id, title, version, format, language, date, detail_url FROM "
    f"(SELECT 'https://subs.example/sub/?searchword=' || o_custkey AS url, * FROM ({HITS}))"
)
def harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harvest from captures: bytes with a byte-order mark, half of them behind a size that is too large."""
    pages = result_pages(_table(spark, sf_dir, "orders"))
    captures = pages.select(
        _text(f"{SITE.origin}/sub/?searchword=", _s("o_custkey")).alias("url"),
        F.lit(200).alias("status"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("long").alias("content_length"),
        F.concat(F.unhex(F.lit("EFBBBF")), F.col("html").cast("binary")).alias("body"),
    )
    large = captures.withColumns({"url": _text(F.col("url"), "&page=2"), "content_length": F.lit(SITE.max_page_bytes + 1).cast("long")})
    return workloads.harvest_pages(captures.unionByName(large), SITE)


@_query(
    "SELECT 10 * o_custkey + n AS search_id, CAST(1 + o_custkey % 2 AS INTEGER) AS page_no, pos, id, title, version, format, language, date, detail_url "
    f"FROM ({HITS}), (SELECT unnest(range(5)) AS n) WHERE o_custkey % 11 <> 0 AND n <= o_custkey % 5"
)
def harvest_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches to hits: one to five of each customer's page 1 or 2, a seventh of them behind a redirect, an eleventh not found."""
    key = F.col("o_custkey")
    found = result_pages(_table(spark, sf_dir, "orders")).withColumns({"q": _text("a & b ", _s("o_custkey")), "page": (1 + key % 2).cast("string")})
    url, moved = urls.search_url(F.col("q"), 1 + key % 2, SITE), _text(f"{SITE.origin}/moved/", _s("o_custkey"))
    away = key % 7 == 0
    none = F.lit(None).cast("string")
    body = F.when(key % 11 != 0, F.encode("html", "UTF-16LE"))
    shape = lambda at, status, location, body: found.select(
        "o_custkey", at.alias("url"), status.alias("status"), location.alias("location"), F.lit(None).cast("long").alias("content_length"), body.alias("body")
    )
    body = F.concat(F.unhex(F.lit("FFFE")), body)
    status = F.when(key % 11 == 0, 404).otherwise(200)
    first = shape(url, F.when(away, 302).otherwise(status), F.when(away, _text("/moved/", _s("o_custkey"))), F.when(~away, body))
    captures = first.unionByName(shape(moved, status, none, body).where(away)).drop("o_custkey")
    repeats = F.explode(F.sequence(F.lit(0), (key % 5).cast("int")))
    searches = found.select("o_custkey", "q", "page", repeats.alias("n")).select((10 * key + F.col("n")).alias("search_id"), "q", "page")
    return workloads.harvest_searches(searches, captures, SITE)[0]


@_query(
    f"""SELECT o_custkey, '[' || string_agg('{{"id":"' || id || '","title":"' || title || '","version":"' || version || '","format":"' || format
|| '","language":"' || language || '","date":"' || date || '","detailUrl":"' || detail_url || '"}}', ',' ORDER BY pos) || ']' AS hits
FROM ({HITS}) GROUP BY o_custkey"""
)
def hits_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_json(hits.parse_hits(result_pages(_table(spark, sf_dir, "orders")), SITE), "o_custkey")


@_query(
    f"SELECT CAST(o_custkey % 10 AS BIGINT) AS search_id, id, max_by(detail_url, o_custkey * 1000 + pos) AS detail_url FROM (SELECT * REPLACE (CAST(CAST(id AS BIGINT) % 100 AS VARCHAR) AS id) FROM ({HITS})) GROUP BY ALL"
)
def latest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits.parse_hits(result_pages(_table(spark, sf_dir, "orders")), SITE)
    keyed = found.withColumns(
        {"search_id": F.col("o_custkey") % 10, "page_no": F.col("o_custkey"), "id": (F.col("id").cast("long") % 100).cast("string")}
    )
    return hits.latest_detail(keyed)


@_query(
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs'),
'&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g')) AS text FROM pages"""
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", normalize_text(visible_text(F.col("html"))).alias("text"))


@_query(
    r"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages),
l AS (SELECT page_id, url, unnest(hs) AS href, unnest(range(0, len(hs))) AS pos FROM a)
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^(https?://[^/]+)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS link FROM l"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits.page_links(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "pos", F.col("link.url").alias("link"))


@_query(
    """SELECT 'https://subs.example/sub/' || p_partkey || '.html' AS url, CASE
WHEN p_partkey % 4 = 0 THEN 'https://subs.example/download/' || p_partkey || '/a.zip'
WHEN p_partkey % 4 = 1 THEN 'https://2.subs.example/download/' || p_partkey || '/b.RAR?token=' || p_size
WHEN p_partkey % 4 = 2 THEN 'http://file0.subs.example/download/' || p_partkey || '/c.srt' END AS download_url FROM part"""
)
def first_download_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = _s("p_partkey"), F.col("p_partkey") % 4
    click = F.when(kind == 0, _text("location.href='/download/", key, "/a.zip'")).otherwise("")
    mirror = F.when(kind <= 1, _text('<a href="//2.subs.example/download/', key, "/b.RAR?token=", _s("p_size"), '">b</a>')).otherwise("")
    file = F.when(kind <= 2, _text('<a href="http://file0.subs.example/download/', key, '/c.srt">c</a>')).otherwise("")
    html = _text(
        '<a href="https://evilsubs.example/download/1.zip">x</a><a href="">y</a><a href="#" onclick="', click, '">z</a>',
        '<a href="http://subs.example/download/2.zip">plain</a>', mirror, file, '<a href="/download/none.txt">t</a>',
    )
    parts = spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    pages = parts.select(_text(f"{SITE.origin}/sub/", key, ".html").alias("url"), html.alias("html"))
    return hits.first_download_link(pages, profile=SITE)


# --- URLs and values ----------------------------------------------------------------------------------------------

_URLS = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '//[^/]+', '//file' || page_id || '.example.com')
WHEN page_id % 4 = 1 THEN regexp_replace(url, '//[^/]+', '//evilexample.com') ELSE url END AS url FROM pages"""


def _mixed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.when(F.col("page_id") % 4 == 0, _text("//file", _s("page_id"), ".example.com")).when(
        F.col("page_id") % 4 == 1, "//evilexample.com"
    )
    url = F.when(host.isNull(), F.col("url")).otherwise(F.regexp_replace("url", F.lit("//[^/]+"), host))
    return _table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


@_query(
    rf"""SELECT page_id, regexp_matches(url, '^https://([^/]*\.)?example\.com(/|$)') OR regexp_matches(url, '^http://file[0-9]*\.example\.com(/|$)') AS allowed
FROM ({_URLS})"""
)
def allowed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_urls(spark, sf_dir).select("page_id", urls.allowed_url(F.col("url"), PUBLIC).alias("allowed"))


@_query(
    rf"""SELECT page_id, CASE WHEN regexp_matches(url, '^http://file[0-9]*\.example\.com(/|$)') THEN 'https' || substr(url, 5) ELSE url END AS url
FROM ({_URLS})"""
)
def secure_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_urls(spark, sf_dir).select("page_id", urls.secure_url(F.col("url"), PUBLIC).alias("url"))


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderpriority END AS version,
o_orderstatus AS language, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders"""
)
def labeled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 3
    head = F.when(key == 0, "").when(key == 1, "版本：").otherwise(_text("版本: ", F.col("o_orderpriority")))
    text = normalize_text(_text(head, "  语言：　", F.col("o_orderstatus"), " 日期： ", F.date_format("o_orderdate", "yyyy-MM-dd")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    value = lambda label: labeled_value(F.col("t"), label, SITE)
    return rows.select("o_orderkey", value("版本").alias("version"), value("语言").alias("language"), value("日期").alias("date"))


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 1 WHEN o_orderkey % 6 = 2 AND o_custkey BETWEEN 1 AND 100 THEN CAST(o_custkey AS INTEGER)
END AS page, CASE WHEN o_orderkey % 6 IN (0, 1) OR o_orderkey % 6 = 2 AND o_custkey BETWEEN 1 AND 100 THEN NULL ELSE 'INVALID_PAGE' END AS code FROM orders"""
)
def validate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 6
    page = (
        F.when(kind == 1, "").when(kind == 2, _text(" ", _s("o_custkey"), " ")).when(kind == 3, " ")
        .when(kind == 4, _text("-", _s("o_custkey"))).when(kind == 5, _text(_s("o_custkey"), ".5"))
    )
    checked = normalize_page(page, SITE)
    return _table(spark, sf_dir, "orders").select("o_orderkey", checked["page"].alias("page"), checked["error"]["code"].alias("code"))


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND length(CAST(o_orderkey AS VARCHAR)) + 7 <= 12 THEN NULL ELSE 'INVALID_ID' END AS code FROM orders"""
)
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = _s("o_orderkey"), F.col("o_orderkey") % 4
    id_ = F.when(kind == 0, key).when(kind == 1, _text("0000000", key)).when(kind == 2, _text(key, "\n"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", validate_id(id_)["code"].alias("code"))


@_query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 OR c_custkey % 4 = 2 AND 2 * (c_custkey % 70) + 1 > 100 THEN 'INVALID_QUERY' END AS code FROM customer"""
)
def validate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    q = (
        F.when(kind == 1, "　 \n").when(kind == 2, _text(F.repeat(F.lit("😀"), (F.col("c_custkey") % 70).cast("int")), "x"))
        .when(kind == 3, F.col("c_name"))
    )
    return _table(spark, sf_dir, "customer").select("c_custkey", validate_query(q, SITE)["code"].alias("code"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_id") % 8, _s("user_id")
    target = (
        F.when(kind == 0, _text("/download/", user)).when(kind == 1, _text("/download/", user, ".SRT/"))
        .when(kind == 2, _text("/download/", user, ".zip")).when(kind == 3, _text("/search?page=2&q=a+", user, "%21#x"))
        .when(kind == 4, "/search?q=x&page=0").when(kind == 5, _text("/DOWNLOAD/", user))
        .when(kind == 6, "/search").when(F.col("user_id") % 2 == 0, _text("/download/%3", user)).otherwise(_text("/download/%zz", user))
    )
    method = F.when(F.col("event_id") % 5 == 0, "HEAD").when(F.col("event_id") % 7 == 0, "DELETE").otherwise("GET")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "ts", method.alias("method"), target.alias("target"))


ROUTED = """WITH e AS (SELECT *, event_id % 8 AS k, event_id % 5 <> 0 AND event_id % 7 = 0 AS refused FROM events),
d AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS decoded FROM e),
r AS (SELECT event_id AS request_id, ts,
CASE WHEN refused THEN 'refused' WHEN k IN (0, 1, 2, 7) THEN 'download' WHEN k IN (3, 4, 6) THEN 'search' ELSE 'unknown' END AS route,
CASE WHEN refused THEN NULL WHEN k IN (0, 1) THEN CAST(user_id AS VARCHAR) WHEN k = 2 THEN user_id || '.zip'
WHEN k = 7 THEN decoded END AS id,
CASE WHEN refused THEN NULL WHEN k = 3 THEN 'a ' || user_id || '!' WHEN k = 4 THEN 'x' END AS query,
CASE WHEN refused THEN NULL WHEN k = 3 THEN 2 WHEN k = 6 THEN 1 END AS page,
CASE WHEN refused THEN 'METHOD_NOT_ALLOWED' WHEN k = 2 OR k = 7 AND decoded IS NULL THEN 'INVALID_ID' WHEN k = 4 THEN 'INVALID_PAGE'
WHEN k = 5 THEN 'NOT_FOUND' WHEN k = 6 THEN 'INVALID_QUERY' END AS code FROM d)"""


@_query(f"{ROUTED} SELECT request_id, route, id, query, CAST(page AS INTEGER) AS page, code FROM r")
def route_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_requests(_targets(spark, sf_dir), SITE)
    return routed.select("request_id", "route", "id", "query", "page", F.col("error.code").alias("code"))


@_query(
    """SELECT c_custkey, 'https://subs.example/sub/?searchword=' || replace(replace(replace(url_encode(c_name || ' ~*_-.' || c_mktsegment || '&ü'), '%20', '+'), '%2A', '*'), '~', '%7E')
|| CASE WHEN c_custkey % 100 > 1 THEN '&page=' || (c_custkey % 100) ELSE '' END AS url FROM customer"""
)
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _text(" ", F.col("c_name"), " ~*_-.", F.col("c_mktsegment"), "&ü\n")
    return _table(spark, sf_dir, "customer").select("c_custkey", urls.search_url(q, F.col("c_custkey") % 100, SITE).alias("url"))


# --- Resolution ---------------------------------------------------------------------------------------------------

_CANDIDATES = """WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'https://subs.example/sub/' || o_orderkey || '/known' END AS known FROM orders),
c AS (SELECT id, 0 AS ord, coalesce(known, 'https://subs.example/xml/sub/' || substr(id, 1, 3) || '/' || id || '.xml') AS url FROM k
UNION ALL SELECT id, 1, 'https://subs.example/sub/' || id || '.html' FROM k WHERE known IS NULL
UNION ALL SELECT id, 2, 'https://subs.example/sub/' || id FROM k WHERE known IS NULL
UNION ALL SELECT id, 3, 'https://subs.example/xml/sub/' || id || '/' || id || '.xml' FROM k WHERE known IS NULL AND length(id) > 3)"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _s("o_orderkey")
    known = F.when(F.col("o_orderkey") % 7 == 0, _text(f"{SITE.origin}/sub/", key, "/known"))
    return _table(spark, sf_dir, "orders").select(key.alias("id"), known.alias("known"))


@_query(f"{_CANDIDATES} SELECT id, CAST(ord AS INTEGER) AS ord, url FROM c")
def detail_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.detail_candidates(_ids(spark, sf_dir), SITE)


@_query(
    f"""{_CANDIDATES},
p AS (SELECT *, (CAST(id AS BIGINT) + ord) % 5 AS k FROM c),
s AS (SELECT *, CASE WHEN k = 0 THEN 200 WHEN k = 1 THEN 404 WHEN k = 2 THEN 500 WHEN k = 3 THEN 200 END AS status,
CASE WHEN k = 0 AND CAST(id AS BIGINT) % 3 = 0 THEN 'https://subs.example/download/' || id || '/' || ord || '.srt' END AS link FROM p),
e AS (SELECT *, CASE WHEN status = 200 THEN NULL WHEN status = 404 THEN 404 ELSE 502 END AS bad FROM s),
g AS (SELECT id, arg_min(link, ord) FILTER (link IS NOT NULL) AS download_url, arg_max(bad, ord) FILTER (bad IS NOT NULL) AS last FROM e GROUP BY id)
SELECT id, download_url, CASE WHEN download_url IS NOT NULL THEN NULL WHEN last >= 500 THEN 'UPSTREAM_ERROR' ELSE 'SUBTITLE_NOT_FOUND' END AS code FROM g"""
)
def resolve_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids through candidates and captured pages; a fifth of the candidates has no capture, others fail or hold no link."""
    ids = _ids(spark, sf_dir)
    found = resolve.detail_candidates(ids, SITE).withColumn("k", (F.col("id").cast("long") + F.col("ord")) % 5)
    link = _text('<a href="/download/', F.col("id"), "/", _s("ord"), '.srt">x</a>')
    html = F.when((F.col("k") == 0) & (F.col("id").cast("long") % 3 == 0), link).otherwise("<a href='/sub/'>none</a>")
    captures = found.where("k < 4").select(
        "url",
        F.when(F.col("k") == 1, 404).when(F.col("k") == 2, 500).otherwise(200).alias("status"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("long").alias("content_length"),
        html.cast("binary").alias("body"),
    )
    done = workloads.resolve_downloads(ids, captures, SITE)
    return done.select("id", "download_url", F.col("error.code").alias("code"))


@_query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'page' WHEN p_partkey % 97 = 5 THEN 'off' WHEN p_partkey % 83 = 7 THEN 'bare'
WHEN p_partkey % 89 = 3 THEN 'loop' ELSE 'next' END AS kind FROM part),
w AS (SELECT k AS start, k AS place, 0 AS hops, CAST(NULL AS VARCHAR) AS code, false AS done FROM c
UNION ALL SELECT w.start, CASE WHEN c.kind = 'next' AND w.hops < 5 THEN w.place + 1 ELSE w.place END,
CASE WHEN c.kind IN ('next', 'loop') AND w.hops < 5 THEN w.hops + 1 ELSE w.hops END,
CASE WHEN c.kind = 'bare' THEN 'UPSTREAM_ERROR' WHEN c.kind = 'off' THEN 'INVALID_REDIRECT' WHEN c.kind IN ('next', 'loop') AND w.hops >= 5 THEN 'TOO_MANY_REDIRECTS' END,
c.k IS NULL OR c.kind IN ('page', 'bare', 'off') OR w.hops >= 5
FROM w LEFT JOIN c ON c.k = w.place WHERE NOT w.done)
SELECT start AS k, CASE WHEN code IS NULL THEN 'https://subs.example/p/' || place END AS final_url, CAST(hops AS INTEGER) AS hops, code FROM w WHERE done"""
)
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    at = lambda k: _text(f"{SITE.origin}/p/", k.cast("string"))
    location = (
        F.when(key % 97 == 5, "https://evil.example/x").when(key % 83 == 7, "").when(key % 89 == 3, at(key)).otherwise(_text("../p/", (key + 1).cast("string")))
    )
    captures = _table(spark, sf_dir, "part").select(
        at(key).alias("url"), F.when(key % 10 == 0, 200).otherwise(302).alias("status"), location.alias("location")
    )
    done = resolve.resolve_redirects(captures.select("url"), captures, SITE)
    k = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    return done.select(k.alias("k"), "final_url", "hops", F.col("error.code").alias("code"))


@_query(
    """WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view' AND event_id % 3 <> 0),
d AS (SELECT event_id, user_id, ts, event_id % 4 AS id FROM events WHERE event_type = 'purchase')
SELECT d.event_id, CAST(d.id AS VARCHAR) AS id, CASE WHEN s.event_id IS NOT NULL AND s.event_id % 4 <> d.id THEN '/sub/' || s.event_id || '/' || d.id END AS known
FROM d ASOF LEFT JOIN s ON d.user_id = s.user_id AND d.ts >= s.ts"""
)
def asof_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are searches, a third of them failed; each lists three of four ids. Purchases are downloads."""
    return _asof(spark, sf_dir, F.col("user_id"))


@_query(
    """WITH s AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, ts FROM events WHERE event_type = 'view' AND event_id % 3 <> 0),
d AS (SELECT event_id, ts, event_id % 4 AS id, (SELECT count(*) FROM s WHERE s.ts <= e.ts) AS n FROM events e WHERE event_type = 'purchase')
SELECT d.event_id, CAST(d.id AS VARCHAR) AS id, CASE WHEN s.event_id % 4 <> d.id THEN '/sub/' || s.event_id || '/' || d.id END AS known
FROM d LEFT JOIN s ON s.n = d.n"""
)
def asof_hot_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of one process that does everything."""
    return _asof(spark, sf_dir, F.lit(1))


def _asof(spark: SparkSession, sf_dir: str, instance: Column) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("instance", instance)
    searches = events.where("event_type = 'view'").select(F.col("event_id").alias("search_id"), "instance", "ts", (F.col("event_id") % 3 != 0).alias("ok"))
    listed = searches.select("search_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).where("n <> search_id % 4")
    details = listed.select("search_id", _s("n").alias("id"), _text("/sub/", _s("search_id"), "/", _s("n")).alias("detail_url"))
    downloads = events.where("event_type = 'purchase'").select("event_id", "instance", "ts", (F.col("event_id") % 4).cast("string").alias("id"))
    return resolve.asof_detail_url(downloads, searches, details).select("event_id", "id", "known")


# --- Cache --------------------------------------------------------------------------------------------------------


@_query(
    """WITH c AS (SELECT user_id, max(ts) AS written, max(event_id) % 40 AS mb FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT c_custkey AS id, coalesce(written >= now - INTERVAL 24 HOUR AND mb <= 32, false) AS fresh FROM customer LEFT JOIN c ON c_custkey = user_id, n"""
)
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    ids = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    written = events.groupBy(F.col("user_id").alias("id")).agg(
        F.max("ts").alias("cached_at"), ((F.max("event_id") % 40) * (1 << 20)).alias("n_bytes")
    )
    now = F.lit(events.agg(F.max("ts")).first()[0])
    found, missing = cache.split_cache(ids, written, now, -1, SITE)
    return found.select("id", F.lit(True).alias("fresh")).unionByName(missing.select("id", F.lit(False).alias("fresh")))


@_query(
    """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND e.ts > m.ts + INTERVAL 24 HOUR GROUP BY m.user_id)
SELECT e.event_id AS request_id, e.user_id AS id, CASE WHEN m.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.ts = e.ts"""
)
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    log = events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("id"), "ts")
    return cache.replay_cache(log, None, SITE).select("request_id", "id", "outcome")


HOUR = 3_600_000


@_query(
    f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_ms(ts) AS t, (event_id % 9) * {HOUR} AS latency, event_type <> 'error' AS ok,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, 'miss' AS outcome, t + latency AS busy, CASE WHEN ok THEN t + latency END AS cached FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n,
CASE WHEN o.t < r.busy THEN 'coalesced' WHEN r.cached <= o.t AND o.t - r.cached <= {24 * HOUR} THEN 'hit' ELSE 'miss' END,
CASE WHEN o.t < r.busy OR coalesce(r.cached <= o.t AND o.t - r.cached <= {24 * HOUR}, false) THEN r.busy ELSE o.t + o.latency END,
CASE WHEN o.t < r.busy OR coalesce(r.cached <= o.t AND o.t - r.cached <= {24 * HOUR}, false) THEN r.cached WHEN o.ok THEN o.t + o.latency END
FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id AS request_id, user_id AS id, outcome FROM r"""
)
def coalesce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("id"),
        "ts",
        ((F.col("event_id") % 9) * HOUR).alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
    )
    return cache.replay_cache(log, 24 * HOUR, SITE).select("request_id", "id", "outcome")


@_query(
    f"""{ROUTED}, g AS (SELECT request_id, id, ts FROM r WHERE route = 'download' AND code IS NULL),
m AS (SELECT id, min(ts) AS ts FROM g GROUP BY id
UNION ALL SELECT m.id, min(g.ts) FROM m JOIN g ON g.id = m.id AND g.ts > m.ts + INTERVAL 24 HOUR GROUP BY m.id)
SELECT r.request_id, r.route, r.code, CASE WHEN g.request_id IS NULL THEN NULL WHEN m.ts IS NULL THEN 'hit' ELSE 'miss' END AS outcome
FROM r LEFT JOIN g ON g.request_id = r.request_id LEFT JOIN m ON m.id = g.id AND m.ts = g.ts""".replace("WITH e AS", "WITH RECURSIVE e AS", 1)
)
def replay_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = workloads.replay_requests(_targets(spark, sf_dir), None, SITE)
    return done.select("request_id", "route", F.col("error.code").alias("code"), "outcome")


@_query(
    """SELECT e.event_id, e.user_id AS id, c.n FROM events e JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) c ON c.user_id = e.user_id"""
)
def distinct_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"))
    results = cache.distinct_ids(requests).join(requests.groupBy("id").agg(F.count("*").alias("n")), "id")
    return cache.fan_out(requests, results).select("event_id", "id", "n")


# --- Payloads -----------------------------------------------------------------------------------------------------

_ENTRIES = """SELECT l_orderkey AS archive, l_linenumber AS ord, CASE l_partkey % 6 WHEN 0 THEN '../' WHEN 1 THEN 'd/' WHEN 2 THEN '/' ELSE '' END
|| 'f' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || CASE WHEN l_suppkey % 3 = 0 THEN '.txt' ELSE '.SRT' END || CASE WHEN l_suppkey % 11 = 0 THEN '/' ELSE '' END AS name,
l_suppkey % 11 = 0 AS is_dir FROM lineitem"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = F.col("l_partkey") % 6, F.col("l_suppkey")
    name = _text(
        F.when(part == 0, "../").when(part == 1, "d/").when(part == 2, "/").otherwise(""), "f", F.lpad(_s("l_partkey"), 9, "0"),
        F.when(supplier % 3 == 0, ".txt").otherwise(".SRT"), F.when(supplier % 11 == 0, "/").otherwise(""),
    )
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("archive_id"),
        F.col("l_linenumber").alias("ord"),
        name.alias("name"),
        (supplier % 11 == 0).alias("is_dir"),
        F.lit(False).alias("encrypted"),
        F.lit("zip").alias("format"),
        F.lit(None).cast("string").alias("problem"),
    )


@_query("SELECT l_orderkey AS archive_id, count(*) AS n_entries, CASE WHEN count(*) > 5 THEN 'Archive contains too many entries' END AS problem FROM lineitem GROUP BY l_orderkey")
def entry_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.guard_entry_count(_entries(spark, sf_dir), 5)


@_query(
    f"""SELECT archive AS archive_id, name, CAST(ord AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY name, ord) AS n FROM ({_ENTRIES})
WHERE NOT is_dir AND name NOT LIKE '../%' AND name NOT LIKE '/%' AND name LIKE '%.SRT') WHERE n = 1"""
)
def first_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.first_srt(_entries(spark, sf_dir)).select("archive_id", "name", F.col("ord").cast("int").alias("ord"))


@_query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'rar4' WHEN 2 THEN 'rar5' WHEN 3 THEN 'srt' WHEN 4 THEN 'zip' ELSE 'unsupported' END AS kind FROM documents")
def sniff_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    head = (
        F.when(kind == 0, F.unhex(F.lit("504B0304"))).when(kind == 1, F.unhex(F.lit("526172211A0700"))).when(kind == 2, F.unhex(F.lit("526172211A070100")))
        .when(kind == 3, F.lit(SRT).cast("binary")).when(kind == 4, F.unhex(F.lit("504B0506"))).otherwise(F.lit("x").cast("binary"))
    )
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))
    text = F.col("content").cast("string")
    return rows.select("doc_id", payload.sniff_payload(F.col("content"), text, SITE).alias("kind"))


@_query("SELECT doc_id, doc_id % 2 = 0 AS srt, CAST(20 * (doc_id % 4) - 10 * (doc_id % 3) - 5 * (doc_id % 2) AS INTEGER) AS score FROM documents")
def subtitle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda c, n: F.repeat(F.lit(c), (F.col("doc_id") % n).cast("int"))
    timing = F.when(F.col("doc_id") % 2 == 0, "\n12:00:01.5 -->　12:00:02,250\n").otherwise("\n12:00:01 --> 12:00:02,250\n")
    text = _text(F.col("text"), many("字", 4), many("�", 3), timing, many("\x01", 2))
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", looks_like_srt(F.col("t")).alias("srt"), decode_score(F.col("t")).alias("score"))


@_query(
    "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN repeat('Subtitles ', 8) || text ELSE text END AS text, "
    "CASE doc_id % 5 WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'utf-16le' ELSE 'utf-8' END AS encoding FROM documents"
)
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as UTF-8 and UTF-16, with marks and without. Without one, a text's first letters must look like UTF-16."""
    kind, text = F.col("doc_id") % 5, F.col("text")
    mark = lambda h, charset: F.concat(F.unhex(F.lit(h)), F.encode(text, charset))
    body = (
        F.when(kind == 0, text.cast("binary")).when(kind == 1, mark("EFBBBF", "UTF-8")).when(kind == 2, mark("FFFE", "UTF-16LE"))
        .when(kind == 3, mark("FEFF", "UTF-16BE")).otherwise(F.encode(_text(F.repeat(F.lit("Subtitles "), 8), text), "UTF-16LE"))
    )
    rows = _table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return payload.decode_bytes(rows, "body").select("doc_id", "text", "encoding")


@functools.cache
def _zipped():
    """An archive for each text: the text deflated as the first subtitle by name, and entries that mustn't be taken."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for text in texts:
                at = io.BytesIO()
                with zipfile.ZipFile(at, "w") as z:
                    z.writestr("../leaves.srt", "above")
                    z.writestr("vol2/part.srt", "later")
                    z.writestr("vol1/notes.txt", "no subtitle")
                    z.writestr("vol1/part.SRT", text or "", zipfile.ZIP_DEFLATED)
                out.append(at.getvalue())
            yield pd.Series(out)

    return run


@_query("SELECT CAST(doc_id AS VARCHAR) AS archive_id, 'vol1/part.SRT' AS name, md5(text) AS digest FROM documents")
def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("archive_id"), _zipped()("text").alias("content"))
    found = payload.extract_first_srt(archives, SITE)
    return found.select("archive_id", "name", F.md5("data").alias("digest"))


@functools.cache
def _damaged():
    """The archive with damage to the entry that is taken: its local header, a flag of encryption, or half its bytes."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, kinds in parts:
            out = []
            for content, kind in zip(contents, kinds, strict=True):
                data = bytearray(content)
                head = data.rindex(b"vol1/part.SRT") - 46  # its central header
                if kind == 1:
                    local = int.from_bytes(data[head + 42 : head + 46], "little")
                    data[local + 3] ^= 1
                elif kind == 2:
                    data[head + 8] |= 1
                elif kind == 3:
                    size = int.from_bytes(data[head + 20 : head + 24], "little")
                    data[head + 20 : head + 24] = (size // 2).to_bytes(4, "little")
                out.append(bytes(data))
            yield pd.Series(out)

    return run


@_query(
    """SELECT CAST(doc_id AS VARCHAR) AS archive_id, 'vol1/part.SRT' AS name, CASE WHEN doc_id % 4 = 0 THEN md5(text) END AS digest,
CASE doc_id % 4 WHEN 1 THEN 'Invalid ZIP local file header' WHEN 2 THEN 'Encrypted ZIP entries are not supported' WHEN 3 THEN 'Compressed data ends early' END AS problem
FROM documents"""
)
def broken_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four archives are damaged; each is a row with its problem and without data."""
    archives = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("archive_id"), _damaged()(_zipped()("text"), (F.col("doc_id") % 4).cast("int")).alias("content")
    )
    found = payload.extract_first_srt(archives, SITE)
    return found.select("archive_id", "name", F.md5("data").alias("digest"), "problem")


_TO_CJK = "的一是在不了有和人这中大为上个国我以要他时来用们生到"
_CJK_TEXT = f"""SELECT doc_id, translate(regexp_replace(text, '[^\\x00-\\x7F]', '字', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{_TO_CJK}') AS text FROM documents"""


@functools.cache
def _gb18030():
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: t.encode("gb18030"))

    return run


@_query(f"SELECT doc_id, text || '，' AS text, 'gb18030' AS encoding FROM ({_CJK_TEXT})")
def decode_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, their letters turned into Chinese characters, as GB18030 bytes without any mark."""
    text = F.translate(F.regexp_replace("text", r"[^\x00-\x7F]", "字"), "abcdefghijklmnopqrstuvwxyz", _TO_CJK)
    rows = _table(spark, sf_dir, "documents").select("doc_id", _gb18030()(_text(text, "，")).alias("body"))
    return payload.decode_bytes(rows, "body").select("doc_id", "text", "encoding")


@_query("SELECT CAST(doc_id AS VARCHAR) AS key, to_base64(encode(text)) AS value, CAST(90 AS BIGINT) AS expires_s FROM documents")
def kv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_kv(_table(spark, sf_dir, "documents").select(_s("doc_id").alias("id"), "text"), 90_999, SITE)


def _resolution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, requests, captures and archives: by doc_id % 6 a ZIP behind a redirect, a plain file, no archive, a page
    without a link, no page, and a bad id. Files and archives hold the whole text."""
    docs = _table(spark, sf_dir, "documents").withColumns({"k": F.col("doc_id") % 6, "id": _s("doc_id")})
    requests = docs.select(
        F.col("doc_id").alias("request_id"), F.when(F.col("k") == 5, _text("x", F.col("id"))).otherwise(F.col("id")).alias("id"),
        (F.col("doc_id") % 10).alias("instance"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts"),
    )
    detail = _text(f"{SITE.origin}/sub/", F.col("id"), ".html")
    link = _text("http://file1.subs.example/download/", F.col("id"), "/s.zip")
    body = F.when(F.col("k") == 3, "<p>nothing</p>").otherwise(_text('<a href="', link, '">x</a>')).cast("binary")
    none = lambda t: F.lit(None).cast(t)
    shape = lambda url, status, location, body: docs.select(
        "k", url.alias("url"), F.lit(status).alias("status"), location.alias("location"), none("long").alias("content_length"), body.alias("body")
    )
    lost = shape(_text(f"{SITE.origin}/xml/sub/", F.substring("id", 1, 3), "/", F.col("id"), ".xml"), 404, none("string"), none("binary"))
    lost2 = shape(_text(f"{SITE.origin}/sub/", F.col("id")), 404, none("string"), none("binary"))
    lost3 = shape(_text(f"{SITE.origin}/xml/sub/", F.col("id"), "/", F.col("id"), ".xml"), 404, none("string"), none("binary"))
    page = shape(detail, 200, none("string"), body).where("k <> 4")
    seen = shape(_text(f"{SITE.origin}/sub/", F.col("id"), "/known.html"), 200, none("string"), body).where("k = 4")
    moved = shape(_text("https://file1.subs.example/download/", F.col("id"), "/s.zip"), 302, _text("https://file2.subs.example/f/", F.col("id")), none("binary")).where("k = 0")
    captures = lost.unionByName(lost2).unionByName(lost3.where(F.length(F.regexp_extract("url", "([0-9]+)\\.xml$", 1)) > 3)).where("k <> 4")
    captures = captures.unionByName(page).unionByName(moved).unionByName(seen).drop("k")
    content = (
        F.when(F.col("k") == 0, _zipped()("text")).when(F.col("k").isin(1, 4), _text(SRT, F.col("text")).cast("binary")).otherwise(F.lit("no archive").cast("binary"))
    )
    at = F.when(F.col("k") == 0, _text("https://file2.subs.example/f/", F.col("id"))).otherwise(_text("https://file1.subs.example/download/", F.col("id"), "/s.zip"))
    archives = docs.where("k in (0, 1, 2, 4)").select(at.alias("url"), content.alias("content"))
    return docs, requests, captures, archives


@_query(
    """SELECT doc_id AS request_id, CASE WHEN doc_id % 6 = 5 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id,
CASE WHEN doc_id % 6 = 0 THEN 'vol1/part.SRT' WHEN doc_id % 6 = 1 THEN 'subtitle.srt' END AS name,
CASE WHEN doc_id % 6 = 0 THEN md5(text) WHEN doc_id % 6 = 1 THEN md5('1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text) END AS digest,
CASE doc_id % 6 WHEN 2 THEN 'INVALID_ARCHIVE' WHEN 3 THEN 'SUBTITLE_NOT_FOUND' WHEN 4 THEN 'UPSTREAM_ERROR' WHEN 5 THEN 'INVALID_ID' END AS code FROM documents"""
)
def resolve_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to subtitles without a cache or known URLs; digests come from the table of subtitles."""
    _, requests, captures, archives = _resolution(spark, sf_dir)
    served, made = workloads.resolve_subtitles(requests, captures, archives, SITE)
    texts = made.select("id", "name", F.md5(F.col("text").cast("binary")).alias("digest"))
    return served.join(texts, "id", "left").select("request_id", "id", "name", "digest", F.col("error.code").alias("code"))


@_query(
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 4 AS c, strlen(text) AS n, CAST(doc_id AS VARCHAR) AS t FROM documents)
SELECT doc_id AS request_id, CASE WHEN k = 5 THEN 'x' || t ELSE t END AS id,
CASE WHEN k = 5 THEN NULL WHEN c = 1 THEN 'cache' WHEN k IN (0, 1) OR k = 4 AND doc_id % 10 <> 2 THEN 'site' END AS source,
CAST(CASE WHEN k = 5 THEN NULL WHEN c = 1 THEN n WHEN k = 0 THEN n WHEN k = 1 OR k = 4 AND doc_id % 10 <> 2 THEN n + 32 END AS BIGINT) AS n_bytes,
CASE WHEN k = 5 THEN 'INVALID_ID' WHEN c = 1 THEN NULL WHEN k = 2 THEN 'INVALID_ARCHIVE' WHEN k = 3 THEN 'SUBTITLE_NOT_FOUND'
WHEN k = 4 AND doc_id % 10 = 2 THEN 'UPSTREAM_ERROR' END AS code FROM d"""
)
def resolve_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: a quarter of the ids has a fresh cached subtitle and another a stale one; ids whose pages aren't
    captured are found by the detail URL of their process's last search, but for one process that searched again."""
    docs, requests, captures, archives = _resolution(spark, sf_dir)
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    age = F.when(F.col("doc_id") % 4 == 1, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 25 HOURS"))
    cached = docs.where("doc_id % 2 = 1").select("id", (now - age).alias("cached_at"), F.octet_length("text").alias("n_bytes"))
    instance = F.col("doc_id") % 10
    searches = docs.select(instance.alias("instance")).distinct().select(
        F.explode(F.when(F.col("instance") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"), "instance"
    ).select(
        (F.col("instance") * 2 + F.col("n")).alias("search_id"), "instance",
        (F.lit("2024-01-01 10:00:00").cast("timestamp") + F.col("n") * F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(True).alias("ok"),
    )
    details = docs.where("k = 4").select((instance * 2).alias("search_id"), "id", _text(f"{SITE.origin}/sub/", F.col("id"), "/known.html").alias("detail_url"))
    served, _ = workloads.resolve_subtitles(requests, captures, archives, SITE, cached=cached, now=now, searches=searches, details=details)
    return served.select("request_id", "id", "source", "n_bytes", F.col("error.code").alias("code"))


@_query(
    f"""{ROUTED},
o AS (SELECT r.request_id, r.id, epoch_ms(r.ts) AS t, (e.event_id % 9) * {HOUR} AS latency, e.event_type <> 'error' AS ok,
row_number() OVER (PARTITION BY r.id ORDER BY r.ts, r.request_id) AS n FROM r JOIN events e ON e.event_id = r.request_id WHERE r.route = 'download' AND r.code IS NULL),
x AS (SELECT id, request_id, n, 'miss' AS outcome, t + latency AS busy, CASE WHEN ok THEN t + latency END AS cached FROM o WHERE n = 1
UNION ALL SELECT o.id, o.request_id, o.n,
CASE WHEN o.t < x.busy THEN 'coalesced' WHEN x.cached <= o.t AND o.t - x.cached <= {24 * HOUR} THEN 'hit' ELSE 'miss' END,
CASE WHEN o.t < x.busy OR coalesce(x.cached <= o.t AND o.t - x.cached <= {24 * HOUR}, false) THEN x.busy ELSE o.t + o.latency END,
CASE WHEN o.t < x.busy OR coalesce(x.cached <= o.t AND o.t - x.cached <= {24 * HOUR}, false) THEN x.cached WHEN o.ok THEN o.t + o.latency END
FROM x JOIN o ON o.id = x.id AND o.n = x.n + 1)
SELECT r.request_id, x.outcome FROM r LEFT JOIN x ON x.request_id = r.request_id""".replace("WITH e AS", "WITH RECURSIVE e AS", 1)
)
def replay_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay of the whole log with latencies and failures; percent-encoded ids lead to others, which plain requests have too."""
    events = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), ((F.col("event_id") % 9) * HOUR).alias("latency_ms"), (F.col("event_type") != "error").alias("ok")
    )
    log = _targets(spark, sf_dir).join(events, "request_id")
    return workloads.replay_requests(log, 24 * HOUR, SITE).select("request_id", "outcome")
