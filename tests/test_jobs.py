"""The jobs end to end over small captures."""

from __future__ import annotations

from cuesmith.jobs import workloads
from cuesmith.profile import SiteProfile

SITE = SiteProfile()
CAPTURES = "url string, status int, location string, content_length long, body binary"


def page(i: int) -> bytes:
    return f'<div class="resultcard"><div class="subitem"><a href="/sub/{i}/x">T{i}</a><p>格式：Subrip(srt)</p></div></div>'.encode("gb18030")


def test_searches_to_hits(spark):
    at = f"{SITE.origin}/sub/?searchword="
    rows = [
        (f"{at}a+b", 200, None, None, page(1)),
        (f"{at}a+b&page=2", 302, "/moved", None, None),
        (f"{SITE.origin}/moved", 200, None, None, page(2)),
        (f"{at}gone", 404, None, None, None),
        (f"{at}large", 200, None, SITE.max_page_bytes + 1, page(3)),
    ]
    asked = [(1, " a b ", None), (2, "a b", "2"), (3, "gone", None), (4, "large", None), (5, "", None), (6, "x", "0"), (7, "never", "1")]
    hits, state = workloads.harvest_searches(
        spark.createDataFrame(asked, "search_id long, q string, page string"), spark.createDataFrame(rows, CAPTURES), SITE
    )
    assert {(r["search_id"], r["page_no"], r["id"]) for r in hits.collect()} == {(1, 1, "1"), (2, 2, "2")}
    assert {r["search_id"]: r["error"] and r["error"]["code"] for r in state.collect()} == {
        1: None, 2: None, 3: "UPSTREAM_NOT_FOUND", 4: "UPSTREAM_TOO_LARGE", 5: "INVALID_QUERY", 6: "INVALID_PAGE", 7: "UPSTREAM_ERROR",
    }


def _one(spark, content: bytes, profile: SiteProfile, **more) -> tuple:
    """One id, whose page links to this content."""
    link = f"{profile.origin}/download/55/s.zip"
    captures = spark.createDataFrame([(f"{profile.origin}/sub/55.html", 200, None, None, f'<a href="{link}">x</a>'.encode())], CAPTURES)
    archives = spark.createDataFrame([(link, content)], "url string, content binary")
    requests = spark.createDataFrame([(1, "55"), (2, "55"), (3, "5x")], "request_id long, id string")
    return workloads.resolve_subtitles(requests, captures, archives, profile, **more)


def test_one_subtitle_serves_all_its_requests(spark, tmp_path):
    from cuesmith.sources import io

    text = "1\n0:00:01,5 --> 0:00:02,5\nrain\n"
    served, made = _one(spark, text.encode(), SITE)
    assert {r["request_id"]: (r["source"], r["n_bytes"], r["error"] and r["error"]["code"]) for r in served.collect()} == {
        1: ("site", len(text), None), 2: ("site", len(text), None), 3: (None, None, "INVALID_ID"),
    }
    assert "text" not in served.columns and [(r["id"], r["text"]) for r in made.collect()] == [("55", text)]
    io.write_subtitles(made, str(tmp_path / "subtitles"))
    assert spark.read.parquet(str(tmp_path / "subtitles")).select("id", "encoding").collect() == [("55", "utf-8")]


def test_texts_that_grow_too_large_in_utf8(spark):
    text = "1\n0:00:01,5 --> 0:00:02,5\n" + "雨" * 100
    data = b"\xff\xfe" + text.encode("utf-16-le")
    served, made = _one(spark, data, SiteProfile(max_srt_bytes=len(data)))
    assert {r["error"]["code"] for r in served.where("id = '55'").collect()} == {"SRT_TOO_LARGE"} and made.count() == 0


def test_outcomes_by_day(spark, tmp_path):
    from datetime import datetime

    from cuesmith.sources import io

    log = [(i, datetime(2024, 1, 1 + i), "GET", t, "p") for i, t in enumerate(["/download/7", "/download/x", "/search?q=a"])]
    df = spark.createDataFrame(log, "request_id long, ts timestamp, method string, target string, instance string")
    searches = spark.createDataFrame([(1, "p", datetime(2023, 12, 1), True)], "search_id long, instance string, ts timestamp, ok boolean")
    details = spark.createDataFrame([(1, "7", "https://subs.example/sub/7/k")], "search_id long, id string, detail_url string")
    io.write_outcomes(workloads.replay_requests(df, None, SITE, searches, details), str(tmp_path / "out"))
    back = {r["request_id"]: (str(r["day"]), r["outcome"], r["code"], r["known"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert back == {0: ("2024-01-01", "miss", None, "https://subs.example/sub/7/k"), 1: ("2024-01-02", None, "INVALID_ID", None), 2: ("2024-01-03", None, None, None)}


def test_a_page_is_parsed_once_for_all_searches(spark):
    """Three searches for one page and one for another, that both end at the same one: bodies meet no search."""
    at = f"{SITE.origin}/sub/?searchword="
    captures = spark.createDataFrame([(f"{at}a", 200, None, None, page(7)), (f"{at}b", 302, f"{at}a", None, None)], CAPTURES)
    searches = spark.createDataFrame([(1, "a", None), (2, "a", "1"), (3, " a ", ""), (4, "b", None), (5, "", None), (6, "c", None)], "search_id long, q string, page string")
    hits, state = workloads.harvest_searches(searches, captures, SITE)
    assert sorted((r["search_id"], r["id"]) for r in hits.collect()) == [(1, "7"), (2, "7"), (3, "7"), (4, "7")]
    assert {r["search_id"]: r["error"] and r["error"]["code"] for r in state.collect()} == {1: None, 2: None, 3: None, 4: None, 5: "INVALID_QUERY", 6: "UPSTREAM_ERROR"}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    parse = next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = [x for x in lines[parse + 1 :] if depth(x) > depth(lines[parse])]
    assert below and not any("search_id" in x for x in below)  # searches join above the parse
