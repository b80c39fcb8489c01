"""Result pages, detail pages and their URLs. Pages are put together from parts, so that each rule stands in one place."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from cuesmith.functions import html, text, urls
from cuesmith.operators import hits
from cuesmith.profile import SiteProfile

SITE = SiteProfile()
AT = SITE.origin
SRT = "格式：Subrip(srt)"


def card(link: str, *lines: str, name: str = "River", attributes: str = "") -> str:
    """A result card: a link and a list of lines, as one might see them in the wild, unclosed items included."""
    items = "".join(f"<li>{x} " for x in lines)
    return f'<article class="subitem wide"{attributes}><h3><a href="{link}">{name}</a></h3><ul>{items}</ul></article>'


def page(*cards: str, outside: str = "") -> str:
    return f'<!doctype html><body><div class="list resultcard">{"".join(cards)}</div>{outside}</body>'


def found(spark, source: str | None) -> list[dict]:
    df = spark.createDataFrame([(1, source)], "page_id long, html string")
    return [r.asDict() for r in hits.parse_hits(df, SITE).orderBy("pos").collect()]


def test_cards_are_taken_by_format_and_place(spark):
    rows = found(
        spark,
        page(
            card("/sub/501/a", SRT, attributes=' id="top-banner"'),
            card("/sub/502/b", "格式：SubStation Alpha"),
            card("/sub/0503/c", "格式： SUBRIP(SRT)"),
            card("/sub/504/d"),
            f"<section>{card('/sub/505/e', SRT)}</section>",
            card("/sub/506/f", SRT),
            card("/sub/507/g", SRT, attributes=' id="bottom-banner"'),
            outside=card("/sub/508/h", SRT),
        ),
    )
    # Only wanted formats, directly under the list, banners aside; leading zeros and the format's own case stay.
    assert [(r["id"], r["format"]) for r in rows] == [("0503", "SUBRIP(SRT)"), ("506", "Subrip(srt)")]
    assert found(spark, None) == found(spark, "") == []


@pytest.mark.parametrize(
    ("lines", "field", "want"),
    [
        ([SRT, "语言：法 德"], "language", "法 德"),
        ([SRT, "语种：法"], "language", "法"),
        ([f"{SRT}语言：法 德来源：自译"], "language", "法 德"),
        ([SRT, "语言： 来源：自译"], "language", None),
        ([SRT], "language", None),
        ([SRT, "日期：3小时前"], "date", "3小时前"),
        ([SRT, "发布时间：2031-07-09 08:07:06"], "date", "2031-07-09 08:07:06"),
        ([SRT, "2031-07-09"], "date", "2031-07-09"),
        ([SRT, "来源：no12031-07-09"], "date", None),
        ([SRT, "日期： 5周前"], "date", "5周前"),
        ([SRT, "版本：River.2031.WEB 下载次数：9"], "version", "River.2031.WEB"),
        ([SRT, "版本：River 2031-07-09"], "version", "River"),
        ([SRT], "version", None),
    ],
)
def test_labelled_fields(spark, lines, field, want):
    (row,) = found(spark, page(card("/sub/601/x", *lines)))
    assert row[field] == want


def test_bold_version_comes_before_its_label(spark):
    boxed = f'<article class="subitem"><a href="/sub/701/x">River</a><p id="meta_top">版本：<i><b>River.S02</b></i> {SRT} 语言：德</p></article>'
    titled = f'<article class="subitem"><a href="/sub/702/x">River</a><span class="sublist_box_title_l">t</span><div><b>River.S03</b></div><p>{SRT} 版本：other</p></article>'
    first, second = found(spark, page(boxed, titled))
    assert (first["version"], first["language"], second["version"]) == ("River.S02", "德", "River.S03")


@pytest.mark.parametrize(
    ("link", "id_", "url"),
    [
        ("/sub/801/r.html", "801", f"{AT}/sub/801/r.html"),
        ("//mirror.subs.example/sub/802.htm", "802", "https://mirror.subs.example/sub/802.htm"),
        ("/xml/sub/8/803.xml", "803", f"{AT}/xml/sub/8/803.xml"),
        ("https://SUBS.example:443/sub/804/x", "804", f"{AT}/sub/804/x"),
        ("/sub/805", None, None),
        (f"http://{SITE.site}/sub/806/x", None, None),
        ("https://notsubs.example/sub/807/x", None, None),
        ("https://[/sub/808/x", None, None),
    ],
)
def test_detail_links(spark, link, id_, url):
    rows = found(spark, page(card(link, SRT)))
    assert [(r["id"], r["detail_url"]) for r in rows] == ([(id_, url)] if id_ else [])


def test_titles_and_repeated_ids(spark):
    named = '<article class="subitem"><a title="  Deep\n River " href="/sub/901/x">r</a>' + SRT + "</article>"
    rows = found(spark, page(named, card("/sub/901/y", SRT, name="<em>Deep</em> &amp; wide"), card("/sub/901/z", SRT, name=" ")))
    assert [(r["id"], r["title"]) for r in rows] == [("901", "Deep River"), ("901", "Deep & wide"), ("901", None)]


def test_links_in_order_with_click_targets():
    parts = ['<a href="/one">1</a>', """<a onclick="go(); location.href = '/two'" href="#two">2</a>""", "<a>none</a>", """<a onclick='location.href="/three"'>3</a>"""]
    assert html.parse("<p>".join(parts))["links"] == ["/one", "#two", "/two", "/three"]


GOOD = {"/download/31/r.srt": f"{AT}/download/31/r.srt", "https://m.subs.example/download/32.RAR?k=v": "https://m.subs.example/download/32.RAR?k=v", "http://file7.subs.example/download/33/r.zip": "http://file7.subs.example/download/33/r.zip"}
BAD = ["https://subs.example.org/download/34.zip", "http://subs.example/download/35.zip", "/download/36.txt", "/download/.zip", "", "#"]


@pytest.mark.parametrize("good", [*GOOD, None])
def test_first_download_link(spark, good):
    """The first good link wins, wherever the bad ones stand."""
    pages = []
    for i, order in enumerate(itertools.islice(itertools.permutations(BAD), 0, 720, 144)):
        links = list(order[:3]) + ([good, "/download/99.zip"] if good else []) + list(order[3:])
        pages.append((f"{AT}/sub/{i}.html", "".join(f'<a href="{x}">x</a>' for x in links)))
    got = hits.first_download_link(spark.createDataFrame([*pages, (f"{AT}/sub/none.html", None)], "url string, html string"), profile=SITE)
    assert {r["url"]: r["download_url"] for r in got.collect()} == {u: GOOD.get(good) for u, _ in pages} | {f"{AT}/sub/none.html": None}


def test_click_target_is_a_download_link(spark):
    source = """<a href="#" onclick="location.href='/download/41/r.rar'">get</a><a href="/download/42.zip">other</a>"""
    df = spark.createDataFrame([(f"{AT}/sub/4.html", source)], "url string, html string")
    assert hits.first_download_link(df, profile=SITE).first()["download_url"] == f"{AT}/download/41/r.rar"


@pytest.mark.parametrize(
    ("link", "base", "want"),
    [
        ("//X.Example:443/a/../b c?x=1 2#f", "https://s/", "https://x.example/b%20c?x=1%202#f"),
        ("?q", "https://s/a/b?z", "https://s/a/b?q"),
        ("\\a\\b", "https://s/x/y", "https://s/a/b"),
        ("  /a\n/b ", "https://s/x", "https://s/a/b"),
        ("HTTP://H:8080", "https://s/x", "http://h:8080/"),
        ("/é", "https://s/x", "https://s/%C3%A9"),
        ("http://a b/", "https://s/x", None),
        ("http://[bad", "https://s/x", None),
        (None, "https://s/x", None),
    ],
)
def test_resolve(link, base, want):
    got = urls.resolve(link, base)
    assert (got and got[0]) == want


def test_text_rules(spark):
    rows = spark.createDataFrame([("a 　 b\n",), ("日期2031-07-09後",), ("12031-07-09",)], "t string")
    got = rows.select(text.normalize_text(F.col("t")).alias("n"), text.first_date(F.col("t")).alias("d")).collect()
    assert got[0]["n"] == "a b" and [r["d"] for r in got] == ["", "2031-07-09", ""]


def test_latest_detail_takes_the_last(spark):
    rows = [(1, 1, 0, "5", "a"), (1, 1, 2, "5", "b"), (1, 2, 0, "5", "c"), (2, 1, 0, "5", "d")]
    df = spark.createDataFrame(rows, "search_id long, page_no int, pos int, id string, detail_url string")
    assert {(r["search_id"], r["detail_url"]) for r in hits.latest_detail(df).collect()} == {(1, "c"), (2, "d")}


def test_references_without_a_semicolon_stay(spark):
    """A title that was cut within one; closed ones are characters, unknown ones aren't."""
    source = '<title>a &amp; b&amp</title><p title="c&copy">&#65; &#x42;&#67 &nope; &copyx; & x&lt;y</p><a href="/z?a=1&copy=2&amp;b=3">l</a>'
    page = spark.createDataFrame([(source,)], "html string").select(html.parse_page(F.col("html"), SITE).alias("p")).first()["p"]
    assert page["text"] == "a & b&ampA B&#67 &nope; &copyx; & x<yl"
    assert page["links"] == ["/z?a=1&copy=2&b=3"]


def test_plain_pages_and_links_are_read_as_others():
    """Tags and URLs of the plainest form are taken at once; a comment, or a dot in the path, sends them the long way."""
    whole = "<section class='resultcard'>".replace("'", '"') + card("/sub/7/x?a=1&amp;b=2", SRT, "<b>版本</b>：<i>x</i>", name="River &lt;2") + "</section><p>a<p>b"
    fast, slow = html._read(whole, SITE), html._read(whole + "<!-- -->", SITE)
    assert html._Page(SITE).feed_plain(html._closed(whole)) and not html._Page(SITE).feed_plain(whole + "<!-- -->")
    assert (fast.cards, fast.links, fast.text) == (slow.cards, slow.links, slow.text) and len(fast.cards) == 1
    for link in ("/sub/7/x?a=1", "//file0.subs.example/a.zip", "http://subs.example/d/e/", "/"):
        url, *rest = urls.resolve(link, f"{AT}/q/r?s#t")
        assert urls._PLAIN.fullmatch(link) and not urls._PLAIN.fullmatch(link + "#")
        assert urls.resolve(link + "#", f"{AT}/q/r?s#t") == (url, *rest)


def test_a_small_table_of_pages_is_many_tasks(spark, sf_dir):
    from cuesmith.jobs import catalog

    assert catalog.first_download_link(spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
