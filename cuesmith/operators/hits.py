"""Result pages to rows of hits, detail pages to download links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import detail_cards, parse_page, resolved_links
from ..functions.jsre import nonempty
from ..functions.text import first_date, first_nonempty, labeled_pairs, normalize_text, pair_value
from ..functions.urls import is_download, on_site, resolve_url, subtitle_id
from ..profile import DEFAULT, SiteProfile

HIT = ["id", "title", "version", "format", "language", "date", "detail_url"]


def hit_fields(text: Column, pairs: Column, anchor: Column, b_version: Column, profile: SiteProfile = DEFAULT) -> dict[str, Column]:
    """A card's fields from its normal text, the labelled values in it, its detail anchor (title, text) and its bold version."""
    label = lambda x: pair_value(pairs, text, x, profile)
    version = F.coalesce(b_version, F.lit(""))
    return {
        "title": nonempty(normalize_text(F.coalesce(nonempty(anchor["title"]), anchor["text"]))),
        "version": F.when(version != "", normalize_text(version)).otherwise(label(profile.version_label)),
        "language": first_nonempty(*map(label, profile.language_labels)),
        "date": nonempty(first_nonempty(*map(label, profile.date_labels), first_date(text))),
    }


def only_srt(cards: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    return cards.where(F.lower("format") == profile.wanted_format)


def parse_hits(pages: DataFrame, profile: SiteProfile = DEFAULT, html: str = "html") -> DataFrame:
    """Pages -> a row for each wanted card, in page order by ``pos``, with the pages' other columns.

    A card counts if its format is the wanted one and its first link to a detail page resolves to https on the
    site and carries an id. Pages are parsed once each, in one Python pass, and a card's text is scanned once for all
    labels; nothing is shuffled. Null pages give no rows.
    """
    keep = [c for c in pages.columns if c != html]
    with_text = F.transform(detail_cards(F.col(html), profile), lambda c: c.withField("text", normalize_text(c["text"])))
    # Above the generator, so that no filter below makes the scan for labels run twice.
    with_pairs = F.transform(with_text, lambda c: F.struct(c.alias("card"), labeled_pairs(c["text"], profile).alias("pairs")))
    cards = pages.select(*keep, F.posexplode(with_pairs).alias("pos", "__c"))
    text, pairs, link = F.col("__c.card.text"), F.col("__c.pairs"), F.col("__c.card.link")
    wanted = only_srt(cards.withColumn("format", pair_value(pairs, text, profile.format_label, profile)), profile)
    good = wanted.where((link["scheme"] == "https") & on_site(link["host"], profile)).withColumns(
        {"id": subtitle_id(link["path"]), "detail_url": link["url"]}
    )
    anchor = F.struct(F.col("__c.card.title").alias("title"), F.col("__c.card.anchor").alias("text"))
    fields = hit_fields(text, pairs, anchor, F.col("__c.card.b_version"), profile)
    return good.where("id is not null").withColumns(fields).select(*keep, "pos", *HIT)


def page_links(pages: DataFrame, html: str = "html", url: str = "url", profile: SiteProfile = DEFAULT) -> DataFrame:
    """Pages -> a row for each link that resolves, in order by ``pos``: ``link`` with url, scheme, host and path."""
    keep = [c for c in pages.columns if c != html]
    parsed = pages.select(*keep, parse_page(F.col(html), profile).alias("__page"))
    links = parsed.select(*keep, F.posexplode("__page.links").alias("pos", "href"))
    useful = links.where("href <> '' and href <> '#'")
    return useful.withColumn("link", resolve_url(F.col("href"), F.col(url))).where("link.url is not null").drop("href")


def first_download_link(pages: DataFrame, html: str = "html", url: str = "url", profile: SiteProfile = DEFAULT) -> DataFrame:
    """Pages -> their first link to a subtitle file or archive: ``url, download_url``, null where a page has none.

    One row per page, in the page's row: nothing is shuffled.
    """
    links = pages.select(url, resolved_links(F.col(html), F.col(url), profile).alias("__links"))
    first = F.get(F.filter("__links", lambda x: is_download(x, profile)), F.lit(0))
    return links.select(url, first["url"].alias("download_url"))


def latest_detail(hits: DataFrame) -> DataFrame:
    """``hits(search_id, page_no, pos, id, detail_url)`` -> the last URL of each id in each search."""
    return hits.groupBy("search_id", "id").agg(F.max_by("detail_url", F.struct("page_no", "pos")).alias("detail_url"))
