"""Texts of cards and subtitles, with built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import DEFAULT, SiteProfile
from .jsre import DOT, NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, js_trim, nonempty

_TIME = r"[0-9]{1,3}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}"


def normalize_text(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return js_trim(F.regexp_replace(text, f"{WS}+", " "))


def labeled_value(text: Column, label: str, profile: SiteProfile = DEFAULT) -> Column:
    """What follows ``label:`` up to the next label, a date, an age in weeks or the end; null without the label, maybe ''."""
    stops = "|".join(map(re.escape, profile.labels))
    head = f"{label}{WS}*[：:]{WS}*"
    value = (
        rf"{head}({DOT}*?)(?={WS}*(?:{stops}){WS}*[：:]|{WS}+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:{WS}|\z)"
        rf"|{WS}+[0-9]+周前(?:{WS}|\z)|\z)"
    )
    return F.when(text.rlike(value), normalize_text(F.regexp_extract(text, value, 1)))


def labeled_pairs(text: Column, profile: SiteProfile = DEFAULT) -> Column:
    """All labels of a normal text with their values, in order, from one scan: ``array<struct<label, value>>``.

    A value ends as in ``labeled_value``: a label with its colon always ends one and begins the next.
    """
    labels, colon = f"(?:{'|'.join(map(re.escape, profile.labels))})", " ?[：:]"
    ends = rf" ?{labels}{colon}| [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?: |\z)| [0-9]+周前(?: |\z)|\z"
    found = F.regexp_extract_all(text, F.lit(rf"(?s){labels}{colon} ?.*?(?={ends})"), F.lit(0))
    halves = F.transform(found, lambda x: F.split(x, "[：:]", 2))
    return F.transform(halves, lambda x: F.struct(F.trim(x[0]).alias("label"), F.trim(x[1]).alias("value")))


def pair_value(pairs: Column, text: Column, label: str, profile: SiteProfile = DEFAULT) -> Column:
    """``labeled_value`` of a normal text from its pairs; a label that ends another one takes that one's value too."""
    if label not in profile.labels:
        return labeled_value(text, label, profile)
    return F.get(F.filter(pairs, lambda p: F.endswith(p["label"], F.lit(label))), F.lit(0))["value"]


def first_date(text: Column) -> Column:
    """The first bare YYYY-MM-DD, '' if there is none."""
    return F.regexp_extract(text, rf"{NOT_AFTER_WORD}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){NOT_BEFORE_WORD}", 1)


def first_nonempty(*options: Column) -> Column:
    """The first that is neither null nor '', else the last as it is."""
    return F.coalesce(*[nonempty(x) for x in options[:-1]], options[-1])


def looks_like_srt(text: Column) -> Column:
    """Whether a timing line stands anywhere in the text."""
    return text.rlike(f"{_TIME}{WS}*-->{WS}*{_TIME}")


_SRT = re.compile(re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", f"{_TIME}{WS}*-->{WS}*{_TIME}"))


def is_srt_text(text: str) -> bool:
    """``looks_like_srt`` of a text that is in Python already."""
    return bool(_SRT.search(text))


def decode_score(text: Column) -> Column:
    """How much a decoded text looks like Chinese, Japanese or Korean, less its replacement and control characters."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (
        count(r"[\x{3400}-\x{9fff}]") * 20
        - count(r"\x{fffd}") * 10
        - count(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") * 5
    )
