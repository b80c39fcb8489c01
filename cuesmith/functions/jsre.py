"""Text rules of JavaScript that Java's regular expressions and Spark's functions have otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript knows it.
SPACES = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACES}]"
#: Any character that ``.`` matches.
DOT = r"[^\n\r\x{2028}\x{2029}]"
#: Edges of an ASCII word; ``\b`` would see letters of all scripts.
NOT_AFTER_WORD, NOT_BEFORE_WORD = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def js_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def nonempty(text: Column) -> Column:
    """Null for an empty text, as ``||`` would pass over it."""
    return F.when(text != "", text)
