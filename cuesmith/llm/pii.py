"""Personal data: fixed rules, and identifiers that bootstrapped contexts find."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, materialize, row_hash, small_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Patterns start where a leftmost match can: at the head of a run of digits, at a plus sign, at an at sign. No run
#: is then read more than a few times, however long.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: An identifier that no fixed rule knows: a token with so many digits, or with an at sign between letters or digits.
_REST = re.compile(r"[0-9@][^\x20\x09-\x0D]*+")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
MIN_DIGITS = 5
#: A pattern is a hull of one or two words that identifiers of a kind fill. It is trusted if SUPPORT distinct instances
#: fill it, if instances make up MIN_PATTERN of the identifiers of their type that do, and if identifiers make up
#: MIN_FILL of all that stands there in the corpus. Values of a confidence of MIN_INSTANCE are instances in turn.
SUPPORT, MIN_PATTERN, MIN_FILL, MIN_INSTANCE, ROUNDS = 5, 0.5, 0.25, 0.5, 4
#: A longer word is known by its digest.
LONG_WORD = 64
#: Words that patterns ask for and that are sent to all tasks; of more, all words are counted.
MOST_ASKED = 100_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed rules, by start and then kind as listed."""
    found = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                found.append((a, m.end(), 0))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


_EDGE = ".,;:!?\"'()[]{}<>|*&%$#"


#: What parts the pieces of a token: CSV rows, minified JSON, query strings.
_CUT = r",;:=|&?<>{}\[\]\"'/()#*!$~^`\\"
_SIGNS = frozenset(",;:=|&?<>{}[]\"'/()#*!$~^`\\")
_PIECE = re.compile(rf"[^\x20\x09-\x0D{_CUT}]++")
_INNER = re.compile(rf"[{_CUT}]")
#: Tokens of digits and their punctuation that follow each other on a line, each but for one space or tab.
_NUMBERS = re.compile(r"(?<![^\x20\x09-\x0D])[0-9().+/-]*+(?<=[0-9().+/-])(?:[\x20\t][0-9().+/-]++)+(?![^\x20\x09-\x0D.,;:!?])")
_AROUND = _SIGNS | frozenset(_EDGE)
_NEXT = re.compile(r"[\x20\x09\x0B-\x0D]+([^\x20\x09-\x0D]+)")


def _word_before(text: str, a: int) -> tuple[int, int] | None:
    """The last word that ends before the place a, on its line."""
    while a and text[a - 1] in "\t\x0b\x0c\r ":
        a -= 1
    b = a
    while a and text[a - 1] not in _SPACES:
        a -= 1
    return (a, b) if a < b else None


def _piece_before(text: str, a: int) -> tuple[int, int] | None:
    """The piece before the place a in its token, with the signs between; none if the token has none."""
    lo = a
    while lo and text[lo - 1] in _SIGNS:
        lo -= 1
    x = lo
    while x and text[x - 1] not in _SIGNS and text[x - 1] not in _SPACES:
        x -= 1
    return (x, a) if x < lo else None


def _before(text: str, a: int) -> tuple[int, int] | None:
    """What stands before the place a on its line: the piece before in its token, at a token's edge the word before."""
    if piece := _piece_before(text, a):
        return piece
    while a and text[a - 1] in _SIGNS:
        a -= 1
    return _word_before(text, a)


def _neighbours(text: str, a: int, b: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """Places of the neighbours on the same line; none at a line's edge.

    Within a token these are the piece before with the signs between, and the signs with the piece after; at a
    token's edge the next word is. What touches an identifier without a sign is before it, and never after it.
    """
    hi = b
    while hi < len(text) and text[hi] in _AROUND:
        hi += 1
    m = _PIECE.match(text, hi) if b < hi else None
    n = None if m else _NEXT.match(text, hi)
    return _before(text, a), (b, m.end()) if m else n.span(1) if n else None


def _is_identifier(s: str) -> bool:
    return sum("0" <= c <= "9" for c in s) >= MIN_DIGITS or bool(re.fullmatch(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++", s))


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    s = text[a:b]
    n = len(s) - len(s.lstrip(_EDGE))
    return a + n, a + max(n, len(s.rstrip(_EDGE)))


def identifiers(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of what looks like an identifier and meets no span of the fixed rules.

    These are runs of numbers, as of a phone number in groups, tokens, and the pieces of tokens that hold signs such as
    comma, quote, colon and =, of any length; each without punctuation at its edges.
    """
    found = []
    for m in _NUMBERS.finditer(text):
        a, b = _core(text, *m.span())
        if any(c in " \t" for c in text[a:b]):
            found.append((a, b))
    for m in _REST.finditer(text):
        a, b = m.span()
        while a and text[a - 1] not in _SPACES:
            a -= 1
        a, b = _core(text, a, b)
        found.append((a, b))
        if _INNER.search(text, a, b):
            found += [_core(text, *p.span()) for p in _PIECE.finditer(text, a, b)]
    starts = [a for a, _, _ in base]
    ends = list(itertools.accumulate((b for _, b, _ in base), max))  # so far, as spans of several kinds can overlap
    out = []
    for a, b in dict.fromkeys(found):
        before = bisect.bisect_left(starts, b)  # spans that start before the end
        if a < b and not (before and ends[before - 1] > a) and _is_identifier(text[a:b]):
            out.append((a, b))
    return out


_SPAN = "struct<start: bigint, end: bigint, kind: string>"
_HULL = "struct<pattern: string, words: array<string>, n: int>"
_ITEM = f"struct<start: bigint, end: bigint, kind: string, type: string, value: string, hulls: array<{_HULL}>>"


def _type(s: str) -> str:
    """What a value is compared with: addresses, digits with their punctuation, all else."""
    return "at" if "@" in s else "mixed" if any(c.isalpha() for c in s) else "digits"


def _named(word: str) -> str:
    """A small-letter word, or a digest in place of a long one: the same for the same word."""
    word = word.translate(_LOWER)
    return word if len(word) <= LONG_WORD else "#" + hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def hulls(text: str, a: int, b: int) -> list[tuple[str, list[str], tuple]]:
    """The hulls around a place: pattern, its words as they are counted, and the place that is filled.

    These are the word before, the two words before, the word after, and the words on both sides. Within a token words
    are pieces, so each piece of a token, however long that is, is looked at by its neighbours alone.
    """
    before, after = _neighbours(text, a, b)
    out = []
    name = lambda at: _named(text[slice(*at)])
    if before:
        one = name(before)
        out.append(("<" + one, [one], ("<", before)))
        if before_it := _before(text, before[0]):
            two = name(before_it)
            out.append((f"<{two} {one}", [two, one], ("<<", before)))
    if after:
        next_ = name(after)
        out.append((">" + next_, [next_], (">", after)))
        if before:
            out.append((f"<{one} >{next_}", [one, next_], ("<>", before, after)))
    return out


@functools.cache
def _scan():
    @F.pandas_udf(f"struct<base: array<{_SPAN}>, items: array<{_ITEM}>>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                named = [{"start": a, "end": b, "kind": k} for a, b, k in base]
                items, filled = [], set()
                for a, b, k in [*base, *((a, b, None) for a, b in identifiers(text, base))]:
                    around = []
                    for pattern, words, place in hulls(text, a, b):
                        # Of several readings of one place, the first counts as what fills it.
                        around.append({"pattern": pattern, "words": words, "n": int(k is not None or place not in filled)})
                        filled.add(place)
                    items.append({"start": a, "end": b, "kind": k, "type": _type(text[a:b]), "value": text[a:b], "hulls": around})
                rows.append((named, items))
            yield pd.DataFrame(rows, columns=["base", "items"])

    return scan


def _contexts(items: DataFrame, *keep: str) -> DataFrame:
    """A row for each item and hull."""
    return items.select(*keep, F.explode("hulls").alias("h")).select(*keep, "h.pattern", "h.words", "h.n")


def _word_counts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``word, total``: how often each asked word occurs, and within tokens each piece with the signs after it or before it."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    every = lambda x: F.regexp_extract_all(text, F.lit(x), F.lit(0))
    one, signs = rf"[^\x20\x09-\x0D{_CUT}]++", f"[{_CUT}]++"
    inner = F.concat(every(rf"{one}{signs}(?![\x20\x09-\x0D]|\z)"), every(rf"(?<![\x20\x09-\x0D{_CUT}]){signs}{one}"))
    words = docs.select(F.explode(F.concat(every(WORD), inner)).alias("word"))
    long_ = F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256))
    words = words.select(F.when(F.length("word") > LONG_WORD, long_).otherwise(F.col("word")).alias("word"))
    if asked.count() <= MOST_ASKED:
        words = words.join(F.broadcast(asked), "word", "left_semi")
    return words.groupBy("word").agg(F.count("*").alias("total"))


def trusted_patterns(items: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items(kind, type, value, hulls)`` -> trusted ``pattern, type, kind`` and instances ``value, type, kind, confidence``.

    Values of the fixed rules are the first instances, with confidence 1. Each round a pattern's confidence for a kind
    is the confidence of its instances over all identifiers of their type that fill it, each as often as it does. A
    value's confidence is one minus the product of the doubts of the trusted patterns it fills; values of enough
    confidence are instances in the next round and so make patterns trusted that no fixed rule's value fills. Hulls
    that identifiers seldom fill, as those of common words, are out from the start; a hull of two words occurs at
    most as often as the rarer one. Rounds are joins and sums over the graph of patterns and values.
    """
    edges = materialize(
        _contexts(items, "kind", "type", "value").groupBy("pattern", "type", "value").agg(
            F.sum("n").alias("n"), F.max("kind").alias("kind"), F.first("words").alias("words")
        )
    )
    filled = edges.groupBy("pattern").agg(
        F.sum("n").alias("filled"), F.count("*").alias("values"), F.first("words").alias("words")
    ).where(F.col("values") >= SUPPORT)
    asking = materialize(filled.select("pattern", F.explode("words").alias("word")))
    totals = (
        asking.join(_word_counts(docs, asking.select("word").distinct()), "word", "left")
        .groupBy("pattern")
        .agg(F.min(F.coalesce("total", F.lit(2**62))).alias("total"))  # a word that isn't counted is no evidence
    )
    wanted = filled.join(totals, "pattern").where(F.col("filled") >= MIN_FILL * F.col("total")).select("pattern")
    graph = materialize(edges.drop("words").join(wanted, "pattern", "left_semi"))
    whole = materialize(graph.groupBy("pattern", "type").agg(F.sum("n").alias("all")))
    values = None
    for _ in range(ROUNDS):
        seeds = graph.where("kind is not null").withColumn("c", F.lit(1.0))
        if values is not None:
            more = graph.where("kind is null").drop("kind").join(values.withColumnRenamed("confidence", "c"), ["value", "type"])
            seeds = seeds.unionByName(more.select(*seeds.columns))
        scored = seeds.groupBy("pattern", "type", "kind").agg(F.sum(F.col("c") * F.col("n")).alias("good"), F.count("*").alias("support"))
        trusted = scored.where(F.col("support") >= SUPPORT).join(whole, ["pattern", "type"]).withColumn("confidence", F.col("good") / F.col("all"))
        best = F.max(F.struct("confidence", "kind")).alias("b")
        rules = materialize(
            trusted.where(F.col("confidence") >= MIN_PATTERN).groupBy("pattern", "type").agg(best).select("pattern", "type", "b.kind", "b.confidence")
        )
        met = graph.where("kind is null").select("pattern", "type", "value").join(rules, ["pattern", "type"])
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        each = met.groupBy("value", "type", "kind").agg((1 - doubt).alias("confidence"))
        values = materialize(
            each.groupBy("value", "type").agg(best).select("value", "type", "b.kind", "b.confidence").where(F.col("confidence") >= MIN_INSTANCE)
        )
    return rules, values


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: ``doc_id, row, base, spans``, arrays of (start, end in code points, kind).

    spans holds base and the identifiers that a trusted pattern of their kind extracts where they stand, if they
    are instances (see ``trusted_patterns``). Null and empty texts hold none. Texts are read whole, once for rules and
    contexts and once to count words. An empty table gives no rows; repeated rows are judged each; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", row_hash(docs).alias("row"), _scan()("text").alias("f"))
    found = materialize(found.select("doc_id", "row", "f.base", "f.items").withColumn("at", F.monotonically_increasing_id()))
    items = found.select("at", F.explode("items").alias("i")).select("at", "i.*")
    rules, values = trusted_patterns(items, docs)
    unknown = items.where("kind is null").drop("kind")
    extracted = (
        _contexts(unknown, "at", "start", "end", "type", "value")
        .join(rules.select("pattern", "type", "kind"), ["pattern", "type"])
        .join(values.select("value", "type", "kind"), ["value", "type", "kind"], "left_semi")
        .groupBy("at")
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    )
    order = F.array(*[F.lit(k) for k in KINDS])
    key = lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("o"), x["end"].alias("end"), x["kind"].alias("kind"))
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.transform(F.array_sort(F.transform(F.concat("base", F.transform("more", plain)), key)), plain)
    )
    return found.drop("items").join(extracted, "at", "left").select("doc_id", "row", "base", both.alias("spans"))


def span_text(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed rules' spans, and all spans, of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
