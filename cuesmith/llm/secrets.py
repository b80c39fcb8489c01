"""Secrets in documents: fixed rules, and windows of high entropy."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so only a run's first place can start a match.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_HINT = re.compile(r"(?ai:pass|secret|token|api)")

#: Windows in characters: candidates shorter than the last are judged by the first. For each, the entropy in bits that
#: some window must reach, by character class. A window of 24 characters has log2(24) = 4.58 bits at most, one of 16 has
#: 4; words joined by hyphens stay below 4.0 and 3.6, and what mixes capitals, small letters and digits is rarely prose.
WINDOWS = {16: {"hex": 2.9, "mixed": 3.45, "base64": 3.8}, 24: {"hex": 3.2, "mixed": 3.5, "base64": 4.05}}
SHORTEST, LONGEST = min(WINDOWS), max(WINDOWS)
#: With less than a tenth of digits, letters are random only if so many neighbours differ in case: CamelCase stays below.
CASE_CHANGES = 0.38
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % SHORTEST)
#: What looks random and is no secret: identifiers, digests that are published with what they digest, data links,
#: counting runs of the alphabet or of digits.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"sha(?:1|224|256|384|512)-?[A-Za-z0-9+/=]*"),
    re.compile(r"(?:[A-Za-z]+[-_/])+[A-Za-z]+"),
)
ALLOW_BEFORE = re.compile(r"(?i)(?:base64,|integrity=[\"']?)\Z")
_LINK = re.compile(r"(?i)https?://\S*")
_RUNS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_COUNTED = re.compile("|".join(_RUNS))

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, LONGEST + 1)]


def highest_entropy(s: str, window: int = LONGEST) -> float:
    """The highest Shannon entropy, in bits, of any ``window`` characters in a row; counts move with the window."""
    counts: dict[str, int] = {}
    total = best = 0.0  # total: sum of n * log2(n)
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
        if i >= window - 1:
            best = max(best, math.log2(window) - total / window)
    return best


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed rules, by start and then kind as listed."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates, or what is left of them beside spans taken and counting runs, with a window of high entropy that aren't allowed.

    Places come in order, so each span taken and each link is passed once.
    """
    found: list[tuple[int, int, str]] = []
    links = iter([m.span() for m in _LINK.finditer(text)] if "://" in text else [])
    link = next(links, None)
    spans, first = sorted((a, b) for a, b, _ in taken), 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while link and link[1] <= start:
            link = next(links, None)
        if link and link[0] <= start or any(p.fullmatch(m[0]) for p in ALLOW) or ALLOW_BEFORE.search(text, max(0, start - 12), start):
            continue
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        here = list(itertools.takewhile(lambda x: x[0] < end, itertools.islice(spans, first, None)))
        for a, b in _free(start, end, here + [r.span() for r in _COUNTED.finditer(text, start, end)]):
            if b - a >= SHORTEST and _random(text[a:b]):
                found.append((a, b, "entropy"))
    return found


def _free(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a to b that no span takes."""
    for x, y in sorted(taken):
        if x < b and a < y:
            if a < x:
                yield a, x
            a = max(a, y)
    if a < b:
        yield a, b


def _random(s: str) -> bool:
    """Whether some window of s has the entropy that its class asks for; letters with few digits must also change case often."""
    if s.isdigit() or len(set(s)) < 8 or any(p.fullmatch(s) for p in ALLOW):
        return False
    lower, upper = any(map(str.islower, s)), any(map(str.isupper, s))
    digits = sum(map(str.isdigit, s))
    kind = "hex" if HEX_DIGITS.issuperset(s) else "mixed" if lower and upper else "base64"
    if not digits and kind != "mixed":
        return False
    if 10 * digits < len(s) and kind == "mixed" and sum(x.islower() != y.islower() for x, y in itertools.pairwise(s)) < CASE_CHANGES * len(s):
        return False
    window = LONGEST if len(s) >= LONGEST else SHORTEST
    return highest_entropy(s, window) >= WINDOWS[window][kind]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _merge(base: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        out += [text[at:a], f"[{kind.upper()}]"] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"


@functools.cache
def _scan():
    @F.pandas_udf(f"struct<base: {SPANS}, spans: {SPANS}, redacted: string>")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for texts in parts:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                spans = _merge(base, entropy_spans(text, base))
                rows.append((named(base), named(spans), redact(text, spans) if spans else None))
            yield pd.DataFrame(rows, columns=["base", "spans", "redacted"])

    return scan


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with ``secrets``: a struct of ``base`` and all ``spans`` (start, end in code points, kind) and ``redacted``.

    ``redacted`` is the text with each span replaced by its kind in brackets, null where there is none. Null and
    empty texts hold no secrets. Each row stands alone and keeps its columns; repeated rows give the same.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("secrets", _scan()("text"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, n_chars following; documents without any are unchanged."""
    new = F.col("__s.redacted")
    small_batches(docs.sparkSession)
    found = docs.withColumn("__s", _scan()("text"))
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(new.isNotNull(), F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def span_text(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed rules' spans, and all spans, of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("secrets.base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(span_text("secrets.base"), 256).alias("base_sha256"), span_text("secrets.spans").alias("spans")
    )
