"""Benchmark decontamination by Wu-Manber search: windows of benchmark words in whole documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of item texts that one pass searches for. More items take more passes over the documents.
PASS_BYTES = 4 << 20
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
#: A-Z to small letters, every other ASCII character that is no letter or digit to a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (made small), digits and other non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words, or the whole item if it is shorter; none of an item without words."""
    size = min(size, len(item))
    return (tuple(item[i : i + size]) for i in range(len(item) - size + 1)) if size else iter(())


class WuManber:
    """Windows of one length, found by the block of words that a text has where a window would end.

    The shift of a block is how far it lies from the end of any window, at least; a block that no window has lets the
    search jump by nearly a window. Where the shift is 0, the windows that end in this block are in its bucket, and the
    text's own words are compared with them.
    """

    def __init__(self, found: dict[tuple[bytes, ...], set[str]], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for window, items in found.items():
            for i in range(self.jump):
                key, far = window[i : i + self.block], self.jump - 1 - i
                if far < self.shift.get(key, self.jump):
                    self.shift[key] = far
            self.buckets.setdefault(window[-self.block :], {})[window] = items

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """The first word of each occurrence, in order, and the items that have the window."""
        length, block, jump, shift, buckets, n = self.length, self.block, self.jump, self.shift, self.buckets, len(text)
        at = length  # the end of the window that is looked at
        while at <= n:
            key = (text[at - 2], text[at - 1]) if block == 2 else (text[at - 1],)
            far = shift.get(key, jump)
            if far:
                at += far
                continue
            items = buckets[key].get(tuple(text[at - length : at]))
            if items is not None:
                yield at - length, items
            at += 1


def searchers(items: Iterable[tuple[str | None, str | None]], size: int = WINDOW) -> list[WuManber]:
    """One search for each length of window that the items have: a short window among long ones would shorten all shifts."""
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for id_, text in items:
        for window in windows(words(text), size):
            held = found.setdefault(len(window), {}).setdefault(window, set())
            if id_ is not None:
                held.add(id_)
    return [WuManber(found[n], n) for n in sorted(found)]


def _stretches(text: str | None, overlap: int, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text in stretches of about ``size`` bytes, each with the place of its first word; the last
    ``overlap`` words of one begin the next, so no window is cut."""
    plain = text.encode("utf-8", "surrogatepass").translate(_PLAIN) if text else b""
    at, first, had = 0, 0, []
    while True:
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        here = had + plain[at:end].split()
        yield first, here
        if end >= len(plain):
            return
        keep = min(overlap, len(here))
        at, first, had = end, first + len(here) - keep, here[len(here) - keep :]


def find(text: str | None, known: list[WuManber], size: int = STRETCH) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, the spans of words inside occurrences (merged, ends exclusive) and the items that occur."""
    n, spans, items = 0, [], set()
    for first, here in _stretches(text, max((x.length for x in known), default=1) - 1, size):
        n = first + len(here)
        for searcher in known:
            for start, held in searcher.search(here):
                start += first
                end = start + searcher.length
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = spans[-1][0], max(end, spans[-1][1])
                else:
                    spans.append((start, end))
                items |= held
    return n, joined(spans), sorted(items)


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch put together."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


#: What a worker built last: the items, and their tables.
_built: list = [None, None]

_SPANS = "array<struct<first: long, end: long>>"


def _spans(rows: Iterable[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"first": a, "end": b} for a, b in r] for r in rows], kind)


def _pass(docs: DataFrame, sent: Broadcast, size: int, keep: list[str]) -> DataFrame:
    """docs(text, keep) -> keep, n_words, spans and items for the items of one broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _built[0] is not sent.value:  # once for each worker, which keeps a broadcast's value
            _built[:] = sent.value, searchers(sent.value, size)
        known = _built[1]
        for batch in batches:
            rows = [find(x.as_py(), known) for x in batch.column("text")]
            counts, spans, items = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in keep],
                    pa.array(counts, pa.int64()),
                    _spans(spans),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*keep, "n_words", "spans", "items"],
            )

    kinds = dict(docs.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(
        run, f"{shape}, n_words long, spans {_SPANS}, items array<string>"
    )


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> ``doc_id, n_words, spans, items``, a row for each row of docs.

    spans are the runs of words that lie in occurrences of windows, ``first`` counted from 0 and ``end`` exclusive,
    apart and in order; items are the ids, as strings in order, of the items with a window that occurs. The items'
    texts are broadcast only up to ``pass_bytes``: of more, each pass over the documents takes a share by hash, and
    what passes find is put together by document. Null texts have no words, items without words occur nowhere, an
    item without an id marks words but isn't listed; of a repeated item_id the windows of all its rows count. Tables
    may be empty, rows may repeat, other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = items.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // pass_bytes))
    share = lambda i: [tuple(r) for r in texts.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).collect()]
    slim = docs.select("doc_id", "text")
    if n == 1:
        return _pass(slim, spark.sparkContext.broadcast(share(0)), size, ["doc_id"])
    # Rows of one id and text have one result; two hashes tell texts apart.
    keyed = slim.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("again"), "text")})
    keys = ["doc_id", "k1", "k2"]
    parts = None
    for i in range(n):
        part = _pass(keyed, spark.sparkContext.broadcast(share(i)), size, keys)
        part = part.withColumn("times", F.lit(int(i == 0)).cast("long"))
        part = part if i == 0 else part.where(F.size("spans") > 0)
        parts = part if parts is None else parts.unionByName(part)
    flat = lambda c: F.flatten(F.collect_set(c))
    whole = parts.groupBy(*keys).agg(
        F.first("n_words").alias("n_words"), flat("spans").alias("spans"), F.array_sort(F.array_distinct(flat("items"))).alias("items"), F.sum("times").alias("times")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = _spans(joined((s["first"], s["end"]) for s in r) for r in batch.column("spans").to_pylist())
            yield batch.set_column(batch.schema.get_field_index("spans"), "spans", met)

    each = whole.select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time")
    return each.mapInArrow(join, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, spans {_SPANS}, items array<string>")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of the benchmark."""
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All windows of items joined with all runs of as many words of documents.
ORACLE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least({WINDOW}, len(ws)) AS k, array_to_string(ws[s:s + least({WINDOW}, len(ws)) - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
x AS (SELECT r, k, s, array_to_string(ws[s:s + k - 1], ' ') AS w FROM (
      SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM p))),
m AS (SELECT r, k, s, item_id FROM x JOIN p USING (k, w)),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS place FROM (SELECT DISTINCT r, k, s FROM m)) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""
