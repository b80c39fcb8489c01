"""Phrase collocations: merged count-min sketches drop rare word sequences, a second pass counts the others exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

#: Words of the longest phrase; least occurrences of a phrase; percent of them that drop it if a longer phrase has as many.
LONGEST, LEAST, COVERED = 3, 10, 50
#: Phrases of a language.
TOP = 2000
#: Rows of a sketch, bytes of text for each counter of a row; counters that are merged together, most slices of a row.
ROWS, BYTES_A_COUNTER, SLICE, MOST_SLICES = 2, 10, 1 << 18, 512
#: Bytes of text that a task handles at once; that small partitions are put together to, where that leaves all cores busy.
CHUNK, TASK = 4 << 20, 64 << 20
#: Candidates of a language that are ranked together at most, on average.
RANKED = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_EDGE = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def n_slices(n_bytes: int) -> int:
    """Slices of a row of the sketch, for so many bytes of text: as many counters a byte at every size, up to the bound."""
    return min(MOST_SLICES, max(1, -(-n_bytes // (BYTES_A_COUNTER * SLICE))))


class Words:
    """The words of some texts of one language as numbers, and which neighbours stand in one piece."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        kind = _KIND[raw]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw[word])])
        coded = spelt.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.spelling = coded.dictionary
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.joined = piece[1:] == piece[:-1]

    def hashes(self, lang: str) -> Iterator[np.ndarray]:
        """For one, two, ... words: a hash of the words from each place on, in this language."""
        each = np.array([xxhash.xxh3_64_intdigest(w) for w in self.spelling.to_pylist()], np.uint64)[self.ids]
        whole = np.full(len(each), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
        for n in range(1, len(each) + 1):
            whole = whole[: len(each) - n + 1] * _STEP ^ each[n - 1 :]
            yield whole

    def phrase(self, at: np.ndarray, n: int) -> pa.Array:
        """The words at these places and the n - 1 after each, with spaces between."""
        parts = [self.spelling.take(pa.array(self.ids[at + i])) for i in range(n)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
        return joined.view(pa.large_string())


def _places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    x = hashes + np.uint64((row + 1) * int(_STEP) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(width)).astype(np.uint32)


def _count(counters: np.ndarray, places: np.ndarray, most: int) -> None:
    """Add one at each place; counters stop at ``most``, the threshold."""
    if len(places):
        places = np.sort(places)
        first = np.flatnonzero(np.diff(places, prepend=places[:1] + np.uint32(1)))
        times = np.minimum(np.diff(first, append=len(places)), most).astype(np.uint8)
        at = places[first]
        counters[at] = np.minimum(counters[at] + times, most)


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about this size, cut between pieces; a longer piece stays whole."""
    at = 0
    while len(text) - at > size and (m := _EDGE.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language, about CHUNK bytes together; a task holds as much of all languages that aren't full."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            for part in _cut(text.as_py(), CHUNK):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= CHUNK:
                    yield lang, held.pop(lang)
                    del sizes[lang]
        while sum(sizes.values()) >= 2 * CHUNK:
            lang = max(sizes, key=sizes.__getitem__)
            yield lang, held.pop(lang)
            del sizes[lang]
    yield from held.items()


def _packed(counters: np.ndarray) -> bytes:
    """Two counters a byte, then compressed: most are 0."""
    return pa.compress((counters[::2] << 4 | counters[1::2]).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    two = np.frombuffer(pa.decompress(data, size // 2, "zstd", asbytes=True), np.uint8)
    return np.column_stack([two >> 4, two & 15]).reshape(-1)


def _slice(row: int, at: int, data: bytes, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["row", "slice", name])


def _sketches(texts: DataFrame, slices: int, longest: int, least: int) -> DataFrame:
    """``row, slice, counters``: each task's sketch of all its sequences of up to ``longest`` words, in slices."""
    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((ROWS, slices * size), np.uint8)
        for lang, chunk in _chunks(batches):
            words = Words(chunk)
            within = np.ones(len(words.ids), bool)
            for n, hashes in zip(range(1, longest + 1), words.hashes(lang), strict=False):
                if n > 1:
                    within = within[:-1] & words.joined[n - 2 :]
                here = hashes[within]
                for row in range(ROWS):
                    _count(counters[row], _places(here, row, slices * size), least)
        for row in range(ROWS):
            for i, part in enumerate(counters[row].reshape(-1, size)):
                if part.any():
                    yield _slice(row, i, _packed(part), "counters")

    return texts.mapInArrow(run, "row int, slice int, counters binary")


def _survivors(sketches: DataFrame, slices: int, least: int) -> DataFrame:
    """``row, slice, bits``: one bit for each counter of the merged sketch, set if it reaches ``least``. Slices merge apart."""
    size = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                part, key = _unpacked(r["counters"], size), (r["row"], r["slice"])
                merged[key] = np.minimum(merged[key] + part, least) if key in merged else part
        for (row, i), part in merged.items():
            yield _slice(row, i, np.packbits(part >= least, bitorder="little").tobytes(), "bits")

    return sketches.repartition(max(1, ROWS * slices // 4), "row", "slice").mapInArrow(run, "row int, slice int, bits binary")


def _exact(texts: DataFrame, sent: Broadcast, slices: int, longest: int) -> DataFrame:
    """``lang, n, phrase, f`` in parts: the sequences of n words whose counters all reach the threshold; n = 0 has the words of all."""
    width = slices * SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.frombuffer(x, np.uint8) for x in sent.value]

        def out(lang, n, phrases, f):
            langs = pa.array([lang], pa.large_string()).take(pa.array(np.zeros(len(f), np.int64)))
            columns = [langs, pa.array(np.full(len(f), n, np.int32)), phrases, pa.array(f, pa.int64())]
            return pa.RecordBatch.from_arrays([columns[0].cast(pa.string()), columns[1], columns[2].cast(pa.string()), columns[3]], names=["lang", "n", "phrase", "f"])

        for lang, chunk in _chunks(batches):
            words = Words(chunk)
            ids, many = words.ids, len(words.spelling)
            yield out(lang, 0, pa.array([""], pa.large_string()), [len(ids)])
            alive, numbers = np.ones(len(ids), bool), None
            for n, hashes in zip(range(1, longest + 1), words.hashes(lang), strict=False):
                if n > 1:  # a sequence is no more frequent than its parts
                    alive = alive[:-1] & alive[1:] & words.joined[n - 2 :]
                at = np.flatnonzero(alive)
                for row in range(ROWS):
                    place = _places(hashes[at], row, width)
                    at = at[known[row][place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
                alive = np.zeros(len(alive), bool)
                alive[at] = True
                if not len(at):
                    break
                codes = ids[at] if n == 1 else numbers[at] * many + ids[at + n - 1]
                _, first, inverse, f = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
                numbers = np.full(len(alive), -1, np.int64)
                numbers[at] = inverse
                yield out(lang, n, words.phrase(at[first], n), f)

    return texts.mapInArrow(run, "lang string, n int, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``docs(text, lang)`` -> ``lang, n, phrase, f``: all phrases of n = 1 to ``longest`` words that occur ``least`` times.

    A row with n = 0 and an empty phrase has the words of a language. The first pass fills a count-min sketch in each
    task, and the slices of all sketches are merged apart from each other; a merged counter is no less than the count
    of what falls on it, so what is below ``least`` is rare. One bit a counter, MOST_SLICES a row at most (32 MB
    together), goes to the second pass, which counts what is left exactly. The sketch grows with the text up to that
    bound; beyond it fewer rare sequences are dropped early and more are counted, with the same result. Counters stop
    at ``least``, which is 15 at most.
    """
    if not 1 <= least <= 15:
        raise ValueError("least must be from 1 to 15")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = n_slices(n_bytes)
    # What a task leaves behind, a sketch and its frequent sequences, grows more slowly than its text.
    texts = texts.coalesce(max(-(-n_bytes // TASK), spark.sparkContext.defaultParallelism))
    merged = np.zeros((ROWS, slices, SLICE // 8), np.uint8)
    for r in _survivors(_sketches(texts, slices, longest, least), slices, least).toLocalIterator():
        merged[r["row"], r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast([x.tobytes() for x in merged])
    counted = _exact(texts, sent, slices, longest).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return counted.where((F.col("n") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, top: int = TOP, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """``docs(text, lang)`` -> each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and these into words at spaces and
    tabs. A phrase of two to ``longest`` words with a >= ``least`` occurrences within pieces, overlaps included, is a
    candidate. Each cut into a first part (l occurrences) and the rest (r) scores floor(1000000 * a * a / (l * r)); the
    least score counts, ties to the shortest first part. A candidate goes if a longer one holds its words side by side
    and has ``covered`` percent of its occurrences. n is the number of the language's words. Null texts are empty, a null
    language is ``und``; no text gives no rows; rows may repeat, other columns are ignored. Arithmetic is in decimals
    of 38 digits: exact for a up to 10**16.
    """
    counts = materialize(frequent_phrases(docs, longest, least))
    parts = counts.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("f"))
    found = counts.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = found.select("lang", "n", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    joined = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cut = cut.select("lang", "n", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    of = lambda side, name: parts.select("lang", F.col("part").alias(side), F.col("f").alias(name))
    met = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumns({"__a": exact("a"), "__l": exact("l"), "__r": exact("r")})
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(__a * __a as decimal(38,0))) div (__l * __r)")
    scored = met.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    held = found.where("n > 2").select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"), "n")
    held = held.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    longer = held.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    kept = materialize(kept.select("lang", "phrase", "a", "best.score", "best.l", "best.r"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    shares = max(1, kept.count() // RANKED)
    near = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = near.withColumn("__n", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("__n") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every sequence of one to three words counted, without sketches.
ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM (
      SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.k, u.phrase, u.a, u.cut, l.f AS l, r.f AS r,
             CAST(CAST(1000000 AS HUGEINT) * u.a * u.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[:u.cut], ' ')
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase AND b.k = 2 WHERE x.most IS NULL OR 100 * x.most < {COVERED} * a)
SELECT o.lang, rank, o.phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {TOP}
"""
