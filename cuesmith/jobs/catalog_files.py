"""Queries over files that executors write from the tables: archives in a folder, and sinks that are read again."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error, no_error
from ..operators.payload import decode_bytes, extract_first_srt
from ..profile import SiteProfile
from ..session import scratch
from ..sources.archives import AHEAD, first_subtitles, list_archives
from ..sources.io import read_archives, within_limit, write_outcomes
from ..sources.store import SubtitleStore
from .catalog import SITE
from .builders import rar4_of, rar5_of, zip_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Documents of an archive; archives whose number leaves 3 when divided by CROWDED have too many entries.
PER_ARCHIVE, CROWDED = 50, 13


def _query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


# --- Archives -----------------------------------------------------------------------------------------------------


def _write_file(folder: str, name: str, data: bytes) -> None:
    """Under its name at once: a task that runs again writes the same file."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/.{name}") as out:
        out.write(data)
    fs.move(f"{path}/.{name}", f"{path}/{name}")


def _archives_of(documents: DataFrame, folder: str) -> None:
    """Files of PER_ARCHIVE documents: stored subtitles a-*.srt, every third text a b-*.txt, and entries that mustn't be taken."""

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n = int(key[0])
        files = {"../a.srt": b"above"}
        for id_, text in sorted(zip(part["doc_id"], part["text"], strict=True)):
            files[f"b-{id_:012d}.txt" if id_ % 3 == 0 else f"sub/a-{id_:012d}.SRT"] = (text or "").encode()
        files |= {f"c-{i}.srt": b"" for i in range(SITE.max_entries if n % CROWDED == 3 else 0)}
        _write_file(folder, f"{n}.zip", zip_of(files))
        return pd.DataFrame({"n": [n]})

    keyed = documents.select(F.floor(F.col("doc_id") / PER_ARCHIVE).alias("n"), "doc_id", "text")
    keyed.groupBy("n").applyInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def _number(archive_id: str = "archive_id"):
    return F.regexp_extract(archive_id, r"([0-9]+)\.zip$", 1).cast("long")


def _few(problem: str = "problem"):
    """Little was read for a listing: the head, the tail and a directory of 128 bytes an entry, or a twentieth of the archive."""
    listing = 4 * AHEAD + 128 * F.col("n_entries")
    return F.col(problem).isNotNull() | (F.col("bytes_read") * 20 <= F.col("length")) | (F.col("bytes_read") <= listing)


@_query(
    f"""WITH d AS (SELECT doc_id // {PER_ARCHIVE} AS n, * FROM documents)
SELECT n AS archive, 'sub/a-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.SRT' AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
CAST(1 + count(*) OVER (PARTITION BY n) AS INTEGER) AS n_entries, true AS few FROM d WHERE n % {CROWDED} <> 3 QUALIFY doc_id % 3 <> 0"""
)
def ranged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles in archives of documents, by name, from the central directories alone; names and files are filtered in the reader."""
    folder = scratch(spark)
    _archives_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    found = list_archives(spark, folder, SITE, pattern="*.zip").where(F.col("lower_name").startswith("sub/") & F.col("lower_name").endswith(".srt"))
    return found.select(_number().alias("archive"), "name", "size", "n_entries", _few().alias("few"))


@_query(
    f"""WITH d AS (SELECT doc_id // {PER_ARCHIVE} AS n, * FROM documents),
g AS (SELECT n, min(doc_id) FILTER (doc_id % 3 <> 0) AS first, arg_min(coalesce(text, ''), doc_id) FILTER (doc_id % 3 <> 0) AS text FROM d GROUP BY n)
SELECT n AS archive, CASE WHEN n % {CROWDED} <> 3 THEN 'sub/a-' || lpad(CAST(first AS VARCHAR), 12, '0') || '.SRT' END AS name,
CASE WHEN n % {CROWDED} <> 3 THEN md5(text) END AS digest,
CASE WHEN n % {CROWDED} = 3 THEN 'Archive contains too many entries' WHEN first IS NULL THEN 'Archive does not contain an SRT file' END AS problem FROM g"""
)
def ranged_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first subtitle of each archive of documents, of which nothing else but the central directory is read."""
    folder = scratch(spark)
    _archives_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    found = first_subtitles(spark, folder, SITE, pattern="*.zip")
    return found.select(_number().alias("archive"), "name", F.md5("data").alias("digest"), "problem")


@functools.cache
def _packed(pack: Callable[[str, int], bytes]):
    """An archive for each text, made by ``pack(text, kind)``."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in parts:
            yield pd.Series([pack(t or "", k) for t, k in zip(texts, kinds, strict=True)])

    return run


def _rar(text: str, kind: int) -> bytes:
    """Stored in the old and the new form, deflated for a plug-in in both, and stored under a wrong checksum."""
    data = text.encode()
    files = {"x/later.srt": b"later", "a/first.srt": data, "a/0.txt": b"no subtitle", "../0.srt": b"above"}
    if kind < 2:
        return (rar4_of if kind == 0 else rar5_of)(files)
    if kind == 4:
        return rar5_of(files, crcs={"a/first.srt": zlib.crc32(data) ^ 1})
    sizes, crcs = {n: len(d) for n, d in files.items()}, {n: zlib.crc32(d) for n, d in files.items()}
    packed = {n: zlib.compress(d, 1) for n, d in files.items()}
    return rar4_of(packed, sizes, 0x33, crcs) if kind == 2 else rar5_of(packed, sizes, 3, crcs)


def _inflate(content: bytes, entry: dict) -> bytes:
    """A plug-in for this module's packed entries."""
    return zlib.decompress(content[entry["data_offset"] : entry["data_offset"] + entry["packed_size"]])


@_query(
    """SELECT CAST(doc_id AS VARCHAR) AS archive_id, 'a/first.srt' AS name, CASE WHEN doc_id % 5 < 4 THEN md5(coalesce(text, '')) END AS digest,
CASE WHEN doc_id % 5 = 4 THEN 'RAR entry checksum mismatch' END AS problem FROM documents"""
)
def rar_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in stored RAR archives of both forms, in packed ones taken by a plug-in, and in ones with a wrong checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    archives = docs.select(F.col("doc_id").alias("archive_id"), _packed(_rar)("text", (F.col("doc_id") % 5).cast("int")).alias("content"))
    found = extract_first_srt(archives, SITE, _inflate)
    return found.select("archive_id", "name", F.md5("data").alias("digest"), "problem")


@_query(
    """SELECT CAST(doc_id AS VARCHAR) AS archive_id, 'a/first.srt' AS name,
CASE WHEN doc_id % 2 = 0 THEN 'compressed RAR entries need an extractor' END AS problem FROM documents"""
)
def rar_without_plug_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a plug-in packed entries are a problem of their row; stored ones beside them are taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    archives = docs.select(F.col("doc_id").alias("archive_id"), _packed(_rar)("text", kind).alias("content"))
    return extract_first_srt(archives, SITE).select("archive_id", "name", "problem")


def _legacy_zip(text: str, kind: int) -> bytes:
    return zip_of({"a/first.srt": text.encode("gb18030" if kind == 0 else "utf-8")})


#: Most bytes of a subtitle in ``growing_texts``; letters that become Chinese characters: two bytes each, three in UTF-8.
GROWN, _LETTERS, _TO = 2000, "abcdefghijklmnopqrstuvwxyz", "的一是在不了有和人这中大为上个国我以要他时来用们生到"
_WIDE = f"translate(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '字', 'g'), '{_LETTERS}', '{_TO}')"


@_query(
    f"""WITH t AS (SELECT doc_id, {_WIDE} || '，' AS t, doc_id % 2 AS k FROM documents),
s AS (SELECT *, strlen(t) AS wide, length(t) + length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS narrow FROM t)
SELECT doc_id, CAST(CASE WHEN k = 0 AND narrow <= {GROWN} OR k = 1 AND wide <= {GROWN} THEN wide END AS BIGINT) AS n_bytes,
CASE WHEN k = 0 AND narrow > {GROWN} OR k = 1 AND wide > {GROWN} THEN 'INVALID_ARCHIVE' WHEN wide > {GROWN} THEN 'SRT_TOO_LARGE' END AS code FROM s"""
)
def growing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles within the limit as they are packed, of which those in GB18030 may be too large in UTF-8; others are too large before."""
    profile = SiteProfile(max_srt_bytes=GROWN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "字"), _LETTERS, _TO)
    content: Column = _packed(_legacy_zip)(F.concat(wide, F.lit("，")), (F.col("doc_id") % 2).cast("int"))
    found = extract_first_srt(docs.select(F.col("doc_id").alias("archive_id"), content.alias("content")), profile)
    texts = within_limit(decode_bytes(found, "data"), profile)
    code = F.when(F.col("problem").isNotNull(), "INVALID_ARCHIVE").otherwise(F.col("error.code"))
    return texts.select(F.col("archive_id").cast("long").alias("doc_id"), "n_bytes", code.alias("code"))


# --- Sinks --------------------------------------------------------------------------------------------------------


@_query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 4 OR doc_id % 7 = 3 THEN 'two' ELSE 'one' END AS name,
md5(CASE WHEN doc_id % 2 = 0 AND doc_id % 10 <> 4 OR doc_id % 7 = 3 THEN 'new ' || coalesce(text, '') ELSE text END) AS digest FROM documents
WHERE text IS NOT NULL AND doc_id % 7 <> 3 OR doc_id % 2 = 0 AND doc_id % 10 <> 4 OR doc_id % 7 = 3"""
)
def stored_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into a store: the second brings half of the ids anew, some with an error, and ids that weren't there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id")
    again = (key % 2 == 0) | (key % 7 == 3)
    shape = lambda df, name, text, code: df.select(
        key.cast("string").alias("id"), F.lit(name).alias("name"), F.lit("utf-8").alias("encoding"), text.alias("text"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("cached_at"), code.alias("error"),
    )
    bad = F.when((key % 10 == 4) & (key % 7 != 3), error("INVALID_ARCHIVE"))
    store = SubtitleStore(spark, scratch(spark), SITE)
    store.commit(shape(docs.where(key % 7 != 3), "one", F.col("text"), no_error()))
    store.commit(shape(docs.where(again), "two", F.concat(F.lit("new "), F.coalesce("text", F.lit(""))), bad))
    return store.read().select("id", "name", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query(
    """SELECT event_id AS request_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day,
CASE WHEN event_id % 4 = 1 THEN 'INVALID_ID' END AS code FROM events"""
)
def outcomes_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written by day and read again; a ninth of it has no time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    bad = F.when(F.col("event_id") % 4 == 1, error("INVALID_ID"))
    path = scratch(spark)
    write_outcomes(events.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"), bad.alias("error")), path)
    return spark.read.parquet(path).select("request_id", F.col("day").cast("string").alias("day"), "code")


@_query(ORACLES["ranged_subtitles"])
def whole_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from whole contents: archives read as files, each listed, picked from and extracted in its row."""
    folder = scratch(spark)
    _archives_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    found = extract_first_srt(read_archives(spark, folder), SITE)
    return found.select(_number().alias("archive"), "name", F.md5("data").alias("digest"), "problem")


# --- Charsets -----------------------------------------------------------------------------------------------------

#: Letters become characters of Big5's first rows, which are no characters in GB18030: "人" and 25 others.
_BIG5 = "一乙丁七乃九了二人儿入八几刀刁力匕十卜又三下丈上丫丸"


@functools.cache
def _encoded(name: str):
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: t.encode(name))

    return run


@_query(
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '[^\\x00-\\x7F]', 'é ', 'g') || 'é '
ELSE translate(regexp_replace(text, '[^\\x00-\\x7F]', '人', 'g'), '{_LETTERS}', '{_BIG5}') || '人' END AS text,
CASE WHEN doc_id % 2 = 0 THEN 'windows-1252' ELSE 'big5' END AS encoding FROM t"""
)
def decode_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as Windows-1252 and as Big5, without any mark: bytes that other charsets give a lower score."""
    text = F.coalesce("text", F.lit(""))
    plain = lambda c: F.regexp_replace(text, r"[^\x00-\x7F]", c)
    latin = _encoded("cp1252")(F.concat(plain("é "), F.lit("é ")))
    big5 = _encoded("big5hkscs")(F.concat(F.translate(plain("人"), _LETTERS, _BIG5), F.lit("人")))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 2 == 0, latin).otherwise(big5).alias("body"))
    return decode_bytes(rows, "body").select("doc_id", "text", "encoding")
