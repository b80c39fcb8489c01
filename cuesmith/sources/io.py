"""Reading captures and archives, writing hits and subtitles."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error
from ..functions.validate import classify_capture
from ..profile import DEFAULT, SiteProfile

#: Bytes of subtitles and rows of outcomes that a task writes.
FILE_BYTES, FILE_ROWS = 256 << 20, 1_000_000
CAPTURES = "url string, status int, location string, content_length long, body binary, captured_at timestamp"


def checked_captures(captures: DataFrame, max_bytes: int = DEFAULT.max_page_bytes) -> DataFrame:
    """Captures with ``kind`` and ``error``; the declared length is checked before the real one."""
    large = F.coalesce(F.col("content_length") > max_bytes, F.lit(False)) | F.coalesce(F.octet_length("body") > max_bytes, F.lit(False))
    found = classify_capture(F.col("status"), F.col("location"))
    large = large & (found["kind"] == "page")
    why = F.when(large, error("UPSTREAM_TOO_LARGE")).otherwise(found["error"])
    return captures.withColumns({"kind": F.when(large, "error").otherwise(found["kind"]), "error": why})


def read_captures(spark: SparkSession, path: str, max_bytes: int = DEFAULT.max_page_bytes) -> DataFrame:
    return checked_captures(spark.read.schema(CAPTURES).parquet(path), max_bytes)


def read_archives(spark: SparkSession, path: str, max_bytes: int = DEFAULT.max_archive_bytes) -> DataFrame:
    """Files as ``archive_id`` (their path) and ``content``; larger ones aren't opened, as the length is a pushed filter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") <= max_bytes).select(F.col("path").alias("archive_id"), "length", "content")


def hits_json(hits: DataFrame, *keys: str) -> DataFrame:
    """One JSON array of hits for each key, in page order."""
    names = ["id", "title", "version", "format", "language", "date", F.col("detail_url").alias("detailUrl")]
    rows = F.sort_array(F.collect_list(F.struct("pos", F.struct(*names).alias("hit"))))
    return hits.groupBy(*keys).agg(F.to_json(F.transform(rows, lambda x: x["hit"]), {"ignoreNullFields": "false"}).alias("hits"))


def write_hits(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").json(path, ignoreNullFields=False)


def within_limit(subtitles: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """Subtitles with ``n_bytes`` and, for those that UTF-8 made too large, an error."""
    size = F.octet_length("text").cast("long")
    had = F.col("error") if "error" in subtitles.columns else F.lit(None)
    return subtitles.withColumns(
        {"n_bytes": size, "error": F.coalesce(had, F.when(size > profile.max_srt_bytes, error("SRT_TOO_LARGE")))}
    )


def good_subtitles(subtitles: DataFrame, profile: SiteProfile = DEFAULT) -> DataFrame:
    """Those without an error, with a text within the limit; with ``n_bytes``."""
    return within_limit(subtitles, profile).where("error is null and text is not null").drop("error")


def shares(sizes: list[tuple], target: int) -> list[tuple]:
    """``(group, size)`` -> ``(group, first slot, slots)``: about ``target`` a slot. A large group has slots of its own,
    small ones share one: the largest is put first, each into the slot with the least in it that it fits in."""
    out, at, open_ = [], 0, []
    for group, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        if size >= target:
            n = -(-size // target)
            out.append((group, at, n))
            at += n
            continue
        if not open_ or open_[0][0] + size > target:
            heapq.heappush(open_, (0, at))
            at += 1
        held, slot = heapq.heappop(open_)
        out.append((group, slot, 1))
        heapq.heappush(open_, (held + size, slot))
    return out


def dealt(rows: DataFrame, group: str, size: Column, key: Column, target: int = FILE_BYTES) -> DataFrame:
    """Rows with those of a group in few tasks of about ``target`` (in the unit of ``size``), however uneven groups are.

    Groups are counted first: they must be few (prefixes, days), as they are planned on the driver. A large group is
    cut by a hash of ``key``; small ones share a task. With few rows slots are smaller, so that all cores have some.
    """
    sizes = [(r[0], int(r[1] or 0)) for r in rows.groupBy(group).agg(F.sum(size)).collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    plan = shares(sizes, max(1, min(target, -(-sum(n for _, n in sizes) // cores))))
    kind = rows.schema[group].dataType.simpleString()
    slots = rows.sparkSession.createDataFrame(plan, f"__group {kind}, __first int, __slots int")
    met = rows.join(F.broadcast(slots), F.col(group).eqNullSafe(F.col("__group")), "left")
    n, at = max((first + many for _, first, many in plan), default=1), F.xxhash64(key)
    # A group that wasn't there when groups were counted goes anywhere.
    slot = F.coalesce(F.col("__first") + F.pmod(at, "__slots"), F.pmod(at, F.lit(n))).cast("int")
    return met.withColumn("__slot", slot).repartitionById(n, "__slot").drop("__group", "__first", "__slots", "__slot")


def write_subtitles(subtitles: DataFrame, path: str, profile: SiteProfile = DEFAULT) -> None:
    """Good subtitles only, by the id's first three characters, about as many bytes in each task.

    The folder is written anew; ``SubtitleStore`` keeps what is there and replaces ids.
    """
    good = good_subtitles(subtitles, profile).withColumn("id_prefix", F.substring("id", 1, 3))
    dealt(good, "id_prefix", F.col("n_bytes"), F.col("id")).write.mode("overwrite").partitionBy("id_prefix").parquet(path)


def write_outcomes(replayed: DataFrame, path: str) -> None:
    """Replayed requests by day, about as many in each task; with the error's code for good reading. Rows without a time have no day."""
    flat = replayed.withColumns({"code": F.col("error.code"), "status": F.col("error.status"), "day": F.to_date("ts")}).drop("error")
    dealt(flat, "day", F.lit(1), F.col("request_id"), FILE_ROWS).write.mode("overwrite").partitionBy("day").parquet(path)


def to_kv(subtitles: DataFrame, ttl_ms: float, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``id, text`` -> ``key, value, expires_s`` for a key/value store: base64 in one line, whole seconds, small values only."""
    fits = subtitles.where(F.octet_length("text") <= profile.max_kv_bytes)
    value = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"[\r\n]", "")
    return fits.select(F.col("id").alias("key"), value.alias("value"), F.lit(max(1, int(ttl_ms // 1000))).cast("long").alias("expires_s"))
