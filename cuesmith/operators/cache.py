"""Work once per id, and what a cache with a time to live would have done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import DEFAULT, SiteProfile


def effective_ttl(ttl_ms: float | None, profile: SiteProfile = DEFAULT) -> int:
    """The time to live in use: the default for none, for what isn't a number and for what isn't positive."""
    try:
        value = float(ttl_ms) if ttl_ms is not None else 0.0
    except (TypeError, ValueError):
        value = 0.0
    return int(value) if 0 < value < float("inf") else profile.ttl_ms


def distinct_ids(requests: DataFrame) -> DataFrame:
    return requests.select("id").where("id is not null").distinct()


def fan_out(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Each request with the one result of its id, null without."""
    return requests.join(results, "id", "left")


def _millis(ts: Column) -> Column:
    """Milliseconds of a timestamp with or without a zone, the session's if without."""
    return F.unix_millis(ts.cast("timestamp"))


def _fresh(now: Column, ttl_ms: int, profile: SiteProfile) -> Column:
    age = _millis(now) - _millis(F.col("cached_at"))
    return F.col("cached_at").isNotNull() & (age <= ttl_ms) & (F.col("n_bytes") <= profile.max_srt_bytes)


def split_cache(
    ids: DataFrame, subtitles: DataFrame, now: Column, ttl_ms: float | None = None, profile: SiteProfile = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """ids -> those with a fresh subtitle, with its columns, and those without: age at most the time to live, size within the limit."""
    fresh = subtitles.where(_fresh(now, effective_ttl(ttl_ms, profile), profile))
    return ids.join(fresh, "id"), ids.join(fresh.select("id"), "id", "left_anti")


class Replay:
    """The cache's state for one id, in milliseconds: when it was written, and until when a task for it runs."""

    def __init__(self, ttl: int, cached_at: int | None = None, busy_until: int | None = None) -> None:
        self.ttl, self.cached_at, self.busy_until = ttl, cached_at, busy_until

    def step(self, t: int, latency: int, ok: bool) -> str:
        if self.busy_until is not None and t < self.busy_until:
            return "coalesced"
        if self.cached_at is not None and self.cached_at <= t <= self.cached_at + self.ttl:
            return "hit"
        self.busy_until = t + latency
        self.cached_at = t + latency if ok else None
        return "miss"


def replay_cache(requests: DataFrame, ttl_ms: float | None = None, profile: SiteProfile = DEFAULT) -> DataFrame:
    """``requests(request_id, id, ts)``, maybe with latency_ms and ok -> ``request_id, id, ts, outcome``.

    outcome is miss, hit, or coalesced while the id's task runs. A miss fills the cache at its end if it is ok; hits
    don't prolong it. Requests of an id are taken in order of time, then request_id. Only slim rows are shuffled,
    and a task carries two numbers from batch to batch, so an id of any size streams through.
    """
    ttl = effective_ttl(ttl_ms, profile)
    has = requests.columns
    slim = requests.where("id is not null").select(
        "request_id",
        "id",
        F.col("ts").cast("timestamp").alias("ts"),
        _millis(F.col("ts")).alias("t"),
        (F.coalesce(F.col("latency_ms").cast("long"), F.lit(0)) if "latency_ms" in has else F.lit(0).cast("long")).alias("latency"),
        (F.coalesce(F.col("ok"), F.lit(True)) if "ok" in has else F.lit(True)).alias("ok"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, Replay(ttl)
        for part in parts:
            out = []
            for id_, t, latency, ok in zip(part["id"], part["t"], part["latency"], part["ok"], strict=True):
                if id_ != last:
                    last, state = id_, Replay(ttl)
                out.append(state.step(t, latency, ok))
            yield pd.DataFrame({"request_id": part["request_id"], "id": part["id"], "ts": part["ts"], "outcome": out})

    kinds = {c: t for c, t in slim.dtypes}
    return (
        slim.repartition("id")
        .sortWithinPartitions("id", "t", "request_id")
        .mapInPandas(run, f"request_id {kinds['request_id']}, id {kinds['id']}, ts timestamp, outcome string")
    )
