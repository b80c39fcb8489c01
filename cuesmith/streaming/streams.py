"""The harvest and the request replay as streams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.cache import Replay, effective_ttl
from ..operators.hits import parse_hits
from ..profile import DEFAULT, SiteProfile

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGES = "page_id long, url string, html string"
#: Keys of state that ids are dealt to; requests that are packed at once, and that a pack holds at most.
BUCKETS, PACKED_AT_ONCE, PACK_ROWS = 1024, 1 << 18, 1 << 15
#: Bytes of a bucket's packs on their way to the state; requests of whole slices that are judged at once, if a slice has no more.
HELD_BYTES, JUDGED_AT_ONCE = 4 << 20, 1 << 17


def stream_hits(spark: SparkSession, path: str, schema: str = PAGES, profile: SiteProfile = DEFAULT) -> DataFrame:
    """New page files as hits; the same stateless transformations as in batch."""
    return parse_hits(spark.readStream.schema(schema).parquet(path), profile)


def dedup_stream(requests: DataFrame, ttl: str) -> DataFrame:
    """One request of an id within the time to live, approximately: repeats may go that the exact replay calls misses."""
    return requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["id"])


def _to_bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests with ``bucket, slice`` -> ``bucket, slice, data``: those of a bucket and slice together, as an Arrow stream."""

    def packs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bucket, at = (rows[c].to_numpy() for c in ("bucket", "slice"))
        order = np.lexsort((at, bucket))
        bucket, at = bucket[order], at[order]
        rows = rows.drop_columns(["bucket", "slice"]).take(pa.array(order)).combine_chunks()
        cuts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), len(order)]
        first = [k for i, j in itertools.pairwise(cuts) for k in range(i, j, PACK_ROWS)]
        for some in itertools.batched(itertools.pairwise([*first, len(order)]), 1024):
            i = np.array([i for i, _ in some])
            data = [_to_bytes(rows.slice(i, j - i)) for i, j in some]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[i]), pa.array(at[i]), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED_AT_ONCE:
            yield from packs(held)
            held, n = [], 0
    if n:
        yield from packs(held)


class InOrder(StatefulProcessor):
    """The replay of a bucket of ids: requests wait in slices of time and are judged in order once no earlier one may come.

    State is the cache's two numbers of each id and, for each slice that is open, packs of its requests, so that calls
    to the state grow with buckets and slices, not with ids, and a trigger's rows are never held together. A bucket has
    one timer: for the end of its first open slice, or for the time when all ids' numbers lapse, as nothing waits and the
    watermark is past the slice of the time to live and of the running task. A request of a slice that is over is late.
    """

    def __init__(self, ttl: int, width: int) -> None:
        self.ttl, self.width = ttl, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, made long, slices array<long>, pieces array<long>")
        self.tasks = handle.getValueState("tasks", "data binary")
        self.waiting = handle.getMapState("waiting", "piece long", "packs array<binary>")

    def _opened(self) -> tuple[int | None, int, list[tuple[int, int]]]:
        """The timer, pieces made so far, and those that wait, each with its slice."""
        timer, made, slices, pieces = self.open.get() or (None, 0, [], [])
        return timer, made, list(zip(slices, pieces, strict=True))

    def _set(self, old: int | None, timer: int, made: int, waiting: list[tuple[int, int]]) -> None:
        if old is not None and old != timer:
            self.handle.deleteTimer(old)
        if old != timer:
            self.handle.registerTimer(timer)
        self.open.update((timer, made, [at for at, _ in waiting], [piece for _, piece in waiting]))

    def _load(self) -> dict:
        """Each id's (cached_at, busy_until)."""
        had = self.tasks.get()
        if had is None:
            return {}
        ids, cached_at, busy_until = (c.to_pylist() for c in _from_bytes(had[0]).columns)
        return dict(zip(ids, zip(cached_at, busy_until, strict=True), strict=True))

    def _store(self, tasks: dict) -> None:
        columns = [pa.array(list(tasks)), *(pa.array([x[i] for x in tasks.values()], pa.int64()) for i in (0, 1))]
        self.tasks.update((_to_bytes(pa.table(columns, names=["id", "cached_at", "busy_until"])),))

    def _lapse(self, cached_at: int | None, busy_until: int | None) -> int:
        """The end of a slice from which on no request can meet the state: one of a slice that is open may still come."""
        end = 1 + max(-1 if cached_at is None else cached_at + self.ttl, -1 if busy_until is None else busy_until)
        return -(-end // self.width) * self.width

    def _out(self, rows: pa.Table, outcome: list[str] | str) -> pd.DataFrame:
        ids = rows["request_id"]  # with a null among them, numbers would become floats
        ids = pd.Series(ids.to_pylist(), dtype=object) if ids.null_count else ids.to_pandas()
        at = pd.to_datetime(rows["t"].to_pandas(), unit="ms", utc=True)
        return pd.DataFrame({"request_id": ids, "id": rows["id"].to_pandas(), "ts": at, "outcome": outcome})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        tasks = self._load() | {i: (t, None) for i, t in zip(initialState["id"].tolist(), initialState["t"].tolist(), strict=True)}
        self._store(tasks)
        timer, made, waiting = self._opened()
        self._set(timer, max(self._lapse(*x) for x in tasks.values()), made, waiting)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, made, waiting = self._opened()
        had, fresh, size = len(waiting), {}, 0

        def keep() -> None:
            for at, packs in fresh.items():
                self.waiting.updateValue((made + len(waiting) - had,), (packs,))
                waiting.append((at, made + len(waiting) - had))
            fresh.clear()

        for part in rows:
            for at, data in zip(part["slice"].tolist(), part["data"], strict=True):
                if at + self.width <= now:
                    yield self._out(_from_bytes(data), "late")
                    continue
                fresh.setdefault(at, []).append(bytes(data))
                size += len(data)
                if size > HELD_BYTES:
                    keep()
                    size = 0
        keep()
        if len(waiting) > had:
            # A timer for a lapse that comes first stays.
            end = min(at for at, _ in waiting) + self.width
            self._set(timer, end if timer is None else min(timer, end), made + len(waiting) - had, waiting)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, made, waiting = self._opened()
        tasks = self._load()
        due = sorted(x for x in waiting if x[0] + self.width <= now)
        held = []
        for i, (at, piece) in enumerate(due):
            held += [_from_bytes(data) for data in self.waiting.getValue((piece,))[0]]
            self.waiting.removeKey((piece,))
            last = i + 1 == len(due)
            if last or (sum(map(len, held)) >= JUDGED_AT_ONCE and due[i + 1][0] != at):
                yield self._judged(held, tasks)
                held = []
        tasks = {i: x for i, x in tasks.items() if self._lapse(*x) > now}
        waiting = [x for x in waiting if x[0] + self.width > now]
        if not tasks:
            self.tasks.clear()
        else:
            self._store(tasks)
        if waiting or tasks:
            self._set(None, min(at for at, _ in waiting) + self.width if waiting else max(self._lapse(*x) for x in tasks.values()), made, waiting)
        else:
            self.open.clear()

    def _judged(self, held: list[pa.Table], tasks: dict) -> pd.DataFrame:
        """Whole slices in order of id, time and request_id; the ids' numbers are brought up to date."""
        rows = pa.concat_tables(held)
        order = pc.sort_indices(rows, [(c, "ascending") for c in ("id", "t", "request_id")], null_placement="at_start")
        rows = rows.take(order)
        last, replay, outcome = None, None, []
        for i, t, latency, ok in zip(*(rows[c].to_pylist() for c in ("id", "t", "latency", "ok")), strict=True):
            if replay is None or i != last:
                if replay is not None:
                    tasks[last] = replay.cached_at, replay.busy_until
                last, replay = i, Replay(self.ttl, *tasks.get(i, (None, None)))
            outcome.append(replay.step(t, latency, ok))
        tasks[last] = replay.cached_at, replay.busy_until
        return self._out(rows, outcome)


def replay_stream(
    requests: DataFrame,
    ttl_ms: float | None = None,
    profile: SiteProfile = DEFAULT,
    delay: str = "10 minutes",
    cached: DataFrame | None = None,
    width_ms: int = 60_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``requests(request_id, id, ts, latency_ms, ok)`` -> ``request_id, id, ts, outcome``, with state for buckets of ids.

    The same outcomes as ``replay_cache``, whatever triggers a log is cut into and wherever it was stopped and started
    again from its checkpoint: ``delay`` is how late a request may come, and a request is judged, in order of time and
    request_id, when the watermark (the newest time seen, less the delay) has passed its slice of ``width_ms``. A
    request whose slice is over by then comes out as ``late`` and changes nothing. ``cached(id, cached_at)`` is what the
    cache holds when the stream first starts. Ids are dealt to ``buckets`` by a hash; their number must stay the same
    for a checkpoint, and a task holds a bucket's slice, and its live ids' numbers, at once. Rows without a time are dropped; a row without an id gives nothing but
    moves the clock, so one that is late enough ends a log. The session's state store becomes RocksDB, which timers need.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    has = requests.columns
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # The time is in the condition, so that it isn't moved below the watermark: rows without an id move the clock.
    slim = timed.where(F.when(F.col("id").isNotNull(), F.col("ts")).isNotNull()).select(
        "request_id",
        "id",
        F.unix_millis("ts").alias("t"),  # no event-time column any more: Spark drops no late row
        (F.coalesce(F.col("latency_ms").cast("long"), F.lit(0)) if "latency_ms" in has else F.lit(0).cast("long")).alias("latency"),
        (F.coalesce("ok", F.lit(True)) if "ok" in has else F.lit(True)).alias("ok"),
    )
    kinds = dict(slim.dtypes)
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    packs = slim.select("*", bucket, (F.col("t") - F.pmod("t", F.lit(width_ms))).alias("slice")).repartition("bucket").mapInArrow(_packed, "bucket int, slice long, data binary")
    held = None
    if cached is not None:
        held = cached.where("id is not null and cached_at is not null").select("id", F.unix_millis(F.col("cached_at").cast("timestamp")).alias("t"))
        held = held.groupBy("id").agg(F.max("t").alias("t")).select(bucket, "id", "t").groupBy("bucket")
    return packs.groupBy("bucket").transformWithStateInPandas(
        InOrder(effective_ttl(ttl_ms, profile), width_ms),
        f"request_id {kinds['request_id']}, id {kinds['id']}, ts timestamp, outcome string",
        "append",
        "eventtime",
        held,
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there into Parquet files, exactly once by the checkpoint, and stop; a later call goes on from there."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
