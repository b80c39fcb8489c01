from __future__ import annotations

from datetime import datetime, timedelta

from cuesmith.operators.cache import replay_cache
from cuesmith.operators.hits import parse_hits
from cuesmith.streaming import streams

PAGE = '<div class="resultcard"><div class="subitem"><a href="/sub/{0}/x">T{0}</a><p>格式：Subrip(srt)</p></div></div>'


def _run(df, name: str, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_hits_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"https://subs.example/{i}", PAGE.format(i)) for i in range(5)]
    pages = spark.createDataFrame(rows, streams.PAGES)
    pages.write.parquet(str(tmp_path / "in"))
    got = _run(streams.stream_hits(spark, str(tmp_path / "in")), "hits", tmp_path)
    assert sorted(got.collect()) == sorted(parse_hits(pages).collect())


LOG = "request_id long, id string, ts timestamp, latency_ms long, ok boolean"


def _at(seconds: float) -> datetime:
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def _replayed(spark, tmp_path, triggers: list, ttl_ms: float, **more) -> dict:
    """The outcomes of a log that is stopped after each trigger and started again from its checkpoint."""
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "log" / str(i)))
        stream = spark.readStream.schema(LOG).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
        streams.run_available(streams.replay_stream(stream, ttl_ms, **more), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len({r["request_id"] for r in rows})
    return {r["request_id"]: r["outcome"] for r in rows}


def test_replay_stream_equals_batch_over_restarts(spark, tmp_path):
    """Requests out of order by less than the delay, hot and rare ids, tasks that run and fail; the last row ends the log."""
    rows = [(i, "abc"[(i % 3 == 0) + (i % 17 == 0)], _at(i * 7 % 50 + i // 20 * 40), 2000 * (i % 5), i % 4 > 0) for i in range(120)]
    end = (None, None, _at(3600), 0, True)
    got = _replayed(spark, tmp_path, [rows[:50], rows[50:90], [*rows[90:], end]], 20_000, delay="2 minutes", width_ms=5000)
    want = replay_cache(spark.createDataFrame(rows, LOG), 20_000)
    assert got == {r["request_id"]: r["outcome"] for r in want.collect()}


def test_late_requests_come_out_marked(spark, tmp_path):
    triggers = [
        [(1, "a", _at(0), 0, True), (2, "a", _at(60), 0, True), (3, "b", _at(120), 0, False)],
        [(4, "clock", _at(3600), 0, True)],
        [(6, "a", _at(1800), 0, True), (7, "a", _at(3300), 0, True), (8, "a", _at(3720), 0, True), (10, None, _at(3720), 0, True), (11, "a", None, 0, True)],
        [(None, None, _at(9999), 0, True)],
    ]
    got = _replayed(spark, tmp_path, triggers, 20 * 60_000)
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "miss", 6: "late", 7: "miss", 8: "hit"}


def test_state_lasts_while_its_slice_is_open(spark, tmp_path):
    """The watermark (80) is past what is cached (50 to 70), but a request of the open slice (60 to 120) may still meet it."""
    triggers = [[(1, "a", _at(50), 0, True), (2, "clock", _at(130), 0, True)], [(3, "a", _at(65), 0, True), (None, None, _at(9999), 0, True)]]
    got = _replayed(spark, tmp_path, triggers, 20_000, delay="50 seconds", width_ms=60_000)
    assert got == {1: "miss", 2: "miss", 3: "hit"}


def test_state_grows_with_buckets_and_slices_not_with_ids(spark, tmp_path):
    """600 ids of 4 buckets in 3 slices: what is kept, and so the calls to the state, are some rows for each bucket and slice."""
    rows = [(i, f"id{i % 600}", _at(i // 600 * 60 + i % 50), 1000 * (i % 70), i % 3 > 0) for i in range(1800)]
    spark.createDataFrame([*rows, (None, None, _at(9999), 0, True)], LOG).write.parquet(str(tmp_path / "log"))
    stream = streams.replay_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "log")), 90_000, buckets=4)
    q = stream.writeStream.format("memory").queryName("few").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert 0 < max(kept) <= 4 * (3 + 2) and kept[-1] == 0
    want = replay_cache(spark.createDataFrame(rows, LOG), 90_000)
    assert {r["request_id"]: r["outcome"] for r in spark.table("few").collect()} == {r["request_id"]: r["outcome"] for r in want.collect()}


def test_request_ids_stay_exact_beside_a_null(spark, tmp_path):
    large = 2**53 + 1
    triggers = [[(large, "a", _at(0), 0, True), (None, "a", _at(1), 0, True), (large + 2, "b", _at(2), 0, True)], [(None, None, _at(9999), 0, True)]]
    assert _replayed(spark, tmp_path, triggers, 20_000) == {large: "miss", None: "hit", large + 2: "miss"}


def test_replay_stream_begins_with_the_cache(spark, tmp_path):
    cached = spark.createDataFrame([("a", _at(-10)), ("a", _at(-500)), ("b", _at(-3000)), (None, _at(0)), ("c", None)], "id string, cached_at timestamp")
    triggers = [[(1, "a", _at(0), 0, True), (2, "b", _at(0), 0, True), (3, "c", _at(1), 0, True)], [(4, "a", _at(1195), 0, True), (5, "a", _at(9999), 0, True)], [(None, None, _at(99999), 0, True)]]
    assert _replayed(spark, tmp_path, triggers, 20 * 60_000, cached=cached) == {1: "hit", 2: "miss", 3: "miss", 4: "miss", 5: "miss"}


def test_dedup_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, "a", at), (2, "a", at + timedelta(seconds=1)), (3, "b", at)], "request_id long, id string, ts timestamp")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["id"] for r in _run(streams.dedup_stream(stream, "1 hour"), "dedup", tmp_path).collect()) == ["a", "b"]
