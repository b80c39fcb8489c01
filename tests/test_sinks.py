"""Subtitles and outcomes as they are written."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cuesmith.sources import io
from cuesmith.sources.store import StaleRun, SubtitleStore

SHAPE = "id string, name string, encoding string, text string, cached_at timestamp, error struct<status: int, code: string, message: string>"
AT = datetime(2024, 1, 1)


def subs(spark, **texts):
    bad = (422, "INVALID_ARCHIVE", "no")
    return spark.createDataFrame([(k[1:], "n", "utf-8", t, AT, bad if t == "bad" else None) for k, t in texts.items()], SHAPE)


def texts(df) -> dict[str, str]:
    rows = df.collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["text"] for r in rows}


def test_runs_replace_their_ids_at_once(spark, tmp_path):
    store = SubtitleStore(spark, f"file://{tmp_path}/store")
    assert texts(store.read()) == {} and store.runs() == []
    assert store.commit(subs(spark, _0012="a", _0013="b", _7="c", _71234="d", _bad="bad")) == 1
    first = {"0012": "a", "0013": "b", "7": "c", "71234": "d"}
    assert texts(store.read()) == first
    assert store.commit(subs(spark, _0013="new", _7="bad", _9="e")) == 2
    assert texts(store.read()) == first | {"0013": "new", "9": "e"}
    assert texts(store.read(1)) == first  # a reader of an earlier run isn't disturbed
    assert store.commit(subs(spark, _7=None)) == 3
    assert texts(store.read()) == texts(store.read(2))
    assert len(set(store.manifest().values())) == 2  # prefixes that no run touched stay where they were
    assert len(store.vacuum(keep=1)) == 0 and store.runs() == [3]
    store.commit(subs(spark, _0012="x", _0013="y", _7="z", _71234="w"))
    assert len(store.vacuum(keep=1)) == 1
    assert texts(store.read()) == {"0012": "x", "0013": "y", "7": "z", "71234": "w", "9": "e"}


def test_a_failed_run_leaves_nothing_to_see(spark, tmp_path):
    store = SubtitleStore(spark, f"file://{tmp_path}/store")
    store.commit(subs(spark, _1="a"))
    broken = subs(spark, _1="b").withColumn("text", F.when(F.col("id") == "1", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        store.commit(broken)
    assert texts(store.read()) == {"1": "a"} and store.runs() == [1]


def test_of_two_runs_at_once_one_is_stale(spark, tmp_path):
    one, two = (SubtitleStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    one.commit(subs(spark, _1="a"))
    seen = one.manifest()
    two.commit(subs(spark, _2="b"))
    with pytest.raises(StaleRun):
        one._publish(2, seen)
    assert texts(one.read()) == {"1": "a", "2": "b"}
    assert [n for n in one._names("manifest") if not n.endswith(".json")] == []


def test_repeated_ids_and_sizes(spark, tmp_path):
    store = SubtitleStore(spark, f"file://{tmp_path}/store")
    rows = [("5", "n", "utf-8", "old", datetime(2023, 1, 1), None), ("5", "n", "utf-8", "new", AT, None), ("5", "n", "utf-8", "none", None, None)]
    store.commit(spark.createDataFrame(rows, SHAPE))
    assert [(r["text"], r["n_bytes"]) for r in store.read().collect()] == [("new", 3)]


def test_shares_are_even():
    plan = dict((g, (a, n)) for g, a, n in io.shares([("hot", 1000), *[(f"s{i}", i) for i in range(1, 40)], ("none", 0)], 100))
    assert plan["hot"] == (0, 10)
    held: dict[int, int] = {}
    for i in range(1, 40):
        held[plan[f"s{i}"][0]] = held.get(plan[f"s{i}"][0], 0) + i
    assert max(held.values()) <= 100 and len(held) <= 10 and min(held) == 10


def test_a_hot_prefix_is_written_by_even_tasks(spark, tmp_path):
    """Most bytes in one prefix: the largest file has less than twice the median's rows."""
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.concat(F.lit("777"), F.lpad(F.col("id").cast("string"), 5, "0"))).otherwise(F.col("id").cast("string")).alias("id"))
    full = rows.select("id", F.lit("n").alias("name"), F.lit("utf-8").alias("encoding"), F.repeat(F.lit("x"), 500).alias("text"), F.lit(AT).alias("cached_at"))
    good = io.good_subtitles(full).withColumn("id_prefix", F.substring("id", 1, 3))
    counts = sorted(r["count"] for r in io.dealt(good, "id_prefix", F.col("n_bytes"), F.col("id"), 100_000).groupBy(F.spark_partition_id()).count().collect())
    assert len(counts) >= 20 and sum(counts) == 4000
    assert counts[-1] < 2 * counts[len(counts) // 2]


def test_outcomes_of_a_hot_day_are_cut(spark, tmp_path):
    log = spark.range(3000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 10 > 0, F.lit(AT)).alias("ts"), F.lit(None).cast("struct<status: int, code: string>").alias("error"))
    io.write_outcomes(log, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("day=2024-01-01/*.parquet"))
    assert len(files) > 1 and spark.read.parquet(str(tmp_path / "out")).count() == 3000
