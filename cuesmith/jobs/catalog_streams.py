"""Queries that run as streams: files arrive, the stream takes them, stops, and a later one goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import streams
from .catalog import HITS, HOUR, SITE, result_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _in_two_runs(parts: list[DataFrame], stream: Callable[[str], DataFrame]) -> DataFrame:
    """Each part's files are written, and taken by a stream that is started for them and ends; what all of them gave."""
    spark = parts[0].sparkSession
    at = scratch(spark)
    for i, part in enumerate(parts):
        part.write.parquet(f"{at}/in/{i}")
        streams.run_available(stream(f"{at}/in/*"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@_query(HITS)
def stream_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages to hits; a third of the pages comes after a restart, which doesn't take the others again."""
    pages = result_pages(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    late = F.col("o_custkey") % 3 == 0
    schema = "o_custkey long, html string"
    return _in_two_runs([pages.where(~late), pages.where(late)], lambda path: streams.stream_hits(spark, path, schema, SITE))


#: The events' time in the middle, in milliseconds, where the log is cut.
_MIDDLE = "(min(epoch_us(ts) // 1000) + max(epoch_us(ts) // 1000)) // 2"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    return events, (first + last) // 2


@_query(
    f"""WITH m AS (SELECT {_MIDDLE} AS middle FROM events),
g AS (SELECT user_id, (epoch_us(ts) // 1000) > middle AS later, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last FROM events, m GROUP BY ALL),
f AS (SELECT user_id, later, CASE WHEN user_id % 2 = 0 THEN first ELSE last END AS t FROM g),
w AS (SELECT max(t) - 24 * {HOUR} AS mark FROM f WHERE NOT later),
s AS (SELECT user_id FROM f, w WHERE NOT later AND t + 24 * {HOUR} > mark)
SELECT user_id AS id, t FROM f WHERE NOT later UNION ALL SELECT user_id, t FROM f WHERE later AND user_id NOT IN (SELECT user_id FROM s)"""
)
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request of each user (the first or the last) of both halves of the log; the second goes if the first is remembered past the restart."""
    events, middle = _halves(spark, sf_dir)
    later = F.unix_millis("ts") > middle
    one = F.when(F.col("id") % 2 == 0, F.min("ts")).otherwise(F.max("ts"))
    each = events.groupBy(F.col("user_id").alias("id"), later.alias("later")).agg(one.alias("ts"))
    parts = [each.where(~F.col("later")).drop("later"), each.where("later").drop("later")]
    read = lambda path: spark.readStream.schema("id long, ts timestamp").parquet(path)
    kept = _in_two_runs(parts, lambda path: streams.dedup_stream(read(path), "24 hours"))
    return kept.select("id", F.unix_millis("ts").alias("t"))


#: Requests that come with the second half though they belong to the first; the delay that is allowed; slices of time.
_MOVED, _DELAY, _SLICE = "event_id % 20 = 7", 12 * HOUR, 24 * HOUR


@_query(
    f"""WITH RECURSIVE m AS (SELECT {_MIDDLE} AS middle FROM events),
e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, (event_id % 9) * {HOUR} AS latency, event_type <> 'error' AS ok, (epoch_us(ts) // 1000) > middle OR {_MOVED} AS later FROM events, m),
w AS (SELECT max(t) - {_DELAY} AS mark FROM e WHERE NOT later),
l AS (SELECT event_id FROM e, w WHERE later AND (t // {_SLICE} + 1) * {_SLICE} <= mark),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e WHERE event_id NOT IN (SELECT event_id FROM l)),
r AS (SELECT user_id, event_id, n, 'miss' AS outcome, t + latency AS busy, CASE WHEN ok THEN t + latency END AS cached FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n,
CASE WHEN o.t < r.busy THEN 'coalesced' WHEN r.cached <= o.t AND o.t - r.cached <= {24 * HOUR} THEN 'hit' ELSE 'miss' END,
CASE WHEN o.t < r.busy OR coalesce(r.cached <= o.t AND o.t - r.cached <= {24 * HOUR}, false) THEN r.busy ELSE o.t + o.latency END,
CASE WHEN o.t < r.busy OR coalesce(r.cached <= o.t AND o.t - r.cached <= {24 * HOUR}, false) THEN r.cached WHEN o.ok THEN o.t + o.latency END
FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id AS request_id, user_id AS id, outcome FROM r UNION ALL SELECT event_id, user_id, 'late' FROM e WHERE event_id IN (SELECT event_id FROM l)"""
)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with latencies and failures, cut in the middle; some requests of the first half come with the second, late or within the delay."""
    events, middle = _halves(spark, sf_dir)
    log = events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("id"), "ts", ((F.col("event_id") % 9) * HOUR).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"),
        ((F.unix_millis("ts") > middle) | F.expr(_MOVED)).alias("later"),
    )
    none = lambda t: F.lit(None).cast(t)
    clock = spark.range(1).select(
        none("long").alias("request_id"), none("long").alias("id"), F.lit("2999-01-01").cast("timestamp").alias("ts"), none("long").alias("latency_ms"), none("boolean").alias("ok")
    )
    schema = "request_id long, id long, ts timestamp, latency_ms long, ok boolean"
    parts = [log.where(~F.col("later")).drop("later"), log.where("later").drop("later").unionByName(clock)]
    read = lambda path: spark.readStream.schema(schema).parquet(path)
    replayed = _in_two_runs(parts, lambda path: streams.replay_stream(read(path), 24 * HOUR, SITE, f"{_DELAY} milliseconds", width_ms=_SLICE))
    return replayed.select("request_id", "id", "outcome")
