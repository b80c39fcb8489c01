"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec, vocabulary
from .common import materialize, small_batches, table

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, length``: the ids that byte-level BPE gives each whole text; 0 for null and empty ones."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def length(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(path, pattern)
        for texts in parts:
            yield pd.Series([len(x) for x in bpe.encode(texts)] if len(texts) else [], dtype="int64")

    # A filter on a deterministic function's result is moved below it, and every text would be encoded twice.
    return docs.select("doc_id", length.asNondeterministic()("text").alias("length"))


def histogram(lengths: DataFrame) -> DataFrame:
    """``lengths(length)`` -> one row for each length that occurs, with sums over all lengths at and above it.

    length, docs, tokens: that length's own; docs_ge, tokens_ge: at or above it; docs_lt, tokens_lt: below it.
    Documents are added up by length before the shuffle. Suffix sums run in blocks of BLOCK lengths, and over
    the blocks' totals, so no window holds all lengths. Null lengths are left out; no lengths give no rows.
    """
    own = materialize(
        lengths.where("length is not null")
        .groupBy("length")
        .agg(F.count("*").alias("docs"))
        .withColumns({"tokens": F.col("length") * F.col("docs"), "block": F.floor(F.col("length") / BLOCK)})
    )
    after = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    blocks = (
        own.groupBy("block")
        .agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_above"),
            F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_above"),
            F.sum("d").over(every).alias("all_docs"),
            F.sum("t").over(every).alias("all_tokens"),
        )
    )
    at = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        own.withColumns({"d": F.sum("docs").over(at), "t": F.sum("tokens").over(at)})
        .join(blocks, "block")
        .select(
            "length",
            "docs",
            "tokens",
            (F.col("d") + F.col("d_above")).alias("docs_ge"),
            (F.col("t") + F.col("t_above")).alias("tokens_ge"),
            (F.col("all_docs") - F.col("d") - F.col("d_above")).alias("docs_lt"),
            (F.col("all_tokens") - F.col("t") - F.col("t_above")).alias("tokens_lt"),
        )
    )


def truncated_total(found: DataFrame) -> DataFrame:
    """The histogram with ``truncated_tokens``: all tokens if each document is cut at this row's length."""
    return found.withColumn("truncated_tokens", F.col("tokens_lt") + F.col("length") * F.col("docs_ge"))


def at_limits(found: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, also one that no document has: documents above it, and all tokens after the cut."""
    asked = found.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    over = F.col("length") > F.col("limit")
    # A few limits against the histogram: one pass, with a sum for each limit.
    return (
        found.select("length", "docs", "tokens", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
        .groupBy("limit")
        .agg(
            F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least("length", "limit") * F.col("docs")).alias("truncated_tokens"),
        )
        .join(asked, "limit", "right")
        .select("limit", F.coalesce("docs_over", F.lit(0)).alias("docs_over"), F.coalesce("truncated_tokens", F.lit(0)).alias("truncated_tokens"))
    )


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """For each share, the least length that so many of the documents don't exceed; no rows for an empty histogram."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    upto = F.col("docs_lt") + F.col("docs")
    return (
        found.select("length", upto.alias("upto"), (F.col("docs_lt") + F.col("docs_ge")).alias("all"), share)
        .where("upto >= share * all")
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with its suffix sums and the total after a cut at each length."""
    lengths = encoded_lengths(table(spark, sf_dir, "documents"), *vocabulary())
    return truncated_total(histogram(lengths))
