"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize  # noqa: F401 - the operators take it from here

#: A word: a run of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Rows in an Arrow batch for whole texts: a worker holds one batch at a time.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_hash(df: DataFrame) -> Column:
    """A hash of id, text, language and source: with the id, it tells rows apart that share an id but differ."""
    cols = [F.col(c).cast("string") for c in ("doc_id", "text", "lang", "source") if c in df.columns]
    return F.xxhash64(*[F.coalesce(c, F.lit("\u0000null")) for c in cols])


ASCII_WORD = re.compile(WORD)
