"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, and seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize, n_words, row_hash, table

#: Weights of sources in code-point order, repeating; what share of all words the mix takes; most times a source is taken.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words in a block, and about how many in a shard. A source has at most MAX_SHARDS shards, of like size.
BLOCK, SHARD_WORDS, MAX_SHARDS = 16, 1 << 20, 65_536
SEED = 42
OUTPUT = ("size", "source_size", "target", "times", "part_from", "part_to", "taken")


def _key(source: str = "source") -> Column:
    """Orders as the sources by code point, null last, and joins nulls."""
    return F.when(F.col(source).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source).cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(src, size)`` -> ``src, source_size, target``: weighted shares, the excess over MOST times reshared.

    Sorted by cap over weight, a source is capped if its share of what the sources before it leave exceeds its
    cap; the level of the first that isn't holds for all the rest.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy("src")) - 1) % len(WEIGHTS)
    every = W.partitionBy(F.lit(0))
    ranked = per.withColumn("w", F.get(F.array(*map(F.lit, WEIGHTS)), place).cast("double")).withColumns(
        {"cap": F.col("source_size") * float(MOST), "total": SHARE * F.sum("source_size").over(every)}
    )
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = ranked.withColumn("level", left / weights)
    free = F.max(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level"))).over(every)
    return level.withColumn("free", free).select(
        "src", "source_size", F.least("cap", F.coalesce(F.col("free") * F.col("w"), F.col("cap"))).alias("target")
    )


def sainte_lague(rows: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """``rows`` with ``quota``: the seats of each group dealt to its rows by highest quotients weight / (2k - 1).

    The k-th seat goes to the highest quotient left, ties to the smaller key. For n rows and H seats the divisor
    that settles it lies within n/2 seats of the exact one, so a row's quota is known but for a few seats: only
    those quotients, about three a row, are ranked. Groups without weight get none.
    """
    of = W.partitionBy(group)
    n, total = F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(of), F.sum(weight).over(of)
    known = rows.withColumns({"__n": n, "__w": total}).withColumns(
        {
            "__q": F.when((F.col("__w") > 0) & (F.col(seats) > 0), F.col(weight) * F.col(seats) / F.col("__w")).otherwise(0.0),
            "__near": F.when(F.col(seats) > 0, F.col("__n") / (2.0 * F.col(seats))).otherwise(0.0),
        }
    )
    known = known.withColumns(
        {
            "__low": F.greatest(F.lit(0), F.ceil(F.col("__q") * (1 - F.col("__near")) - 0.5 - 1e-6)).cast("long"),
            "__high": F.ceil(F.col("__q") * (1 + F.col("__near")) + 0.5 + 1e-6).cast("long"),
        }
    ).withColumn("__open", F.col(seats) - F.sum("__low").over(of))
    asked = known.where("__q > 0").select(group, key, weight, "__open", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__k"))
    rank = F.row_number().over(of.orderBy((F.col(weight) / (2 * F.col("__k") - 1)).desc(), key, "__k"))
    won = asked.withColumn("__rank", rank).where("__rank <= __open").groupBy(group, key).agg(F.count("*").alias("__won"))
    return known.join(won, [group, key], "left").select(
        *rows.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota")
    )


def plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sizes(src, h, size)`` -> sources with target and n_shards, and shards with their quota of blocks."""
    sources = materialize(
        targets(sizes).withColumn(
            "n_shards", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long")
        )
    )
    seats = F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / BLOCK).cast("long")
    blocks = sainte_lague(sources.withColumns({"one": F.lit(0), "seats": seats}), "one", "src", "target", "seats")
    shards = (
        sizes.where("size > 0")
        .join(sources.select("src", "n_shards"), "src")
        .groupBy("src", F.pmod("h", "n_shards").alias("shard"))
        .agg(F.sum("size").alias("shard_size"))
        .join(blocks.select("src", F.col("quota").alias("seats")), "src")
    )
    n_blocks = F.ceil(F.col("shard_size") / BLOCK)
    dealt = sainte_lague(shards, "src", "shard", "shard_size", "seats").withColumns(
        {"quota": F.least("quota", MOST * n_blocks), "n_blocks": n_blocks}
    )
    extra = F.col("quota") % F.col("n_blocks")
    first = F.pmod(F.xxhash64(F.lit(SEED), "src", "shard"), F.col("n_blocks") - extra + 1)
    ranges = dealt.select(
        "src",
        "shard",
        F.floor(F.col("quota") / F.col("n_blocks")).alias("times"),
        (first * BLOCK).alias("lo"),
        F.least((first + extra) * BLOCK, "shard_size").alias("hi"),
    )
    return sources, materialize(ranges)


def mix(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with ``size, source_size, target, times, part_from, part_to, taken``.

    A source's documents, in a seeded order within seeded shards, are cut into blocks of BLOCK words. A shard's
    quota of blocks is taken as ``times`` whole passes and one seeded run of blocks; a document's share of the
    run is its words part_from to part_to (from 0, end exclusive), so few documents are cut. taken is
    times * size plus that part. Sizes of null texts are 0 and nothing is taken of them. Rows that share an id
    are dealt with one by one; the order is settled by id, size and a hash of the row, so reruns agree.
    Null sources are one source, the last. An empty table gives no rows. Columns of docs that are named like
    one of the seven are replaced by it. Without texts, docs come back without that column, and each is read once.
    """
    clash = {c: f"__own_{c}" for c in docs.columns if c in ("n_shards", "lo", "hi")}
    names, docs = [c for c in docs.columns if c not in OUTPUT], docs.drop(*OUTPUT).withColumnsRenamed(clash)
    h = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"))
    size = n_words(F.coalesce("text", F.lit("")))
    sized = docs.withColumns({"__src": _key(), "__h": h, "size": size, "__row": row_hash(docs)})
    slim = sized.select(F.col("__src").alias("src"), F.col("__h").alias("h"), "size")
    if with_text:
        sizes = materialize(slim)
    else:
        names.remove("text")
        sized = materialize(sized.drop("text"))
        sizes = sized.select(F.col("__src").alias("src"), F.col("__h").alias("h"), "size")
    sources, ranges = plan(sizes)
    spread = F.pmod("__h", F.when(F.col("size") > 0, F.col("n_shards")).otherwise(MAX_SHARDS))
    dealt = (
        sized.join(sources.select(F.col("src").alias("__src"), "source_size", "target", "n_shards"), "__src")
        .withColumn("__shard", F.when(F.col("size") > 0, spread).otherwise(-1 - spread))
        .join(ranges.select(F.col("src").alias("__src"), F.col("shard").alias("__shard"), "times", "lo", "hi"), ["__src", "__shard"], "left")
    )
    order = W.partitionBy("__src", "__shard").orderBy(F.xxhash64(F.lit(SEED + 1), "__h"), "__h", "doc_id", "size", "__row")
    begin = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("__at", begin)
    part = lambda x: F.least(F.greatest(F.col(x) - F.col("__at"), F.lit(0)), F.col("size"))
    cut = placed.withColumns(
        {
            "times": F.coalesce("times", F.lit(0)),
            "part_from": F.coalesce(part("lo"), F.lit(0)).cast("long"),
            "part_to": F.coalesce(part("hi"), F.lit(0)).cast("long"),
        }
    ).withColumn("taken", (F.col("times") * F.col("size") + F.col("part_to") - F.col("part_from")).cast("long"))
    return cut.select(*[F.col(clash.get(c, c)).alias(c) for c in names], *OUTPUT)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document and one for its part.

    A part is the text from the end of the word before it to the end of its last word; n_chars follows.
    """
    kept = {c: f"__kept_{c}" for c in docs.columns if c in OUTPUT}  # columns of the caller with our names
    found = mix(docs.withColumnsRenamed(kept)).where("taken > 0")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("times").cast("int"))
    part = F.when(F.col("part_to") > F.col("part_from"), F.array(F.struct(F.col("part_from").alias("a"), F.col("part_to").alias("b"))))
    each = found.withColumn("__take", F.explode(F.concat(whole, F.coalesce(part, F.expr("array()").cast("array<struct<a:bigint,b:bigint>>")))))
    pieces = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    a, b = F.col("__take.a"), F.col("__take.b")
    partial = b - a < F.col("size")
    new = F.array_join(F.slice(pieces, (a + 1).cast("int"), (b - a).cast("int")), "")
    out = each.withColumn("text", F.when(partial, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(partial, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and what its source aims at."""
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return found.select("doc_id", "size", "source_size", "target", "taken")
