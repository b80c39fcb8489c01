"""Quality rules: text statistics, and robust multivariate outliers per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, materialize, row_hash, table, words

#: Words in a window for repeats.
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The transformed statistics, each with the least standard deviation that is taken for real: statistics that are
#: zero for nearly all documents have none of their own.
FLOORS = {"z_word": 0.10, "z_symbol": 0.06, "z_line": 0.083, "z_repeat": 0.10}
#: Share of a group that the determinant is taken over, and the factor that makes up for the tails left out:
#: share / P(chi2(6) <= the share's quantile of chi2(4)).
SHARE, CONSISTENCY = 0.75, 1.486
STEPS = 3
#: A squared distance above this is an outlier's. chi2(4) exceeds 43 for one in 10^8.
CUTOFF = 43.0
#: A group of fewer documents takes the estimate of its language, and that one the estimate of all.
MIN_GROUP = 50
#: Rows of estimates, one for each group, up to which they are broadcast: a few MB.
MOST_BROADCAST = 20_000

#: Order statistics are found in steps of 2**-COARSE, then of 2**-FINE within one of these.
COARSE, FINE = 10, 30

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)``, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ahead(xs: Column, k: int) -> Column:
    return F.slice(xs, F.lit(k + 1), F.size(xs))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` -> ``doc_id, row, lang, source``, the five base statistics and n_lines (with a word) as longs.

    Null and empty texts have zero of each. A window is eight words; n_repeat_words counts the words that lie in
    a window found at least twice in the text. Windows are compared by a 64-bit hash built by doubling, so no
    text is moved or exploded, and only texts with a repeated window sort theirs.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        "doc_id",
        row_hash(docs).alias("row"),
        "lang",
        "source",
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct"))).alias("lines"),
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"),
    )
    both = lambda x, y: F.xxhash64(x, y)
    n = F.col("n_words")
    counted = {"n_words": F.size("h"), "n_lines": F.col("lines.all"), "n_dup_lines": F.col("lines.all") - F.col("lines.distinct")}
    hashed = first.withColumns({k: c.cast("long") for k, c in counted.items()}).withColumn(
        "h",
        F.when(
            n >= WINDOW,
            F.slice(
                _let(
                    _let(
                        _let(F.col("h"), lambda a: F.zip_with(a, _ahead(a, 1), both)),
                        lambda a: F.zip_with(a, _ahead(a, 2), both),
                    ),
                    lambda a: F.zip_with(a, _ahead(a, 4), both),
                ),
                F.lit(1),
                (n - (WINDOW - 1)).cast("int"),
            ),
        ),
    )
    twice = lambda s: F.filter(
        s,
        lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)),
    )
    starts = F.array_sort(
        F.transform(
            _let(F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice), lambda x: x["i"]
        )
    )
    covered = _let(
        starts,
        lambda p: F.aggregate(
            F.zip_with(p, _ahead(p, 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
            F.lit(0),
            lambda s, x: s + x,
        ),
    )
    repeats = F.when(F.size("h") > F.size(F.array_distinct("h")), covered).otherwise(0).cast("long")
    return hashed.withColumn("n_repeat_words", repeats).select("doc_id", "row", "lang", "source", *STATS, "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "z_word": F.log((F.col("word_chars") + 1.0) / n),
            "z_symbol": F.sqrt(F.least(F.col("n_symbols") / n, F.lit(25.0))),
            "z_line": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
            "z_repeat": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def _distance() -> Column:
    """Squared distance from the centre m_* under the Cholesky factor l_*_*, by forward substitution."""
    ys: list[Column] = []
    for i, a in enumerate(FLOORS):
        y = F.col(a) - F.col(f"m_{a}")
        for j, b in enumerate(list(FLOORS)[:i]):
            y = y - F.col(f"l_{a}_{b}") * ys[j]
        ys.append(y / F.col(f"l_{a}_{a}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _factor(moments: DataFrame) -> DataFrame:
    """Means m_* and covariances c_*_* -> the Cholesky factor l_*_*, column by column."""
    names = list(FLOORS)
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            value = F.col(f"c_{a}_{b}")
            for k in names[:j]:
                value = value - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            if a == b:
                value = F.sqrt(F.greatest(value, F.lit(FLOORS[a] ** 2)))
            else:
                value = value / F.col(f"l_{b}_{b}")
            moments = moments.withColumn(f"l_{a}_{b}", value)
    return moments


def _mean(x: Column) -> Column:
    """The mean to nine decimals, summed in whole numbers: the same in whatever order rows are added up."""
    return F.sum(F.round(x * 1e9).cast("decimal(20,0)")).cast("double") / 1e9 / F.count("*")


def _moments(rows: DataFrame) -> DataFrame:
    names = list(FLOORS)
    sums = rows.groupBy("g").agg(
        *[_mean(F.col(a)).alias(f"m_{a}") for a in names],
        *[_mean(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]],
    )
    cov = [
        (
            CONSISTENCY * (F.col(f"p_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}"))
            + (F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0))
        ).alias(f"c_{a}_{b}")
        for i, a in enumerate(names)
        for b in names[: i + 1]
    ]
    return _factor(sums.select("g", *[f"m_{a}" for a in names], *cov))


def order_statistics(rows: DataFrame, columns: dict[str, Column], share: float) -> DataFrame:
    """``rows(g, ...)`` -> for each g and name the value that ``share`` of its rows don't exceed, to 2**-FINE, from above.

    Values are not negative. They are counted in coarse steps, so a group of any size is a short list after the sums
    before the shuffle; then the rows of the step in which the place falls are counted in fine ones. Counts are exact,
    so the result doesn't depend on partitions.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("v")) for k, v in columns.items()]))
    values = rows.select("g", each.alias("x")).select("g", "x.c", F.floor(F.col("x.v") * 2.0**COARSE).alias("step"), F.floor(F.col("x.v") * 2.0**FINE).alias("fine"))
    run = W.partitionBy("g", "c").orderBy("at")
    before = lambda df, at: df.groupBy("g", "c", F.col(at).alias("at")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(run))
    coarse = before(values, "step").withColumn("place", F.ceil(F.max("upto").over(W.partitionBy("g", "c")) * F.lit(share)))
    step = materialize(coarse.where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))))
    asked = step.select("g", "c", F.col("at").alias("step"), (F.col("place") - F.col("upto") + F.col("n")).alias("left"))
    fine = before(values.join(_small(asked.drop("left")), ["g", "c", "step"], "left_semi"), "fine").join(_small(asked.drop("step")), ["g", "c"])
    found = fine.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
    return found.groupBy("g").agg(*[((F.max(F.when(F.col("c") == k, F.col("at"))) + 1) / F.lit(2.0**FINE)).alias(k) for k in columns])


def _small(params: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has few enough rows; else joins shuffle."""
    return F.broadcast(params) if params.count() <= MOST_BROADCAST else params


def estimates(vectors: DataFrame) -> DataFrame:
    """``vectors(g, z_*)`` -> for each g the minimum-covariance-determinant centre m_* and factor l_*_*.

    The start is deterministic: medians and median deviations. Each concentration step then takes the mean and
    covariance over the SHARE of the group that lies nearest under the last estimate, which never raises the
    determinant. Medians, quantiles and sums are exact to nine decimals, whatever the partitions, and a group of any
    size is summed before the shuffle.
    """
    names = list(FLOORS)
    mid = materialize(order_statistics(vectors, {f"m_{a}": F.col(a) for a in names}, 0.5))
    off = order_statistics(vectors.join(_small(mid), "g"), {f"l_{a}_{a}": F.abs(F.col(a) - F.col(f"m_{a}")) for a in names}, 0.5)
    wide = off.select("g", *[F.greatest(1.4826 * F.col(f"l_{a}_{a}"), F.lit(FLOORS[a])).alias(f"l_{a}_{a}") for a in names]).join(mid, "g")
    zero = {f"l_{a}_{b}": F.lit(0.0) for i, a in enumerate(names) for b in names[:i]}
    now = materialize(wide.withColumns(zero))
    for _ in range(STEPS):
        far = vectors.join(_small(now), "g").withColumn("far", F.sqrt(_distance()))
        near = materialize(order_statistics(far, {"most": F.col("far")}, SHARE))
        now = materialize(_moments(far.join(_small(near), "g").where("far <= most")))
    return now


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: ``doc_id, row``, the base statistics, ``base_failed``, ``distance`` and ``kept``.

    A document is kept unless it fails a base rule or its squared Mahalanobis distance from the robust centre of
    its language and source exceeds CUTOFF. Estimates are taken over the documents that pass the base rules. Null
    languages and sources are groups of their own; a group with fewer than MIN_GROUP documents takes its
    language's estimate, or that of all documents. With no estimate at all the distance is null and only the
    base rules decide. An empty table gives no rows; repeated rows get one verdict each; other columns are ignored.
    """
    stats = materialize(statistics(docs))
    level = [F.to_json(F.struct(F.coalesce(F.to_json(F.struct(*c)), F.lit("")).alias("k"))) for c in (["lang", "source"], ["lang"])]
    keyed = _vector(stats).withColumns({"base_failed": base_failed(), "g2": level[0], "g1": level[1]})
    passed = keyed.where(~F.col("base_failed"))
    own = passed.groupBy("g2").agg(F.count("*").alias("n2"))
    lang = passed.groupBy("g1").agg(F.count("*").alias("n1"))
    sizes = (
        keyed.select("g2", "g1").distinct().join(own, "g2", "left").join(lang, "g1", "left")
    )
    groups = materialize(
        sizes.select(
            "g2",
            "g1",
            F.when(F.col("n2") >= MIN_GROUP, F.col("g2")).when(F.col("n1") >= MIN_GROUP, F.col("g1")).otherwise("all").alias("g"),
        )
    )
    # Each document counts in its own group, in its language and in all, where those are somebody's estimate.
    asked = _small(groups.select("g").distinct())
    levels = F.explode(F.array("g2", "g1", F.lit("all"))).alias("g")
    vectors = materialize(passed.select(levels, *FLOORS).join(asked, "g", "left_semi"))
    found = estimates(vectors)
    of = materialize(groups.join(found, "g", "left").drop("g", "g1"))
    far = keyed.join(_small(of), "g2", "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return far.select("doc_id", "row", *STATS, "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs. Rows without an id are judged like others."""
    none = F.lit(-(2**63))
    kept = verdicts(docs).where("kept").select(F.coalesce("doc_id", none).alias("__id"), F.col("row").alias("__row"))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", none), "__row": row_hash(docs)})
    return keyed.join(kept, ["__id", "__row"], "left_semi").select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of every document."""
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept", "distance")
