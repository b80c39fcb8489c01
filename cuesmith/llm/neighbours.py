"""Approximate nearest neighbours by collision counting over sorted projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Projections; share of them that a vector must collide in.
PROJECTIONS, THRESHOLD = 64, 0.92
#: Half the first window, in interquartile ranges of a projection; its growth from one round to the next.
FIRST, GROWTH = 0.75, 1.08
#: A query's windows stop widening once a share of a block's rows and SPARE * k more collide; those are verified. The
#: share is the first of SHARES at which PILOT of the block's queries, evenly spaced, which are also searched through
#: all rows, have TARGET of their true neighbours; at the last one every row is verified.
SHARES, SPARE = (0.02, 0.04, 0.08, 0.12, 0.16, 0.24, 0.32, 0.48, 1.0), 6
PILOT, TARGET = 32, 0.95
#: Vectors of a block, queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
#: Queries that are searched together.
PART = 64
EVERY = 20


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their largest absolute component, and the norms of the quotients: no square over- or underflows."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    shrunk = vectors / most
    return shrunk, np.sqrt((shrunk**2).sum(axis=1))


class SortedProjections:
    """A block's vectors in one sorted array for each random projection.

    Largest inner product becomes nearest point: every vector gets one more coordinate that brings all to the
    block's greatest norm, the query gets 0 there. Projections are on orthogonal axes, as far as there are so many.
    Windows are centred on the query's own projection, not on a grid, so widening them is the rehash. A row collides
    in a projection where its place lies in the window. The windows that decide are wide, so what is counted, along
    the sorted arrays, is the places outside them; a widening window only takes back what it adds.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 42) -> None:
        self.ids, self.vectors = ids, vectors
        scaled = vectors / np.abs(vectors).max()
        norms = np.sqrt((scaled**2).sum(axis=1))
        self.scale = norms.max()
        lift = np.sqrt(np.maximum(0.0, self.scale**2 - norms**2))
        rng, size = np.random.default_rng(seed), vectors.shape[1] + 1
        axes = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
        self.axes = np.column_stack(axes)[:, :PROJECTIONS]
        p = (np.column_stack([scaled, lift]) @ self.axes).T
        self.rough = scaled.astype(np.float32)
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, 1)
        self.share, self.recall = SHARES[-1], 1.0
        spread = np.subtract(*np.percentile(self.sorted, [75, 25], axis=1)).mean()
        self.width = max(float(spread) * FIRST, 1e-9)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the k best among the verified, best first, ties to the smaller id.

        A pilot sets the share of rows that is verified. Windows start a step below the width at which half of the
        pilot's were done: too wide a start only verifies more.
        """
        out = []
        shrunk, norms = _unit(queries)
        at = (shrunk * (self.scale / norms)[:, None]) @ self.axes[:-1]
        self._pilot(query_ids, queries, at, k)
        for i in range(0, len(queries), PART):
            part = slice(i, i + PART)
            out += self._search(query_ids[part], queries[part], at[part], k, self.first)[0]
        return out

    def _pilot(self, query_ids: np.ndarray, queries: np.ndarray, at: np.ndarray, k: int) -> None:
        """Set the share, and the recall that the pilot has with it."""
        some = np.unique(np.linspace(0, len(queries) - 1, min(PILOT, len(queries))).astype(int))
        least = []  # the k-th best score of each
        for i in some:
            _, scores = self._verified(np.flatnonzero(self.ids != query_ids[i]), queries[i], k)
            least.append((scores[-1] if len(scores) else np.inf, len(scores)))
        known, width = sum(n for _, n in least), self.width
        for self.share in SHARES:
            found, widths = self._search(query_ids[some], queries[some], at[some], k, width)
            self.recall = sum(int((scores >= kth).sum()) for (_, scores), (kth, _) in zip(found, least, strict=True)) / max(1, known)
            width = max(width, float(np.median(widths)) / GROWTH)
            if not known or self.recall >= TARGET:
                break
        self.first = width

    def _windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place plus one of each query's window in each sorted array."""
        lo = [np.searchsorted(s, x - width, "left") for s, x in zip(self.sorted, at.T, strict=True)]
        hi = [np.searchsorted(s, x + width, "right") for s, x in zip(self.sorted, at.T, strict=True)]
        return np.stack(lo, 1), np.stack(hi, 1)

    def _count(self, slices: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(slices), minlength=len(self.ids))

    def _search(self, query_ids, queries, at, k: int, width: float):
        n, out, widths = len(self.ids), [None] * len(queries), np.zeros(len(queries))
        spare, wanted = PROJECTIONS - int(np.ceil(THRESHOLD * PROJECTIONS)), min(n, int(self.share * n) + SPARE * k + 1)
        open_ = np.arange(len(queries))
        if wanted >= n:  # windows as wide as the arrays: every row collides
            every = np.arange(n)
            return [self._verified(every[self.ids != q], x, k) for q, x in zip(query_ids, queries, strict=True)], widths
        lo, hi = self._windows(at, width)
        outside = {}
        for q in open_:
            tails = [o[:a] for o, a in zip(self.order, lo[q], strict=True)] + [o[b:] for o, b in zip(self.order, hi[q], strict=True)]
            outside[q] = self._count(tails)
        while len(open_):
            left = []
            for q in open_:
                found = np.flatnonzero(outside[q] <= spare)
                if len(found) < wanted and (lo[q].any() or (hi[q] < n).any()):
                    left.append(q)
                    continue
                del outside[q]
                out[q], widths[q] = self._verified(found[self.ids[found] != query_ids[q]], queries[q], k), width
            open_, width = np.array(left, np.int64), width * GROWTH
            if len(open_):
                below, above = self._windows(at[open_], width)
                for q, a, b in zip(open_, below, above, strict=True):
                    added = [o[x:y] for o, x, y in zip(self.order, a, lo[q], strict=True)] + [o[x:y] for o, x, y in zip(self.order, hi[q], b, strict=True)]
                    outside[q] -= self._count(added)
                    lo[q], hi[q] = a, b
        return out, widths

    def _verified(self, found: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the rows found, by exact products of those that rough ones leave in question."""
        if len(found) > 4 * k:
            unit = query / np.abs(query).max()
            rough = self.rough[found] @ unit.astype(np.float32)
            slack = 1e-5 * len(query) * float(self.scale)  # products of numbers up to 1, far above single precision's error
            found = found[rough >= np.partition(rough, -k)[-k] - slack]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (self.vectors[found] * query).sum(axis=1)
            over = ~np.isfinite(scores)  # beyond doubles, maybe on both sides: infinite with the product's own sign
            if over.any():
                signs = np.sign((_unit(self.vectors[found[over]])[0] * _unit(query[None])[0]).sum(axis=1))
                scores[over] = np.where(signs == 0, 0.0, signs * np.inf)
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    """Without vectors that are null, empty, zero, or hold a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = F.col(column).cast("array<double>")
    return vectors.where(
        F.col("vec_id").isNotNull()
        & F.col(column).isNotNull()
        & ~F.coalesce(F.exists(doubles, bad), F.lit(True))
        & F.exists(doubles, lambda x: x != 0)
    )


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(rows):
        sizes = rows["v"].map(len)
        for size in sizes.unique():  # vectors meet queries of their own length
            same, asked = rows[sizes == size], queries[queries["v"].map(len) == size]
            if not len(asked):
                continue
            index = SortedProjections(same["vec_id"].to_numpy(), np.stack(same["v"].to_numpy()).astype(np.float64))
            asking = asked["query_id"].to_numpy()
            found = index.search(asking, np.stack(asked["v"].to_numpy()).astype(np.float64), k)
            out += [pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}) for q, (ids, scores) in zip(asking, found, strict=True)]
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, column: str = "embedding") -> DataFrame:
    """The k largest inner products of each query: ``query_id, rank, vec_id, score``.

    queries and vectors have vec_id and the vector column. Rows are dealt evenly into blocks of about
    BLOCK_ROWS by a hash of the id; each block of queries meets each block of rows in one task, whose memory
    those two sizes bound. In it, windows around a query's projections widen until the rows that collide with
    it in THRESHOLD of the projections make up the share of the block that its pilot asks for; those are verified by the exact inner
    product, in double precision. A row isn't its query's own candidate. Equal vectors collide alike, so copies
    stand or fall together; ties go to the smaller vec_id; fewer than k candidates are all returned. Vectors
    that are null, zero or hold a null or non-finite component take no part. Norms may be as small or large as
    doubles go: only the order within a block is scaled, scores are of the vectors as they are, infinite with the
    product's sign where it overflows. Rows that repeat an id count once, with the least of
    their vectors. No vectors, or no queries, give no rows; other columns are ignored.
    """
    once = lambda df: _valid(df, column).groupBy("vec_id").agg(F.min(column).alias("v"))
    good = materialize(once(vectors))
    asked = materialize(once(queries).withColumnRenamed("vec_id", "query_id"))
    n_rows = max(1, -(-good.count() // BLOCK_ROWS))
    n_queries = max(1, -(-asked.count() // BLOCK_QUERIES))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select(block("query_id", n_queries).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"), "query_id", "v")
    right = good.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), block("vec_id", n_rows).alias("rb"), "vec_id", "v")

    def search(key, queries, rows):
        return _search(queries, rows, k)

    found = (
        left.groupBy("qb", "rb")
        .cogroup(right.groupBy("qb", "rb"))
        .applyInPandas(search, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % EVERY == 0), vectors)
