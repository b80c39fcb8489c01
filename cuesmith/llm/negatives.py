"""Hard negatives by one-dimensional distance keys: vectors sorted by (pivot, distance), annuli scanned until a bound certifies the best."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows that pivots and cell borders are fitted on (those of the least hash), pivots of a vector length, rounds of fitting.
SAMPLE, PIVOTS, ROUNDS = 8192, 32, 6
#: Bytes of vectors that a task holds of rows and of anchors; below SPREAD times as much there are up to SPREAD blocks.
BLOCK_BYTES, SPREAD, LEAST_ROWS = 64 << 20, 64, 1024
#: Blocks that each window of an anchor visits before a bound is known.
FIRST = 2
#: A radius grows by this share of what a block spans; errors allowed to scores and to distances, for norms of about 1.
GROWTH, SLACK, SLACK_FAR = 1 / 6, 1e-9, 1e-6
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
MOST = (1 << 63) - 1


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as doubles: exact below 2**53, infinite where the product overflows."""
    with np.errstate(over="ignore"):
        return np.floor(vectors.astype(np.float64) * 256.0)


def small(most: float, size: int) -> bool:
    """Whether inner products of so many integers up to ``most`` are exact in doubles."""
    return most < 2**26 and most * most * max(1, size) < 2**53


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of any vectors: what passes 64 bits becomes the nearest long."""
    exact = lambda v: [int(x) * 256 if abs(x) >= 2.0**44 else int(np.floor(x * 256.0)) for x in v.astype(np.float64).tolist()]
    q = exact(query)
    return np.array([max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(exact(r), q, strict=True)))) for r in rows], np.int64)


class Geometry(NamedTuple):
    """Vectors over ``scale`` get one more coordinate that brings all to the squared norm ``norm2``; then the largest
    inner product is the nearest point, as a query gets 0 there."""

    scale: float
    norm2: float

    def points(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        y = np.where(np.abs(v) >= 2.0**52, v * (256.0 / self.scale), whole(v) / self.scale)  # the scale is a power of two
        return np.column_stack([y, np.sqrt(np.maximum(0.0, self.norm2 - (y**2).sum(axis=1)))])

    def query(self, vector: np.ndarray) -> np.ndarray:
        return np.append(self.points(vector[None])[0, :-1], 0.0)

    def base(self, query: np.ndarray) -> float:
        return float((query**2).sum()) + self.norm2

    def scaled(self, score: float) -> float:
        return score / self.scale / self.scale


class Cells(NamedTuple):
    """What all tasks know of the index: pivots by vector length, the borders of cells in the order of keys (length,
    pivot, distance), the distances that each cell has of each of its pivots, and the numbers of its blocks."""

    geometry: Geometry
    pivots: dict[int, np.ndarray]
    borders: list[tuple[int, int, float]]
    runs: dict[int, list[tuple[int, int, float, float]]]  # length -> cell, pivot, least and largest distance
    blocks: dict[int, tuple[int, int]]  # cell -> first block, number of blocks

    def around(self, size: int) -> np.ndarray:
        """The pivots of a length; one without any in the sample has the origin."""
        return self.pivots.get(size, np.zeros((1, size + 1)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def _exact_distances(points: np.ndarray, pivots: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivots[nearest]) ** 2).sum(axis=1))


def fit_pivots(points: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds from evenly spaced rows."""
    n = min(n, len(points))
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        for i in range(n):
            if (near == i).any():
                centres[i] = points[near == i].mean(0)
    return centres


def _keys(vectors: list[np.ndarray], cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot and the distance to it."""
    pivot, far = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        points, around = cells.geometry.points(np.stack([vectors[i] for i in at])), cells.around(size)
        near = _distances(points, around).argmin(1)
        pivot[at], far[at] = near, _exact_distances(points, around, near)
    return pivot, far


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _within(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start to its end."""
    n = np.maximum(ends - starts, 0)
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class Block:
    """Rows of a block, sorted by (pivot, distance), for vectors of one length."""

    def __init__(self, rows: pd.DataFrame, cells: Cells) -> None:
        rows = rows.sort_values(["pivot", "far", "vec_id"], kind="stable")
        self.ids, self.labels, self.far = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["far"].to_numpy()
        self.rows = np.stack(rows["v"].to_numpy())
        self.whole = whole(self.rows)
        self.most = float(np.abs(self.whole).max(initial=0.0))
        self.geometry, pivots = cells.geometry, rows["pivot"].to_numpy()
        starts = np.flatnonzero(np.diff(pivots, prepend=-1))
        self.starts, self.ends = starts, np.append(starts[1:], len(pivots))
        self.least, self.largest = self.far[self.starts], self.far[self.ends - 1]
        # All pivots' keys in one order, each pivot's in a stretch of its own.
        self.stretches = np.arange(len(starts)) * (2 * float(self.far.max(initial=0.0)) + 1)
        self.keys = self.far + np.repeat(self.stretches, self.ends - self.starts)
        self.around = cells.around(self.rows.shape[1])[pivots[starts]]

    def search(self, id_: int, label: int, vector: np.ndarray, windows: list[tuple[int, int, int]], k: int, same: bool, bounded: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each window (name, lo, hi) the k best rows with lo <= score <= hi, of the same label or of others.

        The scan begins where the nearest row of any window may lie and takes in each pivot's keys within a growing
        radius. It ends once each window has k rows that are nearer than the radius, or can have no more. Where other
        blocks have told each window's least score (bounded), its distance is the radius from the start.
        """
        g, query = self.geometry, self.geometry.query(vector)
        base, mine = g.base(query), whole(vector)
        every = not small(max(self.most, float(np.abs(mine).max(initial=0.0))), len(mine))  # then no bound is used
        reach = lambda score: float(np.sqrt(max(0.0, base - 2.0 * g.scaled(score))))  # noqa: E731 - the distance of a score
        slack = SLACK_FAR * np.sqrt(base + 1.0)
        inner = max(0.0, min(reach(hi) for _, _, hi in windows) - slack)
        away = np.sqrt(((self.around - query) ** 2).sum(axis=1))
        least, largest = self.least, self.largest
        full = float((away + largest).max())
        radius = max(inner, float(np.maximum(0.0, np.maximum(least - away, away - largest)).min()))
        grow = max((full - radius) * GROWTH, 1e-12)
        if bounded:
            radius, grow = max(reach(lo) for _, lo, _ in windows), 0.0
        done: tuple[np.ndarray, np.ndarray] | None = None
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            radius += grow
            lo, hi = self.starts, self.ends
            if not every:
                lo = self.keys.searchsorted(self.stretches + np.maximum(inner - away, away - radius) - slack, "left").clip(lo, hi)
                hi = self.keys.searchsorted(self.stretches + away + radius + slack, "right").clip(lo, hi)
            at = _within(lo, hi) if done is None else np.append(_within(lo, done[0]), _within(done[1], hi))
            done = (lo, hi) if done is None else (np.minimum(lo, done[0]), np.maximum(hi, done[1]))
            at = at[((self.labels[at] == label) == same) & (self.ids[at] != id_)]
            if len(at):
                ids = np.append(ids, self.ids[at])
                scores = np.append(scores, products(self.rows[at], vector) if every else (self.whole[at] @ mine).astype(np.int64))
            if every or radius >= full or all(self._certain(scores, k, lo, hi, reach, radius) for _, lo, hi in windows):
                break
        out = []
        for name, lo, hi in windows:
            inside = (scores >= lo) & (scores <= hi)
            best = np.lexsort((ids[inside], ~scores[inside]))[:k]  # ~x is -x - 1, which no long overflows
            out.append((name, ids[inside][best], scores[inside][best]))
        return out

    @staticmethod
    def _certain(scores: np.ndarray, k: int, lo: int, hi: int, reach, radius: float) -> bool:
        """Whether no row beyond the radius can be among a window's k best."""
        if reach(lo) <= radius:
            return True
        inside = scores[(scores >= lo) & (scores <= hi)]
        return len(inside) >= k and reach(int(np.partition(inside, -k)[-k])) <= radius


def _visits(query: np.ndarray, size: int, windows: list[dict], cells: Cells, first: bool) -> list[int]:
    """The blocks that an anchor visits: per window FIRST of the likeliest, or afterwards all others that its bound allows."""
    runs = cells.runs.get(size)
    if runs is None:
        return []
    g, around = cells.geometry, cells.around(size)
    base = g.base(query)
    cell, pivot = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    least, largest = np.array([r[2] for r in runs]), np.array([r[3] for r in runs])
    away = np.sqrt(((around - query) ** 2).sum(axis=1))[pivot]
    slack = SLACK * (base + 1.0)
    near = np.maximum(0.0, np.maximum(least - away, away - largest))
    limit = g.scaled(MOST)
    upper = np.minimum((base - near**2) / 2 + slack, limit)
    lower = (base - (away + largest) ** 2) / 2 - slack
    began: set[int] = set()
    later: set[int] = set()
    for w in windows:
        lo, hi = g.scaled(w["lo"]), g.scaled(w["hi"])
        may = (upper >= lo - slack) & (np.minimum(lower, limit) <= hi + slack)
        order = np.lexsort((lower, -np.minimum(upper, hi)))
        began.update(dict.fromkeys(cell[order][may[order]].tolist()[:FIRST]))
        if not first:
            bound = lo if w["kth"] is None else g.scaled(w["kth"])
            later.update(cell[may & (upper >= bound - slack)].tolist())
    chosen = began if first else later - began
    return [b for c in sorted(chosen) for b in range(cells.blocks[c][0], cells.blocks[c][0] + cells.blocks[c][1])]


_WINDOWS = "array<struct<w: long, lo: long, hi: long, kth: long>>"


class Index(NamedTuple):
    rows: DataFrame  # block, vec_id, label, v, pivot, far
    sent: Broadcast  # of Cells
    most: int  # rows or anchors of a task
    kind: str  # of v


def build_index(vectors: DataFrame) -> Index:
    """``vectors(vec_id, label, v)``, valid and each id once -> the keyed table in blocks. Every row is in it."""
    spark = vectors.sparkSession
    doubles = F.col("v").cast("array<double>")
    n, size, top = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.coalesce(F.array_max(F.transform(doubles, F.abs)), F.lit(0.0)))).first()
    scale = 2.0 ** min(1000, int(np.ceil(np.log2(max(1.0, top or 0.0)))) + 9)
    part = lambda x: (F.abs(x) / F.lit(scale / 256.0)) + F.lit(1.0 / scale)
    norm2 = vectors.agg(F.max(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + part(x) * part(x)))).first()[0] or 0.0
    geometry = Geometry(scale, float(norm2) * (1 + SLACK) + SLACK)
    sample = vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    points = {s: geometry.points(np.array(vs, np.float64).reshape(len(vs), s)) for s, vs in by_size.items()}
    cells = Cells(geometry, {s: fit_pivots(p, min(PIVOTS, 1 + len(p) // 16)) for s, p in points.items()}, [], {}, {})
    most = max(1, BLOCK_BYTES // (8 * max(1, size or 1)))
    wanted = max(1, -(-(n or 0) // max(1, min(most, max(LEAST_ROWS, (n or 0) // SPREAD)))))
    keys = []
    for s, p in points.items():
        near = _distances(p, cells.around(s)).argmin(1)
        keys += [(s, int(a), float(b)) for a, b in zip(near, _exact_distances(p, cells.around(s), near), strict=True)]
    keys.sort()
    places = np.linspace(0, len(keys), min(wanted, len(keys)) + 1).astype(int)[1:-1] if keys else []
    cells = cells._replace(borders=sorted({keys[i] for i in places}))
    sent = spark.sparkContext.broadcast(cells)
    kind = vectors.schema["v"].dataType.simpleString()

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        borders = np.array(cells.borders, [("s", np.int64), ("p", np.int64), ("f", np.float64)])
        for batch in batches:
            vectors = _vectors(batch.column("v"))
            pivot, far = _keys(vectors, cells)
            mine = np.array(list(zip(map(len, vectors), pivot, far, strict=True)), borders.dtype)
            cell = np.searchsorted(borders, mine, "right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot, pa.int32()), pa.array(far, pa.float64()), pa.array(cell, pa.int32())],
                names=[*batch.schema.names, "pivot", "far", "cell"],
            )

    id_, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    keyed = materialize(
        vectors.select("vec_id", "label", "v").mapInArrow(key, f"vec_id {id_}, label {label}, v {kind}, pivot int, far double, cell int")
    )
    runs = keyed.groupBy("cell", F.size("v").alias("size"), "pivot").agg(F.min("far").alias("a"), F.max("far").alias("b"), F.count("*").alias("n")).collect()
    of: dict[int, list] = {}
    counts: dict[int, int] = {}
    for r in runs:
        of.setdefault(r["size"], []).append((r["cell"], r["pivot"], r["a"], r["b"]))
        counts[r["cell"]] = counts.get(r["cell"], 0) + r["n"]
    held = min(most, max(LEAST_ROWS, 2 * (n or 0) // SPREAD))
    blocks, at = {}, 0
    for c in sorted(counts):  # a cell of more rows than a task may hold, as of many equal vectors, is several blocks
        blocks[c] = at, -(-counts[c] // held)
        at += blocks[c][1]
    sent = spark.sparkContext.broadcast(cells._replace(runs=of, blocks=blocks))
    shape = spark.createDataFrame([(c, a, m) for c, (a, m) in blocks.items()], "cell int, start int, many int")
    rows = keyed.join(F.broadcast(shape), "cell").withColumn("block", F.col("start") + F.pmod(F.xxhash64("vec_id"), "many").cast("int"))
    return Index(rows.select("block", "vec_id", "label", "v", "pivot", "far"), sent, held, kind)


def _visiting(asked: DataFrame, index: Index, first: bool) -> DataFrame:
    sent, names = index.sent, ["qid", "qlabel", "q", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            vectors, windows = _vectors(batch.column("q")), batch.column("windows").to_pylist()
            blocks = [_visits(cells.geometry.query(v), len(v), w, cells, first) for v, w in zip(vectors, windows, strict=True)]
            for at in range(0, len(blocks), 64):
                part = blocks[at : at + 64]
                rows = pa.array(np.repeat(np.arange(at, at + len(part)), [len(b) for b in part]))
                taken = [batch.column(c).take(rows) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([b for p in part for b in p], pa.int32()), *taken], names=["block", *names])

    kinds = dict(asked.dtypes)
    return asked.select(*names).mapInArrow(run, f"block int, qid {kinds['qid']}, qlabel {kinds['qlabel']}, q {index.kind}, windows {_WINDOWS}")


def _scan(visits: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """Visits by block, in chunks that a task can hold, meet the block's rows: ``qid, w, vec_id, score``."""
    sent = index.sent
    visits = materialize(visits)
    chunks = visits.groupBy("block").agg((F.floor((F.count("*") - 1) / index.most) + 1).cast("int").alias("chunks"))
    left = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("qid"), "chunks").cast("int")).drop("chunks")
    right = index.rows.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def run(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for size, part in rows.groupby(rows["v"].map(len)):
            block = Block(part, sent.value)
            for q in asked[asked["q"].map(len) == size].itertuples():
                windows = [(w["w"], w["lo"] if w["kth"] is None else max(w["lo"], w["kth"]), w["hi"]) for w in q.windows]
                bounded = all(w["kth"] is not None for w in q.windows)
                got = block.search(q.qid, q.qlabel, np.asarray(q.q), windows, k, same, bounded)
                found += [(q.qid, name, ids, scores) for name, ids, scores in got if len(ids)]
        many = [len(ids) for *_, ids, _ in found]
        each = lambda i: np.repeat(np.array([f[i] for f in found], np.int64), many)
        joined = lambda i: np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)])
        return pd.DataFrame({"qid": each(0), "w": each(1), "vec_id": joined(2), "score": joined(3)})

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(run, "qid long, w long, vec_id long, score long")


def search(asked: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """``asked(qid, qlabel, q, windows)`` -> ``qid, w, rank, vec_id, score``: the k best of each window, certified.

    A window (w, lo, hi) takes scores from lo to hi of rows with the anchor's label (``same``) or of all others. Each
    anchor first visits the likeliest blocks; their k-th score bounds what the others, visited next, must reach.
    """
    order = W.partitionBy("qid", "w").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    open_ = asked.withColumn("windows", F.transform("windows", lambda x: F.struct(x["w"].alias("w"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.lit(None).cast("long").alias("kth"))))
    found = materialize(best(_scan(_visiting(open_, index, True), index, k, same)))
    bounds = found.where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bounds"))
    known = open_.join(bounds, "qid", "left").withColumn("windows", F.transform("windows", lambda x: x.withField("kth", F.try_element_at("bounds", x["w"]))))
    more = _scan(_visiting(known, index, False), index, k, same)
    return best(found.drop("rank").unionByName(more))


def hard_negatives(vectors: DataFrame, every: int = 100, column: str = "embedding") -> DataFrame:
    """``vectors(vec_id, label, embedding)`` -> ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components count as floor(256 x), scores are integer inner products of vectors of one length, higher first, ties
    to the smaller id. Anchors are the rows whose id is divisible by ``every``; a positive is one of the POSITIVES
    best other rows of the anchor's label; its negatives are the NEGATIVES best rows of other labels that score from
    LOW to HIGH percent of it, so none if it scores below zero. Rows with a null id, label, vector or component, or
    one that isn't finite, take no part; rows that repeat an id count once, with the least label and vector. Scores
    beyond 64 bits count as the nearest long. An empty table gives no rows; other columns are ignored.
    """
    doubles = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull() & ~F.coalesce(F.exists(doubles, bad), F.lit(True)))
    once = valid.groupBy("vec_id").agg(F.min(F.struct("label", F.col(column).alias("v"))).alias("x"))
    good = materialize(once.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x.label").cast("long").alias("label"), "x.v"))
    index = build_index(good)
    anchors = good.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("v").alias("q"))
    window = lambda w, lo, hi: F.struct(w.alias("w"), lo.alias("lo"), hi.alias("hi"))
    all_ = anchors.withColumn("windows", F.array(window(F.lit(0).cast("long"), F.lit(-MOST - 1), F.lit(MOST))))
    positives = materialize(search(all_, index, POSITIVES, True).select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = lambda s, percent: s.cast("decimal(19,0)") * F.lit(percent).cast("decimal(2,0)") / F.lit(100).cast("decimal(3,0)")
    scores = positives.where("positive_score >= 0").select("qid", F.col("positive_score").alias("w")).distinct()
    lo, hi = F.ceil(share(F.col("w"), LOW)).cast("long"), F.floor(share(F.col("w"), HIGH)).cast("long")
    wanted = scores.groupBy("qid").agg(F.sort_array(F.collect_list(window(F.col("w"), lo, hi))).alias("windows"))
    found = search(anchors.join(wanted, "qid"), index, NEGATIVES, False)
    met = positives.join(found.withColumnRenamed("w", "positive_score"), ["qid", "positive_score"])
    return met.select(
        F.col("qid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings, after the labels of every seventh id have moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))
