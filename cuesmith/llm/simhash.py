"""Near-duplicate documents by SimHash fingerprints and BK-trees over shards of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, row_hash, small_batches, table
from .components import connected_components

RADIUS = 3
#: A shard of more fingerprints than this is split once more by a second block that must agree.
SHARD_LIMIT = 1000

#: Documents of like text: words in a shingle, bits of a fingerprint, and the bits in which two may differ. A Jaccard
#: similarity of 0.8 is an angle of 0.48, so 155 of 1024 bits differ on average, with a deviation of 11.5; at 0.7 it is
#: 196 and 12.6, at 0.5 274 and 14, and 512 for unrelated texts. Fewer bits tell 0.8 and 0.5 apart too badly for texts
#: with a long passage in common.
LIKE_WORDS, LIKE_BITS, LIKE_RADIUS = 5, 1024, 178
#: Shards of like texts: each of BANDS groups of BAND_MINIMA least hashes names one. Two texts of similarity 0.8 agree in
#: at least one group with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997.
BANDS, BAND_MINIMA = 8, 3
#: Rows of a block of a shard; groups of at most SMALL_TREE rows are a BK-tree of many levels, larger ones of one level.
LIKE_SHARD, SMALL_TREE = 2048, 48


def shingle_digests(text: str | None, size: int) -> bytes:
    """The XXH64 (seed 42) of each shingle, repeats included, end to end; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the six ASCII spaces only
    if len(words) < size:
        return xxhash.xxh64_digest(b" ".join(words), 42) if words else b""
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return b"".join([xxhash.xxh64_digest(s, 42) for s in shingles])


def fingerprint_bytes(text: str | None, size: int = 3) -> bytes:
    """The 64-bit SimHash of one text, most significant bit first."""
    digests = shingle_digests(text, size)
    n, counts = len(digests) // 8, np.zeros(64, np.int64)
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for i in range(0, n, 65536):
        counts += np.unpackbits(rows[i : i + 65536], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n).tobytes()


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([int.from_bytes(fingerprint_bytes(t), "big", signed=True) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, fp)``: fp is the fingerprint as a signed long, row tells rows of one id apart."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", row_hash(docs).alias("row"), _fingerprints("text").alias("fp"))


class BkTree:
    """A BK-tree of (fingerprint, node) with the components of what is within the radius.

    Children hang on the integer Hamming distance to their parent; a search follows only edges within the
    radius of its own distance. All that hangs on an edge of at most the radius is linked with the parent
    itself, so such an edge is left out once the query is in the parent's component: no link is lost.
    """

    def __init__(self, radius: int) -> None:
        self.radius, self.fps, self.children, self.up = radius, [], [], []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, fp: int) -> None:
        """Insert, and join the components of all within the radius."""
        me, r, fps, children, up = len(self.fps), self.radius, self.fps, self.children, self.up
        fps.append(fp)
        up.append(me)
        children.append({})
        if not me:
            return
        at = 0
        while True:  # its place
            d = (fps[at] ^ fp).bit_count()
            below = children[at].get(d)
            if below is None:
                break
            at = below
        place, stack = (at, d), [0]
        while stack:
            x = stack.pop()
            d = (fps[x] ^ fp).bit_count()
            if d <= r:
                a, b = self.find(me), self.find(x)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if not children[x]:
                continue
            same = self.find(me) == self.find(x)
            for edge, child in children[x].items():
                if d - r <= edge <= d + r and not (same and edge <= r):
                    stack.append(child)
        children[place[0]][place[1]] = me


def _shard_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard -> one link from each fingerprint to the first of its component in the shard."""
    key, fps, nodes = None, [], []

    def done() -> pd.DataFrame | None:
        if len(fps) < 2:
            return None
        tree = BkTree(RADIUS)
        for x in fps:
            tree.add(x)
        top = [tree.find(i) for i in range(len(fps))]
        found = [(nodes[i], nodes[t]) for i, t in enumerate(top) if i != t]
        return pd.DataFrame(found, columns=["a", "b"]) if found else None

    for part in parts:
        keys = part["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
        fp = part["fp"].to_numpy().view(np.uint64).tolist()
        node = part["node"].tolist()
        out = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if keys[i] != key:
                out.append(done())
                key, fps, nodes = keys[i], [], []
            fps += fp[i:j]
            nodes += node[i:j]
        out = [x for x in out if x is not None]
        if out:
            yield pd.concat(out)
    if (last := done()) is not None:
        yield last


def links(distinct: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """``distinct(fp, node)`` -> ``(a, b)`` of nodes whose fingerprints differ in 3 bits or fewer, as a forest of each shard.

    Of four 16-bit blocks, two such fingerprints agree in one at least: each block's value names a shard. The
    fingerprints of a shard above the limit agree in one of four 12-bit blocks of the other 48 bits, and are
    dealt out by that one too. A tree is built in the task that owns its shard; trees are not broadcast, as
    they grow with the corpus.
    """
    cuts = [(F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    rest = [  # the 48 bits without block i
        F.shiftrightunsigned("fp", 0).bitwiseAND(F.lit((1 << 48) - 1)),
        F.shiftleft(cuts[0], 32).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))),
        F.shiftleft(cuts[0], 32).bitwiseOR(F.shiftleft(cuts[1], 16)).bitwiseOR(cuts[3]),
        F.shiftrightunsigned("fp", 16),
    ]
    dealt = distinct.select(
        "fp",
        "node",
        F.explode(
            F.array(*[F.struct((cuts[i] + F.lit(i << 16)).cast("long").alias("key"), rest[i].alias("rest")) for i in range(4)])
        ).alias("s"),
    ).select("fp", "node", "s.key", "s.rest")
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit).select("key", F.lit(True).alias("large"))
    again = F.array(
        *[
            F.shiftleft("key", 16)
            .bitwiseOR(F.lit((j + 1) << 12))
            .bitwiseOR(F.shiftrightunsigned("rest", 36 - 12 * j).bitwiseAND(F.lit(0xFFF)))
            for j in range(4)
        ]
    )
    shards = dealt.join(large, "key", "left").select(
        "fp", "node", F.explode(F.when(F.col("large"), again).otherwise(F.array(F.shiftleft("key", 16)))).alias("shard")
    )
    return (
        shards.repartition("shard").sortWithinPartitions("shard", "node").mapInPandas(_shard_links, "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, row, fp, part, component_id``.

    Documents link when their fingerprints differ in 3 bits or fewer; component_id is the smallest doc_id
    that a document reaches over links, its own included, and part the smallest fingerprint. Fingerprints are
    what is linked, so unrelated texts stay apart where they have one doc_id or none. Null and empty texts have fingerprint zero and link
    like others. Copies meet by their fingerprint before any pairing, so a large group of copies is one row.
    A row without a doc_id gets its component's id, null if that holds no id. An empty table gives no rows;
    extra columns are ignored.
    """
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    parts = connected_components(links(distinct.select("fp", "node"), shard_limit))
    of = distinct.join(parts, "node", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    ids = of.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "part").drop("least"), "fp").select("doc_id", "row", "fp", "part", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit hashes in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seeds(first: int, n: int) -> np.ndarray:
    return _mixed(np.arange(first, first + n, dtype=np.uint64))[:, None]


def like_sketch(text: str | None) -> tuple[bytes, list[int]]:
    """The wide SimHash over a text's distinct five-word shingles, and the keys of its shards.

    A text of one to four words is one shingle; one without words has fingerprint zero. Each shingle's hash
    is mixed with LIKE_BITS / 64 seeds for the bits, and with BANDS * BAND_MINIMA others for the least hashes.
    """
    digests = shingle_digests(text, LIKE_WORDS)
    hashes = np.unique(np.frombuffer(digests or bytes(8), ">u8").astype(np.uint64))
    counts, least = np.zeros(LIKE_BITS, np.int64), np.full(BANDS * BAND_MINIMA, np.uint64(2**64 - 1))
    lanes, orders = _seeds(1, LIKE_BITS // 64), _seeds(1 << 20, BANDS * BAND_MINIMA)
    for i in range(0, len(hashes), 4096):
        h = hashes[None, i : i + 4096]
        bits = np.unpackbits(np.ascontiguousarray(_mixed(h ^ lanes).T.astype("<u8")).view(np.uint8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
        least = np.minimum(least, ((h ^ orders) * (orders | np.uint64(1))).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for some in least.reshape(BANDS, BAND_MINIMA).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + some)
    fp = np.packbits(2 * counts > len(hashes)).tobytes() if digests else bytes(LIKE_BITS // 8)
    return fp, keys.view(np.int64).tolist()


@F.pandas_udf(T.StructType().add("fp", T.BinaryType()).add("keys", T.ArrayType(T.LongType())))
def _like_sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([like_sketch(t) for t in texts], columns=["fp", "keys"])


def wide_forest(fps: np.ndarray, sides: np.ndarray, radius: int = LIKE_RADIUS) -> list[tuple[int, int]]:
    """Links that join all rows within the radius of each other, of rows of words of 64 bits; where there are two sides, across.

    The tree is one level of a BK-tree: all rows hang on the first by their integer distance to it, in order, and a
    search follows the edges within the radius of its own distance; what is below them is compared in one step. Rows of
    the component that a row is in already are passed by.
    """
    far = np.bitwise_count(fps ^ fps[0]).sum(axis=1, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    fps, far, side = fps[order], far[order], sides[order]
    last = np.searchsorted(far, far + radius, "right")
    part, across, found = np.arange(len(fps)), bool((sides != sides[0]).any()), []
    for i in range(len(fps)):
        other = part[i + 1 : last[i]] != part[i]
        if across:
            other &= side[i + 1 : last[i]] != side[i]
        at = i + 1 + np.flatnonzero(other)
        for j in at[np.bitwise_count(fps[at] ^ fps[i]).sum(axis=1, dtype=np.int64) <= radius]:
            if part[j] != part[i]:
                found.append((int(order[i]), int(order[j])))
                part[part == part[j]] = part[i]
    return found


def _like_shard_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, p, q) -> a forest of links of each such group."""
    key, fps, sides = None, [], []

    def done() -> pd.DataFrame | None:
        if len(fps) < 2:
            return None
        if len(fps) <= SMALL_TREE and len(set(sides)) == 1:
            tree = BkTree(LIKE_RADIUS)
            for x in fps:
                tree.add(int.from_bytes(x, "big"))
            found = [(i, t) for i in range(len(fps)) if (t := tree.find(i)) != i]
        else:
            found = wide_forest(np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1), np.array(sides))
        return pd.DataFrame([(fps[i], fps[j]) for i, j in found], columns=["a", "b"]) if found else None

    for part in parts:
        out = []
        for at, fp, side in zip(zip(part["key"], part["p"], part["q"], strict=True), part["fp"], part["side"], strict=True):
            if at != key:
                out.append(done())
                key, fps, sides = at, [], []
            fps.append(bytes(fp))
            sides.append(side)
        out = [x for x in out if x is not None]
        if out:
            yield pd.concat(out)
    if (last := done()) is not None:
        yield last


def like_links(distinct: DataFrame, shard_limit: int = LIKE_SHARD) -> DataFrame:
    """``distinct(fp, keys)`` -> ``(a, b)`` of fingerprints within LIKE_RADIUS that share a key, as a forest of each shard.

    What links doesn't depend on how many texts share a key. A shard above the limit (a passage that very many texts
    share fills one) is cut into blocks of about that size by a hash; each pair of blocks, and each block with itself,
    is a group of its own, so a task holds two blocks at most and a shard of n rows is sent n / limit times.
    """
    dealt = distinct.select("fp", F.explode(F.array_distinct("keys")).alias("key"))
    counts = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = counts.select("key", F.ceil(F.col("n") / shard_limit).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(F.col("mine"), x).alias("p"), F.greatest(F.col("mine"), x).alias("q"), (F.col("mine") > x).cast("int").alias("side")),
    )
    shards = dealt.join(blocks, "key").withColumn("mine", mine).select("fp", "key", F.explode(pairs).alias("g")).select("fp", "key", "g.p", "g.q", "g.side")
    return (
        shards.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp").mapInPandas(_like_shard_links, "a binary, b binary").distinct()
    )


def like_documents(docs: DataFrame, shard_limit: int = LIKE_SHARD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, row, fp, part``; rows of one part are near copies.

    Near copies have a Jaccard similarity of about 0.8 or more on distinct five-word shingles (lower-cased A-Z),
    told by wide fingerprints that differ in LIKE_RADIUS bits or fewer; part is the smallest fingerprint that links reach.
    Null and empty texts are copies of each other, texts of up to four words only of equal ones. Copies meet by their fingerprint
    before any pairing. An empty table gives no rows; extra columns are ignored, ids play no role.
    """
    small_batches(docs.sparkSession)
    made = docs.select("doc_id", row_hash(docs).alias("row"), _like_sketches("text").alias("s"))
    prints = materialize(made.select("doc_id", "row", "s.fp", "s.keys"))
    parts = connected_components(like_links(materialize(prints.select("fp", "keys").distinct()), shard_limit))
    of = parts.select(F.col("node").alias("fp"), "component")
    return prints.join(of, "fp", "left").select("doc_id", "row", "fp", F.coalesce("component", "fp").alias("part"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of each component of fingerprints within 3 bits; see ``keep_first``."""
    return keep_first(docs, near_duplicates(docs))


def drop_like_documents(docs: DataFrame) -> DataFrame:
    """Keep one row of each group of near copies; see ``like_documents`` and ``keep_first``."""
    return keep_first(docs, like_documents(docs))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Keep the row with the smallest doc_id (then row hash) of each part, with the columns of ``docs``.

    A part is a group of linked fingerprints, whatever their ids. Rows without a doc_id are kept only if
    nothing with an id is in their group. Repeated rows count as copies.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = found.groupBy("part").agg(first.alias("f")).select(
        F.coalesce("f.doc_id", F.lit(-(2**63))).alias("__id"), F.col("f.row").alias("__row")
    )
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-(2**63))), "__row": row_hash(docs)})
    return keyed.join(stay, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]).select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
