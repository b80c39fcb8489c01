"""Byte-level BPE over documents: encoding in padded numpy matrices, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: A longer piece is merged with a heap: a matrix row of that length would cost its square.
LONG_PIECE = 512
#: Most cells of a padded matrix at once; most pieces that a worker remembers, and most characters of one.
CELLS, CACHE_PIECES, CACHE_CHARS = 1 << 21, 600_000, 64
#: A batch of documents is encoded in parts of about so many characters.
PART_CHARS = 200_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> merged id, in an open-addressed numpy hash table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        self.probes, rest = 0, np.arange(len(left))
        keys = self.key(left, right)
        slots = self.slot(keys)
        while len(rest):
            at = (slots[rest] + np.uint64(self.probes)) & np.uint64((1 << self.bits) - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            take, first = np.unique(at[free], return_index=True)
            won = rest[free][first]
            self.keys[take], self.values[take] = keys[won], merged[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            self.probes += 1

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * _MIX) >> np.uint64(64 - self.bits)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair doesn't merge. Ids below 0 stand for padding and merge with nothing."""
        keys = self.key(left, right)
        slots, out = self.slot(keys), np.full(len(keys), NONE)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        for probe in range(self.probes):
            at = (slots[rest] + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (found != np.uint64(2**64 - 1))]
            if not len(rest):
                break
        return out


class ByteBpe:
    """The vocabulary of a file of ranks; a token's id is its rank."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[t[:k]], self.ranks[t[k:]], i)
            for t, i in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        self.pairs = PairTable(*np.array(pairs, np.int32).T)
        self.cache: dict[str, bytes] = {}

    def _long(self, piece: bytes) -> np.ndarray:
        """One piece by a heap of (rank, place): the same merges in the same order as the matrices, for any length."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, tokens = len(ids), self.ranks, self.tokens
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(tokens[ids[i]] + tokens[ids[j]]) if j < n else None

        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(first[i]), i) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := rank(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _bucket(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of up to ``width`` bytes: each round, every row merges its leftmost pair of least rank and closes up."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        where = np.arange(width) < lengths[:, None]
        ids[where] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[bytes] = [b""] * n
        rows, cols = np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k, : lengths[k]].tobytes()
                rows, ids, ranks, lengths, at, best = (x[~done] for x in (rows, ids, ranks, lengths, at, best))
                if not len(rows):
                    break
                used = int(lengths.max())
                ids, ranks, cols = ids[:, :used], ranks[:, :used], np.arange(used)
            each = np.arange(len(rows))
            from_ = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)
            ids, ranks = np.take_along_axis(ids, from_, 1), np.take_along_axis(ranks, from_, 1)
            lengths = lengths - 1
            ids[cols >= lengths[:, None]] = -1
            ranks[cols >= lengths[:, None] - 1] = NONE
            ids[each, at] = best
            for left in (at, at - 1):
                ok = np.flatnonzero((left >= 0) & (left + 1 < lengths))
                ranks[ok, left[ok]] = self.pairs.find(ids[ok, left[ok]], ids[ok, left[ok] + 1])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that aren't remembered, in buckets of like length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if (i := self.ranks.get(b)) is not None:
                self.cache[p] = np.int32(i).tobytes()
            elif len(b) > LONG_PIECE:
                self.cache[p] = self._long(b).tobytes()
            else:
                w = 4 if len(b) <= 4 else -(-len(b) // 4) * 4 if len(b) <= 32 else 1 << (len(b) - 1).bit_length()
                buckets.setdefault(w, []).append((p, b))
        for width, found in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                self.cache.update(zip((p for p, _ in part), self._bucket([b for _, b in part], width), strict=True))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        part: list[list[str]] = []
        chars = 0

        def flush() -> Iterator[np.ndarray]:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            cache = self.cache
            new = set().union(*part).difference(cache)
            if new:
                self.learn(new)
            get = cache.__getitem__
            for pieces in part:
                yield np.frombuffer(b"".join(map(get, pieces)), np.int32)
            for piece in new:  # long pieces seldom come again, and would fill the worker
                if len(piece) > CACHE_CHARS:
                    del cache[piece]

        for text in texts:
            text = text or ""
            part.append(self.split(text))
            chars += len(text)
            if chars >= PART_CHARS:
                yield from flush()
                part, chars = [], 0
        yield from flush()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, ids array<int>, decoded binary``, one row per row.

    Null and empty texts have no ids and decode to no bytes. Each task keeps the ids of pieces it has seen, so
    a piece is merged about once a task however often it occurs; documents are never moved. Extra columns are
    ignored; repeated rows are repeated.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, max(1, len(texts)), 64):
                some = list(bpe.encode(texts[i : i + 64])) if len(texts) else []
                offsets = np.zeros(len(some) + 1, np.int32)
                np.cumsum([len(x) for x in some], out=offsets[1:])
                ids = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *some]), pa.int32())
                )
                decoded = pa.array([bpe.decode(x) for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(some)), ids, decoded], ["doc_id", "ids", "decoded"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the many-language vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and of what they decode to."""
    return digests(encode_decode(table(spark, sf_dir, "documents"), *vocabulary()))
