"""Shared helpers: scratch tables, word hashing on byte buffers, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

U64 = np.uint64
# Text handled at a time inside an Arrow batch: bounds the numpy working set (about 60 bytes
# of arrays per byte of text), whatever the batch size is.
SLICE_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir`` (URI kept as given)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, a lost executor
    costs nothing, and the planner knows the table's true size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, listed afresh."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(batches, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows: bounds the Python copies of a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(blobs: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) row ranges of about ``limit`` bytes; at least one row each."""
    i, n = 0, len(blobs)
    while i < n:
        j, size = i + 1, len(blobs[i])
        while j < n and size + len(blobs[j]) <= limit:
            size += len(blobs[j])
            j += 1
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply); bijective."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class ByteHasher:
    """Polynomial hashes (mod 2^64) of any byte range of a buffer in O(1) each.

    Every byte goes through a random 64-bit table, so the odd multiplier's known weak
    inputs do not apply. ``ranges`` is invariant to where in the buffer the bytes lie."""

    def __init__(self, seed: int = 0x5EED):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.m = int(rng.integers(1, 2**62, dtype=np.int64)) * 4 + 1
        self.im = pow(self.m, -1, 1 << 64)
        self._pow = np.ones(1, U64)
        self._inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self._pow) <= n:
            size = max(n + 1, 2 * len(self._pow))
            for name, base in (("_pow", self.m), ("_inv", self.im)):
                a = np.full(size, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf))
        out = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.byte[buf] * self._pow[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._inv[start] + (end - start).astype(U64))


HASHER = ByteHasher()


def byte_class(allowed) -> np.ndarray:
    return np.array([bool(allowed(b)) for b in range(256)])


# A-Z to a-z; every other byte (UTF-8 continuation bytes included) stays.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
# Words of the near-duplicate contract: anything but ASCII white space.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
# Words of the decontamination contract: digits, ASCII letters and all non-ASCII characters.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


class Words:
    """Word boundaries and 64-bit word hashes of several documents, lower-cased (A-Z).

    ``doc`` is each word's document, ``first`` the first word index of each document (with
    an end sentinel), ``start``/``end`` byte ranges in ``buf`` (documents joined by one
    space; ``base`` is each document's first byte)."""

    def __init__(self, blobs: list[bytes], word_byte: np.ndarray, hashes: bool = True, lower: bool = True):
        raw = np.frombuffer(b" ".join(blobs), np.uint8)
        self.raw = raw
        self.buf = LOWER[raw] if lower else raw
        lens = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
        self.base = np.concatenate(([0], np.cumsum(lens + 1)))[:-1] if len(blobs) else np.zeros(0, np.int64)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = word_byte[raw]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.concatenate((np.searchsorted(self.start, self.base), [len(self.start)]))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(blobs)), self.count)
        if hashes:
            self.hash = HASHER.ranges(HASHER.prefix(self.buf), self.start, self.end)

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k words from each word on; valid where one document holds all."""
        n = len(self.start)
        if n < k:
            return np.zeros(n, U64), np.zeros(n, bool)
        acc = np.zeros(n - k + 1, U64)
        for i in range(k):
            acc = acc * U64(0x9E3779B97F4A7C15) + self.hash[i : n - k + 1 + i]
        out, valid = np.zeros(n, U64), np.zeros(n, bool)
        out[: n - k + 1] = mix(acc)
        valid[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return out, valid



def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph given as long columns ``a``, ``b``; component
    is the smallest node reachable. Alternating large-star/small-star steps: O(log n) rounds,
    each grouped minima (combined map-side) and joins, written to the shared folder. Self links are
    ignored; nothing is collected."""
    cur = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialise(cur, "cc-edges")
    for _ in range(max_rounds):
        # Done when all edges point at roots: no node has two edges up, or edges both ways.
        ends = cur.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            cur.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if open_ends.isEmpty():
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        cur = materialise(step, "cc-edges")
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
