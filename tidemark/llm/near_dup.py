"""Near duplicates by MinHash with sequential Bayesian verification.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes). Rows with equal
   sets form a class at once (grouped by a 128-bit digest of the set), so thousands of copies
   cost one representative from here on.
2. ``BANDS`` bands of ``ROWS`` MinHash values give bucket keys. Buckets link their members to
   the smallest one (a star: linear, never all pairs); components of that graph are the
   candidate clusters.
3. Cluster members are dealt into blocks of bounded size; each pair of blocks is one task
   group, so no group grows with a cluster. There, signatures are compared batch by batch: a
   pair is dropped as soon as the posterior probability (uniform prior, Beta posterior) that
   its similarity reaches the threshold falls below ``MISS``. Survivors not yet joined in the
   block are confirmed on their full shingle sets, in integers.
4. Confirmed links (a spanning forest a block pair) give the components.

Chance that a pair shares no bucket: (1 - 0.85^7)^40 = 2e-7 exactly at 0.85, 8e-5 at 0.8; it is
usually still found, since whole clusters are compared, not buckets. Spelling of a word: any
run of bytes but ASCII white space, A-Z lower-cased. Null, empty or blank text: empty set,
linked with nothing. Rows with a null id get a null component and are kept. Rows that share
an id count as one document (they get one component). Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HASHER, NOT_SPACE, U64, Words, connected_components, materialise, mix, small, slices, utf8

K = 5
BANDS, ROWS = 40, 7
BATCH = 32  # signature values compared at a time
MISS = 1e-6
BLOCK_ROWS = 1024
BLOCK_BYTES = 16 << 20

_rng = np.random.default_rng(20240817)
XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
MUL = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def shingle_sets(blobs: list[bytes], k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words: the whole sequence."""
    out: list[np.ndarray] = []
    for lo, hi in slices(blobs):
        w = Words(blobs[lo:hi], NOT_SPACE)
        grams, _ = w.ngrams(k)
        for d in range(hi - lo):
            a, b = w.first[d], w.first[d + 1]
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                acc = U64(b - a)
                for h in w.hash[a:b]:
                    acc = mix(np.array([(int(acc) * 0x9E3779B97F4A7C15 + int(h)) % 2**64], U64))[0]
                out.append(np.array([acc], U64))
            else:
                out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (len(sets) x BANDS*ROWS); rows of empty sets are all ones."""
    out = np.full((len(sets), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    step = 1 << 16
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= step):
            size += len(sets[j])
            j += 1
        rows = [r for r in range(i, j) if len(sets[r])]
        if rows:
            flat = (np.concatenate([sets[r] for r in rows]) >> U64(32)).astype(np.uint32)
            at = np.concatenate(([0], np.cumsum([len(sets[r]) for r in rows])))[:-1]
            work = np.empty_like(flat)
            for c in range(BANDS * ROWS):
                np.bitwise_xor(flat, XOR[c], out=work)
                np.multiply(work, MUL[c], out=work)
                out[rows, c] = np.minimum.reduceat(work, at)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), U64)
    for r in range(ROWS):
        keys = keys * U64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(U64)
    return mix(keys + np.arange(BANDS, dtype=U64) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def _features(batches):
    for b in small(batches):
        blobs = utf8(b.column(1))
        sets = shingle_sets(blobs)
        full = [i for i, s in enumerate(sets) if len(s)]
        h1 = np.zeros(len(sets), np.int64)
        h2 = np.zeros(len(sets), np.int64)
        for i in full:
            h1[i] = mix(sets[i]).sum(dtype=U64).view(np.int64)
            h2[i] = np.bitwise_xor.reduce(mix(sets[i] + U64(0x632BE59BD9B4E019))).view(np.int64)
        keys = np.zeros((len(sets), BANDS), np.int64)
        if full:
            keys[full] = band_keys(signatures([sets[i] for i in full]))
        yield pa.RecordBatch.from_arrays([
            b.column(0),
            pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2),
            pa.array([keys[i] if len(s) else [] for i, s in enumerate(sets)], pa.list_(pa.int64())),
        ], names=["doc_id", "n_shingles", "h1", "h2", "bands"])


def _sets(batches):
    """(node, cluster, n_blocks, block, text) -> the shingle set instead of the text."""
    for b in small(batches):
        sets = shingle_sets(utf8(b.column(4)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["node", "cluster", "n_blocks", "block", "shingles"])


@lru_cache(maxsize=None)
def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches of n signature values at which P(similarity >= percent/100) >= miss,
    for a Beta(matches + 1, n - matches + 1) posterior."""
    t = percent / 100
    logs = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(t) + (n + 1 - i) * math.log1p(-t)
            for i in range(n + 2)]
    below = 0.0  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
    for m in range(n + 1):
        below += math.exp(logs[m])
        if below >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, percent: int, miss: float):
    """Index pairs (left row, right row, matches) that no batch's posterior ruled out."""
    li, ri, got = [], [], []
    total = left.shape[1]
    for i in range(len(left)):
        cand = np.arange(len(right))
        hits = np.zeros(len(right), np.int32)
        for at in range(0, total, BATCH):
            hits = hits + (right[cand, at : at + BATCH] == left[i, at : at + BATCH]).sum(axis=1, dtype=np.int32)
            ok = hits >= least_matches(min(at + BATCH, total), percent, miss)
            cand, hits = cand[ok], hits[ok]
            if not len(cand):
                break
        li.append(np.full(len(cand), i))
        ri.append(cand)
        got.append(hits)
    return np.concatenate(li), np.concatenate(ri), np.concatenate(got)


def _verify(percent: int, miss: float):
    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").drop_duplicates(["node", "shingles"])
        node = pdf["node"].to_numpy()
        block = pdf["block"].to_numpy()
        sets = [np.frombuffer(s, U64) for s in pdf["shingles"]]
        sig = signatures(sets)
        one = np.flatnonzero(block == block.min())
        two = np.flatnonzero(block == block.max())
        li, ri, hits = survivors(sig[one], sig[two], percent, miss)
        li, ri = one[li], two[ri]
        keep = li != ri if block.min() != block.max() else li < ri
        li, ri, hits = li[keep], ri[keep], hits[keep]
        order = np.argsort(-hits, kind="stable")
        root = list(range(len(node)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for x, y in zip(li[order].tolist(), ri[order].tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx == ry:
                continue
            small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            if 100 * len(small) < percent * len(large):
                continue
            pos = np.searchsorted(large, small)
            both = int((large[np.minimum(pos, len(large) - 1)] == small).sum())
            if 100 * both >= percent * (len(small) + len(large) - both):
                root[ry] = rx
                links.append((node[x], node[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return verify


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    miss: float = MISS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. Rows are linked at
    100 * intersection >= ``percent`` * union of their shingle sets."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = materialise(base.mapInArrow(
        _features, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "minhash")
    filled = feats.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(filled.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")

    # Bucket stars over representatives.
    reps = classes.join(feats.withColumnRenamed("doc_id", "rep"), ["rep", "n_shingles", "h1", "h2"])
    rows = materialise(reps.select("rep", F.explode("bands").alias("band")), "bands")
    hubs = rows.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    hubs = materialise(hubs.select("band", "hub"), "hubs")
    stars = rows.join(hubs, "band").where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = materialise(connected_components(stars), "clusters")

    # Blocks bounded in rows and in bytes; each unordered pair of a cluster's blocks is a group.
    sized = clusters.join(classes.groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n")), "node")
    blocks = sized.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int").alias("n_blocks"))
    dealt = clusters.join(blocks, "component").select(
        "node", F.col("component").alias("cluster"), "n_blocks",
        F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("long")).cast("int").alias("block"))
    texts = dealt.join(base.withColumnRenamed("doc_id", "node"), "node").select("node", "cluster", "n_blocks", "block", "text")
    shingled = texts.mapInArrow(_sets, "node long, cluster long, n_blocks int, block int, shingles binary")
    paired = shingled.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)"))).select(
        "node", "cluster", "block", "shingles", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    links = paired.groupBy("cluster", "b1", "b2").applyInPandas(_verify(percent, miss), "a long, b long")

    # Rows sharing an id are one document: join their classes too.
    ids = filled.join(classes, ["n_shingles", "h1", "h2"]).select("doc_id", "rep")
    same = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    twice = filled.join(same.select("doc_id", F.col("a").alias("low")), "doc_id").join(
        classes, ["n_shingles", "h1", "h2"]).select(F.col("low").alias("a"), F.col("rep").alias("b"))
    comps = materialise(connected_components(links.unionByName(twice)), "components")

    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "h1", "h2").join(named, ["n_shingles", "h1", "h2"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.cast("long").alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
