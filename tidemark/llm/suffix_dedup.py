"""Exact removal of repeated byte strings by a sparse, distributed suffix array.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. To
sort no more suffixes than needed, each such string is stood for by its anchor: the position
inside it whose ``CONTEXT`` bytes hash lowest (leftmost of equals). The anchor depends on the
string alone, so equal strings have their anchors at equal places, and about one position in
75 is an anchor. Anchors whose context occurs once in the corpus cannot belong to a repeated
string; they are dropped by a grouped count and a join on 64-bit hashes.

The suffixes that start at the remaining anchors are sorted by a merge sort that never
compares a known prefix twice: each map task sorts its own suffixes, cuts the run at sampled
splitters and sends it front-coded (length shared with the one before, then the rest); each
range decodes its runs through a loser tree whose players carry the length they share with
the last winner, so only unequal or unknown bytes are looked at. The merged order comes with
its common-prefix lengths; a string that starts d bytes before its anchor is repeated where
two suffixes share LENGTH - d bytes and the d bytes to their left agree.

Equal suffixes with equal left sides are one item a run. A context that occurs more than
``HOT`` times would load one range: its strings are counted by hash instead, one row a string,
so no group grows with the data. Documents are keyed by a 128-bit digest of their bytes.

Null text is empty. Rows of equal text (repeated ids too) each get their row; texts shorter
than LENGTH lose nothing. Strings never run over the end of a document.
"""

from __future__ import annotations

import bisect
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HASHER, U64, materialise, mix, small, slices, utf8

LENGTH = 200
CONTEXT = 48
HOT = 50_000
RANGE_ITEMS = 40_000  # suffixes aimed at in a range
SPLIT_SAMPLE = 20_000
RUN_BYTES = 8 << 20  # bytes of suffixes a task sorts into one run


def digest(blob: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(blob, digest_size=16).digest())


def _window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive keys (block prefix and suffix minima)."""
    n = len(keys)
    pad = -n % w
    blocks = np.concatenate((keys, np.full(pad, np.iinfo(np.uint64).max, U64))).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(blobs: list[bytes], length: int = LENGTH, context: int = CONTEXT):
    """(document, anchor, first start, last start, context hash) arrays: the anchors of all
    strings of ``length`` bytes, with the range of starts each stands for."""
    out = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0, np.int64)]]
    for lo, hi in slices(blobs):
        part = blobs[lo:hi]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        buf = np.frombuffer(b"".join(part), np.uint8)
        if len(buf) < length:
            continue
        prefix = HASHER.prefix(buf)
        at = np.arange(len(buf) - context + 1)
        own = HASHER.ranges(prefix, at, at + context)
        key = (own & U64(0xFFFFFFFF00000000)) | at.astype(U64)
        least = (_window_min(key, length - context + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        ends = np.cumsum(lens)
        base = ends - lens
        doc = np.repeat(np.arange(len(part)), lens)[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + length <= ends[doc])
        if not len(start):
            continue
        p, d = least[start], doc[start]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(p)])) - 1
        for c, v in zip(out, (d[first] + lo, p[first] - base[d[first]], start[first] - base[d[first]], start[last] - base[d[first]],
                              own[p[first]].view(np.int64)), strict=True):
            c.append(v)
    return [np.concatenate(c) for c in out]


def _lists(doc: np.ndarray, n: int, values: np.ndarray, kind) -> pa.Array:
    ptr = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind))


def _scan(length: int, context: int):
    """(doc_id, text) to digests and anchors."""
    def run(batches):
        for b in small(batches):
            blobs = utf8(b.column(1))
            doc, p, _, _, fp = anchors(blobs, length, context)
            keys = [digest(x) for x in blobs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([len(x) for x in blobs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string()),
                 _lists(doc, len(blobs), p, pa.int32()), _lists(doc, len(blobs), fp, pa.int64())],
                names=["doc_id", "d1", "d2", "n_bytes", "sha256", "p", "fp"])

    return run


def _keyed(batches):
    for b in small(batches):
        blobs = utf8(b.column(0))
        keys = [digest(x) for x in blobs]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                          pa.array(blobs, pa.binary())], names=["d1", "d2", "blob"])


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    at = known
    while at < n:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            size = min(len(x), len(y))
            diff = int.from_bytes(x[:size], "big") ^ int.from_bytes(y[:size], "big")
            return at + size - (diff.bit_length() + 7) // 8 if diff else at + size
        at += 32
    return n


def front_code(items: list[tuple]) -> bytes:
    """Sorted (suffix, left, lo, hi, copies, number) items, each as what it does not share."""
    out, prev = [], b""
    for suffix, left, lo, hi, copies, number in items:
        shared = common_prefix(prev, suffix, 0)
        out.append(struct.pack("<HHHHHHI", shared, len(suffix) - shared, len(left), lo, hi, min(copies, 2), number))
        out.append(suffix[shared:])
        out.append(left)
        prev = suffix
    return b"".join(out)


def read_run(blob: bytes):
    """(suffix, length shared with the one before, left, lo, hi, copies, number) in order."""
    at, prev = 0, b""
    head = struct.Struct("<HHHHHHI")
    while at < len(blob):
        shared, rest, left, lo, hi, copies, number = head.unpack_from(blob, at)
        at += head.size
        prev = prev[:shared] + blob[at : at + rest]
        at += rest
        yield prev, shared, blob[at : at + left], lo, hi, copies, number
        at += left


def merge(runs: list):
    """Loser tree over sorted runs (iterators like ``read_run``): yields (length shared with
    the suffix before, run index, item). A player carries the length it shares with the last
    winner: of two, the one that shares more is smaller; only at equal lengths are bytes
    compared, from that length on, and the loser learns what it shares with the winner."""
    k = 1
    while k < len(runs):
        k *= 2
    head = [next(r, None) for r in runs] + [None] * (k - len(runs))
    iters = list(runs) + [iter(())] * (k - len(runs))
    share = [0] * k  # with the last winner (at first: with the empty string)
    tree = [0] * k  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = common_prefix(x[0], y[0], share[a])
        if n == len(x[0]) or (n < len(y[0]) and x[0][n] < y[0][n]):
            share[b] = n
            return a, b
        share[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, lose = play(build(2 * node), build(2 * node + 1))
        tree[node] = lose
        return win

    win = build(1) if k > 1 else 0
    while head[win] is not None:
        yield share[win], win, head[win]
        head[win] = next(iters[win], None)
        share[win] = head[win][1] if head[win] is not None else 0
        node = (win + k) // 2
        while node:
            winner, tree[node] = play(win, tree[node])
            win = winner
            node //= 2


def repeated(shared: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """(item, d) matrix: the string that starts d bytes before the item's anchor is repeated.
    shared: common-prefix lengths in sorted order; left: bytes before the anchors, nearest
    first; lo/hi: the least and largest d an item stands for."""
    out = np.zeros((len(shared), left.shape[1] + 1), bool)
    back = np.zeros(len(shared), U64)
    for d in range(left.shape[1] + 1):
        if d:
            back = back * U64(0x9E3779B97F4A7C15) + HASHER.byte[left[:, d - 1]]
        own = np.flatnonzero((lo <= d) & (d <= hi))
        if not len(own):
            continue
        group = np.cumsum(shared < length - d)[own].astype(U64)
        key = mix(mix(back[own] + U64(d)) + group * U64(0xD6E8FEB86659FD93))
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        out[own, d] = (n[at] > 1) | (copies[own] > 1)
    return out


def _runs(length: int, context: int, splitters: list[bytes]):
    """(d1, d2, blob, positions, hot positions) to front-coded runs (kind 0), the places of
    each run's items (kind 1) and the hashes of hot contexts' strings (kind 2)."""
    kinds = [("kind", pa.int8()), ("dest", pa.int64()), ("run", pa.int64()), ("item", pa.int64()), ("data", pa.binary()),
             ("d1", pa.int64()), ("d2", pa.int64()), ("p", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]

    def rows(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in kinds], names=[c for c, _ in kinds])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple, list] = {}
        places: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, places, size, number
            if held:
                order = sorted(held, key=lambda k: k[0])
                by_dest: dict[int, list] = {}
                for k in order:
                    by_dest.setdefault(bisect.bisect_right(splitters, k[0][:context]), []).append((*k, held[k][1], held[k][0]))
                yield rows(kind=[0] * len(by_dest), dest=list(by_dest), run=[number] * len(by_dest), data=[front_code(v) for v in by_dest.values()])
                item, d1, d2, p = zip(*places, strict=True)
                yield rows(kind=[1] * len(item), run=[number] * len(item), item=item, d1=d1, d2=d2, p=p)
            held, places, size, number = {}, [], 0, number + 1

        for b in small(batches):
            d1s, d2s, blobs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            wanted, hots = b.column(3).to_pylist(), b.column(4).to_pylist()
            doc, p, first, last, _ = anchors(blobs, length, context)
            wanted, hots = [set(x) for x in wanted], [set(x) for x in hots]
            for i, at, s0, s1 in zip(doc.tolist(), p.tolist(), first.tolist(), last.tolist(), strict=True):
                if at not in wanted[i]:
                    continue
                blob = blobs[i]
                if at in hots[i]:
                    buf = np.frombuffer(blob, np.uint8)[s0 : s1 + length]
                    begin = np.arange(s1 - s0 + 1)
                    one = HASHER.ranges(HASHER.prefix(buf), begin, begin + length)
                    two = mix(HASHER.ranges(HASHER.prefix(buf ^ 0x5A), begin, begin + length))
                    yield rows(kind=[2] * len(begin), d1=[d1s[i]] * len(begin), d2=[d2s[i]] * len(begin), p=begin + s0,
                               h1=one.view(np.int64), h2=two.view(np.int64))
                    continue
                key = (blob[at : s1 + length], blob[s0:at], at - s1, at - s0)
                entry = held.setdefault(key, [len(held), 0])
                entry[1] += 1
                places.append((entry[0], d1s[i], d2s[i], at))
                size += len(key[0]) + len(key[1])
            if size > RUN_BYTES:
                yield from flush()
        yield from flush()

    return run


RUN_ROWS = "kind tinyint, dest long, run long, item long, data binary, d1 long, d2 long, p long, h1 long, h2 long"


def _merge_range(length: int, context: int):
    """All runs of a range to (run, item, from, to): repeated stretches relative to the anchor."""
    def merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        names = pdf["run"].to_numpy()
        shared, run, item, lo, hi, copies, lefts = [], [], [], [], [], [], []
        for n, r, (_, _, left, a, b, c, number) in merge([read_run(bytes(x)) for x in pdf["data"]]):
            shared.append(n)
            run.append(r)
            item.append(number)
            lo.append(a)
            hi.append(b)
            copies.append(c)
            lefts.append(left[::-1])
        width = length - context
        left = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in lefts), np.uint8).reshape(len(lefts), width)
        hit = repeated(np.array(shared), left, np.array(lo), np.array(hi), np.array(copies), length)
        step = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, near = np.nonzero(step == 1)  # runs of d: from near to far - 1
        _, far = np.nonzero(step == -1)
        return pd.DataFrame({"run": names[np.array(run, np.int64)[i]], "item": np.array(item, np.int64)[i], "start": 1 - far, "end": length - near}).astype("int64")

    return merge_range


def _cut(batches):
    """(d1, d2, blob, ranges) to the sizes and the hash of what is left."""
    for b in small(batches):
        rows = []
        for d1, d2, blob, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kept, at, gone, spans = hashlib.sha256(), 0, 0, 0
            end = None
            for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
                if end is None or r["start"] > end:
                    if end is not None:
                        at = end
                    spans += 1
                    kept.update(blob[at : r["start"]])
                    gone -= r["start"]
                    end = r["end"]
                    gone += end
                elif r["end"] > end:
                    gone += r["end"] - end
                    end = r["end"]
            kept.update(blob[end or 0 :])
            rows.append((d1, d2, gone, spans, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["d1", "d2", "n_removed", "n_spans", "cut_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, context: int = CONTEXT,
                   hot: int = HOT, range_items: int = RANGE_ITEMS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    key = ["d1", "d2"]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialise(base.mapInArrow(_scan(length, context), "doc_id long, d1 long, d2 long, n_bytes long, sha256 string, p array<int>, fp array<long>"), "anchors")

    # Anchors whose context occurs more than once in the corpus.
    seen = scanned.select("d1", "d2", F.explode(F.arrays_zip("p", "fp")).alias("a")).select("d1", "d2", "a.p", "a.fp")
    many = seen.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1")
    wanted = seen.join(many, "fp").select("d1", "d2", "p", (F.col("n") > hot).alias("hot")).distinct()
    wanted = wanted.groupBy(*key).agg(F.collect_list("p").alias("p"), F.collect_list(F.when(F.col("hot"), F.col("p"))).alias("hot"))
    wanted = materialise(wanted, "wanted")
    n_items = wanted.agg(F.coalesce(F.sum(F.size("p")), F.lit(0))).first()[0]

    # Texts with such anchors, one row a text and row of the input (copies are counted).
    keyed = base.where(F.octet_length("text") >= length).select("text").mapInArrow(_keyed, "d1 long, d2 long, blob binary")
    texts = materialise(keyed.join(wanted, key).select("d1", "d2", "blob", "p", "hot"), "texts")
    splitters = _splitters(texts, n_items, range_items, context)
    coded = materialise(texts.mapInArrow(_runs(length, context, splitters), RUN_ROWS), "runs")

    merged = coded.where("kind = 0").select("dest", "run", "data").groupBy("dest").applyInPandas(
        _merge_range(length, context), "run long, item long, start long, end long")
    places = coded.where("kind = 1").select("run", "item", "d1", "d2", "p")
    found = places.join(merged, ["run", "item"]).select("d1", "d2", (F.col("p") + F.col("start")).alias("start"), (F.col("p") + F.col("end")).alias("end"))
    strings = coded.where("kind = 2").select("d1", "d2", "p", "h1", "h2")
    twice = strings.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    found = found.unionByName(strings.join(twice, ["h1", "h2"]).select("d1", "d2", F.col("p").alias("start"), (F.col("p") + length).alias("end")))
    ranges = found.distinct().groupBy(*key).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    one = texts.dropDuplicates(key).select("d1", "d2", "blob")
    cut = one.join(ranges, key).select("d1", "d2", "blob", "ranges").mapInArrow(_cut, "d1 long, d2 long, n_removed long, n_spans long, cut_sha256 string")
    out = scanned.select("doc_id", "d1", "d2", "n_bytes", "sha256").join(cut, key, "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))


def _splitters(texts: DataFrame, n_items: int, range_items: int, context: int) -> list[bytes]:
    """Contexts that cut the suffixes into ranges of about ``range_items``, from a bounded sample
    (one anchor of each of the SPLIT_SAMPLE texts of smallest keyed hash)."""
    n = -(-n_items // range_items)
    if n < 2:
        return []
    starts = texts.select("d1", "d2", F.expr(f"substring(blob, element_at(p, 1) + 1, {context})").alias("c"))
    sample = sorted(bytes(r.c) for r in starts.orderBy(F.xxhash64("d1", "d2"), "d1", "d2").limit(SPLIT_SAMPLE).collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
