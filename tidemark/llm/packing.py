"""Best-fit packing with bound-certified repacking.

Documents are tokenised (byte-level BPE, then an end id); those longer than a sequence are cut
into sequence-long pieces, the first of which may be shorter. Full pieces are sequences by
themselves. Shorter ones are dealt by hash into groups of bounded size and packed best-fit
decreasing. Dual-feasible functions give each group's lower bound: a group that reaches it is
certified. Groups with a gap release the pieces of their emptier bins; these are dealt anew
over fewer groups (so pieces of different groups meet) and packed again. The exchange repeats
while it saves sequences.

Null text counts as empty: one piece holding the end id. Every input row is packed, repeated
ids included (each row is a document of its own). Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

CAPACITY = 1024
END_ID = 2
GROUP_ROWS = 100_000
MAX_ROUNDS = 6
RELEASED = 0.3  # share of a gap group's bins, emptiest first, whose pieces are exchanged
# The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow 255.
_PLAIN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
_OTHER = [b for b in range(256) if b not in _PLAIN]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(_OTHER)}


# Fixed value: the byte-level pre-tokeniser's pattern.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "It's 12 Tüten,  ñandú\n\n 中文 … \t naïve!! 's x1y2 "


class Encoder:
    """Ids of a text by a byte-level BPE tokenizer file. Its vocabulary (merges in order of id)
    is run by tiktoken's merge loop, several times faster than the pipeline of tokenizers for
    the same ids (checked on a probe here and on texts in the tests). Texts that hold a special
    token, and files whose probe differs, go through tokenizers itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        byte = {c: b for b, c in _ALPHABET.items()}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(_PROBE) != self._plain(_PROBE).tolist():
            self.fast = None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self._plain(text).tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process: what it remembers serves all its tasks."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        enc = encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.ids(text or "") + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, k, start, length, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item. Open bins are kept by free space; a bit mask finds the
    tightest that fits."""
    out = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual-feasible functions: rounding u_k and threshold U_e families."""
    size = np.arange(capacity + 1)
    have = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    best = -(-int((have * size).sum()) // capacity)
    for k in range(1, 33):
        whole = (k + 1) * size % capacity == 0
        weight = np.where(whole, k * size, (k + 1) * size // capacity * capacity)  # in units of 1/(k * capacity)
        best = max(best, -(-int((have * weight).sum()) // (k * capacity)))
    count = np.cumsum(have)
    total = np.cumsum(have * size)
    e = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def _pack(capacity: int):
    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        order = np.lexsort((-lengths, bins))
        fill = np.bincount(bins, lengths).astype(np.int64)
        offset = np.empty(len(pdf), np.int64)
        ends = np.cumsum(lengths[order])
        base = np.concatenate(([0], np.cumsum(fill)))[:-1]
        offset[order] = ends - lengths[order] - base[bins[order]]
        gap = len(fill) - lower_bound(lengths, capacity)
        loose = np.zeros(len(fill), bool)
        if gap > 0:
            worst = np.argsort(fill, kind="stable")[: max(gap + 1, int(RELEASED * len(fill)))]
            loose[worst] = fill[worst] < capacity
        elif len(fill):
            loose[np.argmin(fill)] = fill.min() < capacity  # the last, partly filled bin
        return pd.DataFrame({"key": pdf["key"], "length": lengths, "grp": int(key[0]), "bin": bins, "offset": offset,
                             "gap": gap, "loose": loose[bins]})

    return pack


PLACED = "key long, length long, grp long, bin long, offset long, gap long, loose boolean"


def _round(items: DataFrame, n: int, groups: int, number: int, capacity: int, name: str) -> DataFrame:
    dealt = items.select("key", "length", F.pmod(F.xxhash64("key", F.lit(number)), F.lit(groups)).alias("grp"))
    placed = dealt.groupBy("grp").applyInPandas(_pack(capacity), PLACED)
    return materialise(placed.withColumn("round", F.lit(number)), name)


def _bins(placed: DataFrame) -> int:
    return placed.select("grp", "bin").distinct().count()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, group_rows: int = GROUP_ROWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the
    ids themselves, if asked for)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cols = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    pieces = base.mapInArrow(_tokenise(tokenizer_path, capacity, end_id, with_ids), cols)
    pieces = materialise(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity).select("key", "length")
    n = short.count()
    done, number = None, 0
    if n:
        groups = max(1, -(-n // group_rows))
        placed = _round(short, n, groups, 0, capacity, "packed")
        for number in range(1, MAX_ROUNDS):
            loose = placed.where("loose")
            n = loose.count()
            if groups == 1 or n == 0:
                break
            groups = min(max(1, -(-n // group_rows)), groups - 1)
            again = _round(loose, n, groups, number, capacity, "repacked")
            if _bins(again) >= _bins(loose):
                break
            kept = placed.where("not loose")
            done = kept if done is None else done.unionByName(kept)
            placed = again
        done = placed if done is None else done.unionByName(placed)
        # (round, group, bin) as one number; even, so it never meets a full piece's odd one.
        seq = F.shiftleft(F.col("round").cast("long") * 2**22 + F.col("grp"), 32) + F.col("bin") * 2
        done = done.select("key", seq.alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("key") * 2 + 1, "offset": F.lit(0).cast("long")})
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    full = full.select(*out)
    return full if done is None else full.unionByName(pieces.join(done, "key").select(*out))
