"""Benchmark decontamination: one Aho-Corasick automaton over all test windows.

Test items and documents are normalised alike: A-Z lower-cased, words are runs of digits,
ASCII letters and non-ASCII characters, joined by single spaces. A window is 10 consecutive
item words; an item of fewer words (but not none) is one window. The windows, framed by
spaces, form one automaton; each document's normalised text runs through it once. Match ends
turn into word numbers by counting spaces, and word numbers into character offsets of the
original text.

The windows are the only thing broadcast. Their bytes are counted first; beyond
``BLOCK_BYTES`` they are dealt into blocks by hash, and the documents pass block after block.

Null or wordless text: no words, not contaminated. Wordless items have no window. An item
with a null id still marks words, but is not listed. Every input row gives one row, repeated
ids included. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, LOWER, Words, materialise, small, utf8

WINDOW = 10
BLOCK_BYTES = 16 << 20
NORMAL = bytes(int(LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))


def normalise(blob: bytes) -> bytes:
    return b" ".join(blob.translate(NORMAL).split())


def _windows(size: int):
    def cut(batches):
        for b in small(batches):
            ids, texts, lengths = [], [], []
            for item, blob in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words = normalise(blob).split()
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item)
                    texts.append(b" ".join(words[i : i + size]))
                    lengths.append(min(size, len(words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(lengths, pa.int32())],
                names=["item_id", "words", "n"])

    return cut


def _automaton(patterns):
    a = ahocorasick.Automaton()
    for text, n, items in patterns:
        a.add_word(f" {text.decode('latin-1')} ", (n, items))
    if patterns:
        a.make_automaton()
    return a if patterns else None


def _spans(blob: bytes, hit: np.ndarray) -> list[dict]:
    """Hit words as maximal runs, in characters of the original text."""
    w = Words([blob], ALNUM, hashes=False)
    step = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    starts, ends = w.start[np.flatnonzero(step == 1)], w.end[np.flatnonzero(step == -1) - 1]
    chars = np.concatenate(([0], np.cumsum((w.raw & 0xC0) != 0x80)))
    return [{"start": int(chars[s]), "end": int(chars[e])} for s, e in zip(starts, ends, strict=True)]


def _scan(shared, last: bool):
    """Adds one block's matches; after the last block, returns the result columns."""

    def scan(batches):
        automaton = _automaton(shared.value)
        for b in small(batches):
            texts, ranges, items = b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = []
            for k, blob in enumerate(utf8(texts)):
                text = b" " + normalise(blob) + b" "
                space = None
                found, own = ranges[k] or [], set(items[k] or [])
                for end, (n, which) in automaton.iter(text.decode("latin-1")) if automaton else ():
                    if space is None:
                        space = np.cumsum(np.frombuffer(text, np.uint8) == 0x20)
                    stop = int(space[end]) - 1
                    found += [stop - n, stop]
                    own.update(which)
                if not last:
                    rows.append((found, sorted(own)))
                    continue
                n_words = text.count(b" ") - 1 if len(text) > 2 else 0
                hit = np.zeros(n_words + 1, np.int32)
                np.add.at(hit, found[::2], 1)
                np.add.at(hit, found[1::2], -1)
                hit = np.cumsum(hit)[:n_words] > 0
                rows.append((n_words, int(hit.sum()), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(),
                             bool(hit.any()), _spans(blob, hit) if found else []))
            if last:
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
                         pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                out = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
            else:
                out = [b.column(0), texts, pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.string()))]
                names = ["doc_id", "text", "ranges", "items"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return scan


STATE = "doc_id long, text string, ranges array<long>, items array<string>"
RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "hit_spans array<struct<start:long,end:long>>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document with its words, hit words, matched items and hit spans."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    wins = materialise(items.mapInArrow(_windows(size), "item_id string, words binary, n int")
                       .groupBy("words", "n").agg(F.collect_set("item_id").alias("items")), "windows")
    total = wins.agg(F.coalesce(F.sum(F.length("words") + 64), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.lit(None).cast("array<long>").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(n_blocks):
        block = wins.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(bytes(r.words), r.n, r["items"]) for r in block])
        last = k == n_blocks - 1
        state = state.mapInArrow(_scan(shared, last), RESULT if last else STATE)
        if not last:
            state = materialise(state, "scanned")
    return state


# The same rows in SQL: words, windows and hits by list functions and joins.
ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
iwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw),
occ AS (
  SELECT p.doc_id, p.i, x.k, x.item_id
  FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM pos, (SELECT DISTINCT k FROM iwin) WHERE i + k - 1 <= len(w)) p
  JOIN iwin x ON x.win = p.win AND x.k = p.k),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
