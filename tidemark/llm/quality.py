"""Quality by ordinal cumulative-link regression on graded ratings.

Grades come from ``labels``: 0 low quality, 1 acceptable but toxic, 2 clean. With the score
s = w . x of a text's hashed features, P(grade <= k) = sigmoid(t_k - s); the weights w are
shared by all grades, the thresholds t_0 < t_1 are ordered by construction (t_1 = t_0 +
exp(gap)). Results are the expected grade and the tail probability P(grade >= 2).

Features are hashed text: presence of each lower-cased word and of each word's first 4
bytes (word families), and steps of the share (at least 1/2, 1/4 ... 1/64 of the words) of
each letter shape ("A!" for "SHOUT!!") and of immediate repeats.

Fitting reads at most ``SAMPLE`` labelled documents (those with the smallest keyed hash of
their id), a documented bound; scoring covers every row in Arrow batches. The weight vector
(2^BITS floats) is the only thing broadcast. Null or empty text has no features and gets
P from the thresholds alone, but is rejected as empty. Without usable labels every grade is
null and every row is kept. Repeated ids are scored row by row; extra columns pass through
``select_quality`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tidemark.llm.common import ALNUM, HASHER, NOT_SPACE, U64, Words, mix, small, slices, utf8

BITS = 20
SAMPLE = 24000
EPOCHS = 8
L1, L2, RATE = 16.0, 0.1, 0.2
MIN_TAIL = 0.65
PREFIXES = (None, 4)  # whole words, and their first bytes
LEAST_SEEN = 10  # documents of the sample a bucket must occur in to carry a weight

# Kinds of bytes: upper case, other letters, digits; the rest stand for themselves.
_KIND = np.array([0x41 if 65 <= b <= 90 else 0x61 if 97 <= b <= 122 or b >= 0x80 else 0x30 if 48 <= b <= 57 else b
                  for b in range(256)], np.uint8)
_REPEAT = U64(7)


def _shapes(w: Words) -> np.ndarray:
    """A hash of each word's shape: its kinds of bytes, runs of one kind counted once."""
    kinds = _KIND[w.raw]
    inside = np.zeros(len(kinds) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[w.start] = True
    new &= np.cumsum(inside[:-1]) > 0
    at = np.concatenate(([0], np.cumsum(new)))
    return HASHER.ranges(HASHER.prefix(kinds[new]), at[w.start], at[w.end])


def features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(indptr, buckets): the distinct feature buckets of each text."""
    ptr, out, top = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
    for lo, hi in slices(blobs):
        w = Words(blobs[lo:hi], NOT_SPACE)
        rep = np.zeros(len(w.start), bool)
        rep[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        kinds, which = np.unique(np.concatenate((_shapes(w), np.full(int(rep.sum()), _REPEAT))), return_inverse=True)
        pair, n = np.unique(np.concatenate((w.doc, w.doc[rep])) * max(1, len(kinds)) + which, return_counts=True)
        doc, kind = pair // max(1, len(kinds)), kinds[pair % max(1, len(kinds))] if len(kinds) else kinds
        share = n / w.count[doc]
        rows, keys = [], []
        plain = Words(blobs[lo:hi], ALNUM, hashes=False)
        prefix = HASHER.prefix(plain.buf)
        for k in PREFIXES:
            end = plain.end if k is None else np.minimum(plain.start + k, plain.end)
            rows.append(plain.doc)
            keys.append(mix(HASHER.ranges(prefix, plain.start, end) + U64(k or 0)))
        for step in range(1, 7):
            ok = (share >= 0.5**step) & ((kind != _REPEAT) | (n >= 3))  # two equal words in a row happen by chance
            rows.append(doc[ok])
            keys.append(mix(kind[ok] * U64(64) + U64(step)))
        code = np.unique((np.concatenate(rows) << BITS) | (np.concatenate(keys) >> U64(64 - BITS)).astype(np.int64))
        out.append(code & ((1 << BITS) - 1))
        ptr.append(top + np.searchsorted(code >> BITS, np.arange(1, hi - lo + 1)))
        top += len(code)
    return np.concatenate(ptr), np.concatenate(out).astype(np.int32)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """Weights and the two ordered thresholds; small enough to broadcast (2^BITS floats)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def grades(self, ptr: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, P(grade >= 2)) of each text."""
        s = _scores(self.weights, ptr, idx)
        above = 1 - _sigmoid(self.thresholds[None, :] - s[:, None])
        return above.sum(axis=1), above[:, -1]


def _scores(weights, ptr, idx):
    total = np.concatenate(([0.0], np.cumsum(weights[idx], dtype=np.float64)))
    return total[ptr[1:]] - total[ptr[:-1]]


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, batch: int = 64) -> Model | None:
    """Follow-the-regularised-leader (L1 and L2) on the negative log-likelihood of the
    cumulative-link model; thresholds by Adagrad. None when fewer than two grades occur."""
    y_all = np.array([g for _, g in rows], np.int64)
    if len(np.unique(y_all)) < 2:
        return None
    seen = np.zeros(1 << BITS, np.int32)
    for x, _ in rows:
        seen[x] += 1
    xs = [x[seen[x] >= LEAST_SEEN] for x, _ in rows]
    z, square = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        pull = np.maximum(np.abs(z[at]) - L1, 0) * np.sign(z[at])
        return -pull / ((1 + np.sqrt(square[at])) / RATE + L2)

    low, gap, edge_square = -1.0, 1.0, np.full(2, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ptr = np.concatenate(([0], np.cumsum([len(xs[i]) for i in own])))
            touched, back = np.unique(np.concatenate([xs[i] for i in own]), return_inverse=True)
            w = weights(touched)
            s = _scores(w, ptr, back)
            cut = np.array([-np.inf, low, low + np.exp(gap), np.inf])
            y = y_all[own]
            hi, lo = _sigmoid(cut[y + 1] - s), _sigmoid(cut[y] - s)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            grad = np.bincount(back, np.repeat(d_hi - d_lo, np.diff(ptr)), len(touched))
            z[touched] += grad - (np.sqrt(square[touched] + grad * grad) - np.sqrt(square[touched])) / RATE * w
            square[touched] += grad * grad
            d_cut = np.zeros(4)
            np.add.at(d_cut, y + 1, -d_hi / len(own))
            np.add.at(d_cut, y, d_lo / len(own))
            edge = np.array([d_cut[1] + d_cut[2], d_cut[2] * np.exp(gap)])
            edge_square += edge * edge
            low, gap = np.array([low, gap]) - 0.1 * edge / np.sqrt(edge_square)
    return Model(weights(np.arange(1 << BITS)).astype(np.float32), np.array([low, low + np.exp(gap)]))


def _featurise(batches):
    for b in small(batches):
        ptr, idx = features(utf8(b.column(0)))
        rows = [idx[ptr[i] : ptr[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(1)], names=["x", "grade"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents (smallest keyed hash of the id)."""
    graded = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").alias("label_id"),
        F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"))
    graded = graded.groupBy("label_id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("label_id", F.lit(17)), "label_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # At most ``sample`` ids are broadcast, so the texts that are not chosen stay where they are. One
    # row a label: repeated ids would otherwise exceed the bound.
    rows = rows.join(F.broadcast(chosen), "label_id").groupBy("label_id").agg(F.min_by("text", F.length("text")).alias("text"), F.first("grade").alias("grade"))
    found = rows.select("text", "grade").mapInArrow(_featurise, "x binary, grade int").collect()
    return fit([(np.frombuffer(r.x, np.int32), r.grade) for r in sorted(found, key=lambda r: (r.grade, bytes(r.x)))])


def _score(shared, least_tail: float):
    def score(batches):
        model = shared.value if shared is not None else None
        for b in small(batches):
            blobs = utf8(b.column(1))
            if model is None:
                grade = tail = pa.nulls(len(blobs), pa.float64())
                keep = pa.array([True] * len(blobs))
            else:
                e, t = model.grades(*features(blobs))
                grade, tail = pa.array(e), pa.array(t)
                keep = pa.array((t >= least_tail) & np.array([bool(x.strip()) for x in blobs], bool))
            yield pa.RecordBatch.from_arrays([b.column(0), grade, tail, keep], names=["row", "grade", "tail", "keep"])

    return score


def grade_documents(rows: DataFrame, model: Model | None, least_tail: float = MIN_TAIL) -> DataFrame:
    """``rows`` has two columns: any value to carry along, and the text. Returns row (that
    value), grade (expected), tail (P(grade >= 2)) and keep."""
    shared = rows.sparkSession.sparkContext.broadcast(model) if model is not None else None
    schema = StructType([StructField("row", rows.schema[0].dataType), StructField("grade", DoubleType()),
                         StructField("tail", DoubleType()), StructField("keep", BooleanType())])
    return rows.mapInArrow(_score(shared, least_tail), schema)


def select_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", least_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged (they travel as one
    struct, so no name can clash)."""
    model = train(docs, labels, text_col=text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    return grade_documents(rows, model, least_tail).where("keep").select("row.*")
