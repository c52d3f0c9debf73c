"""Language identification by error-correcting output codes.

Every learned language has a codeword. Each bit of the code is predicted by one binary
classifier on hashed n-grams of 2, 3 and 4 bytes that lie within a word (its two edges
included; A-Z lower-cased, other ASCII characters than letters separate words). A bit's weight
of an n-gram is the log ratio of its mean probability in the languages with that bit and in those
without, so a large language doesn't outweigh a small one. A text's margin is the mean weight
of its n-grams, in units of the margin usual for that bit.

Decoding is loss-weighted: each bit costs exp(-margin) of agreement with a codeword, weighted by
how often that bit came out right for that language; the language with the least loss wins,
equal losses go to the smaller name. The score is 1 - least / second loss (0 to 1), and texts
below ``CLEAR`` are flagged as ambiguous.

Codes: all 2^(L-1) - 1 columns for up to six languages; beyond, 10 log2(L) bits, the best of
64 seeded random codes by least distance.

Fitting reads all training rows: n-gram counts are sums per language, combined by Spark. The
weight table (2^BITS buckets times the bits) is computed bucket by bucket on executors; it and
the list of languages are all that reaches the driver, sizes that no amount of text changes.
How often bits come out right is measured on about ``CALIBRATION`` training rows, chosen by
hash. One more scan predicts.

Trained on: rows with id, text and language whose crc32(id as text) mod 4 is not 2; a null id
is not held out, but not trained on either. Null texts and texts without a letter are ``und``
with score 0; without any language learned every text is; with one, all others are that language.
Repeated rows count each time; extra columns are ignored; long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, byte_class, materialise, slices, small, utf8

BITS = 18
CALIBRATION = 20_000
CLEAR = 0.2
SMOOTH = 0.5
SHRINK = 4  # n-grams without evidence added to each text: a few letters decide little
LANGS_AT_ONCE = 32  # languages a task counts before it passes the counts on

LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
PLAIN = np.where(LETTER, LOWER, 0x20).astype(np.uint8)
_ODD = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA6B), 4: np.uint32(0xC2B2AE35)}


def ngrams(blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, edges) for each n-gram length: text i's buckets are edges[i] to edges[i + 1]."""
    raw = PLAIN[np.frombuffer(b" " + b" ".join(blobs) + b" ", np.uint8)]
    letter = raw != 0x20
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    keep[0] = True
    ends = np.cumsum([len(b) + 1 for b in blobs]) + 1
    place = np.concatenate(([0], np.cumsum(keep)))[np.minimum(ends, len(raw))]  # bytes kept up to each text's end
    text = raw[keep].astype(np.uint32)
    space = text == 0x20
    out = []
    for n, odd in _ODD.items():
        if len(text) < n:
            out.append((np.zeros(0, np.int64), np.zeros(len(blobs) + 1, np.int64)))
            continue
        size = len(text) - n + 1
        code, fine = np.zeros(size, np.uint32), np.ones(size, bool)
        for i in range(n):
            code = (code << np.uint32(8)) | text[i : i + size]
            if 0 < i < n - 1:
                fine &= ~space[i : i + size]
        if n == 2:
            fine &= ~(space[:size] & space[1:])
        at = np.flatnonzero(fine)
        bucket = ((code[at] ^ (code[at] >> np.uint32(15))) * odd) >> np.uint32(32 - BITS)
        # The second byte of an n-gram is always its text's own.
        out.append((bucket.astype(np.int64), np.concatenate(([0], np.searchsorted(at + 1, place)))))
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    bits, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # both values in each column
        product = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(product, -bits)
        distance = (bits - product.max()) // 2
        if distance > least:
            best, least = code, distance
    return best


class Model:
    """Languages, their codewords, a weight for each (bit, bucket), and the loss weights."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        self.unit = np.ones(code.shape[1])
        self.trust = np.full(code.shape, 1 / max(1, code.shape[1]))

    def margins(self, blobs: list[bytes]) -> np.ndarray:
        total, n = np.zeros((len(blobs), len(self.weights))), np.zeros(len(blobs))
        for bucket, edges in ngrams(blobs):
            n += np.diff(edges)
            for j, weight in enumerate(self.weights):
                run = np.concatenate(([0.0], np.cumsum(weight[bucket], dtype=np.float64)))
                total[:, j] += run[edges[1:]] - run[edges[:-1]]
        return total / (n + SHRINK)[:, None]

    def calibrate(self, langs: list[str], right: np.ndarray, size: np.ndarray, n: np.ndarray) -> None:
        """Loss weights and units from rows (language, per bit: right, sum of |margin|; texts)."""
        if n.sum() == 0:
            return
        self.unit = np.maximum(size.sum(axis=0) / n.sum(), 1e-9)
        place = {x: i for i, x in enumerate(self.langs)}
        trust = np.ones(self.code.shape)
        for lang, r, m in zip(langs, right, n, strict=True):
            trust[place[lang]] = np.maximum(r / m, 0.01)
        self.trust = trust / trust.sum(axis=1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest codeword, score) of each text."""
        if len(self.langs) < 2:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        cost = np.exp(-np.clip(self.code[None] * (margins / self.unit)[:, None, :], -8, 8))
        loss = (self.trust[None] * cost).sum(axis=2)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return np.argmin(loss, axis=1), np.clip(1 - two[:, 0] / two[:, 1], 0, 1)


def _count(batches):
    """Nonzero n-gram counts (lang, bucket, n) of a task's training rows."""
    tally: dict[str, np.ndarray] = {}

    def out():
        for lang, n in tally.items():
            at = np.flatnonzero(n)
            for lo in range(0, len(at), 1 << 16):
                some = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])],
                                                 names=["lang", "bucket", "n"])
        tally.clear()

    for b in small(batches):
        langs, blobs = np.array(b.column(0).to_pylist(), object), utf8(b.column(1))
        for lo, hi in slices(blobs):
            grams = ngrams(blobs[lo:hi])
            for lang in set(langs[lo:hi].tolist()):
                own = langs[lo:hi] == lang
                if lang not in tally:
                    if len(tally) >= LANGS_AT_ONCE:
                        yield from out()
                    tally[lang] = np.zeros(1 << BITS, np.int64)
                for bucket, edges in grams:
                    tally[lang] += np.bincount(bucket[np.repeat(own, np.diff(edges))], minlength=1 << BITS)
    yield from out()


def _weigh(langs: list[str], totals: np.ndarray, code: np.ndarray):
    """Each bucket's weights, from its counts in all languages."""
    place = {x: i for i, x in enumerate(langs)}
    ones = (code > 0).astype(float)
    up, down = ones / np.maximum(ones.sum(axis=0), 1), (1 - ones) / np.maximum((1 - ones).sum(axis=0), 1)

    def weigh(batches):
        for b in small(batches, 4096):
            n = np.zeros((b.num_rows, len(langs)))
            for i, counts in enumerate(b.column(1).to_pylist()):
                for x in counts:
                    n[i, place[x["lang"]]] = x["n"]
            p = (n + SMOOTH) / (totals + SMOOTH * (1 << BITS))
            w = np.log((p @ up) / (p @ down)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in w], pa.binary())], names=["bucket", "w"])

    return weigh


def _check_bits(shared):
    """How the bits come out on training rows: (lang, bit, right, size, n) summed in each task."""

    def check(batches):
        model: Model = shared.value
        place = {x: i for i, x in enumerate(model.langs)}
        right, size, n = np.zeros(model.code.shape), np.zeros(model.code.shape), np.zeros(len(model.langs))
        for b in small(batches):
            langs, blobs = b.column(0).to_pylist(), utf8(b.column(1))
            for lo, hi in slices(blobs):
                own = np.array([place.get(x, -1) for x in langs[lo:hi]], np.int64)
                m = model.margins(blobs[lo:hi])[own >= 0]
                own = own[own >= 0]
                np.add.at(right, own, (m * model.code[own] > 0).astype(float))
                np.add.at(size, own, np.abs(m))
                np.add.at(n, own, 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.langs[i] for i in at], pa.string()), pa.array([right[i].tolist() for i in at], pa.list_(pa.float64())),
             pa.array([size[i].tolist() for i in at], pa.list_(pa.float64())), pa.array(n[at])], names=["lang", "right", "size", "n"])

    return check


def train(rows: DataFrame, calibration: int = CALIBRATION) -> Model | None:
    """A model of ``rows`` (lang, text; none null), or None without any n-gram in them."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long")
    counts = materialise(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngram-counts")
    totals = sorted(counts.groupBy("lang").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.lang)
    if not totals:
        return None
    langs = [r.lang for r in totals]
    code = codewords(len(langs))
    weights = np.zeros((code.shape[1], 1 << BITS), np.float32)
    if len(langs) < 2:
        return Model(langs, code, weights)
    per_bucket = counts.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
    found = per_bucket.mapInArrow(_weigh(langs, np.array([r.n for r in totals], float), code), "bucket int, w binary").toArrow()
    if found.num_rows:
        table = np.frombuffer(b"".join(found.column("w").to_pylist()), np.float32).reshape(found.num_rows, -1)
        weights[:, found.column("bucket").to_numpy()] = table.T
    model = Model(langs, code, weights)
    n = rows.count()
    sampled = rows.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1_000_003)) < min(1.0, calibration / max(1, n)) * 1_000_003)
    sums = sampled.mapInArrow(_check_bits(spark.sparkContext.broadcast(model)), "lang string, right array<double>, size array<double>, n double")
    parts = [F.sum(F.col(c)[j]).alias(f"{c}{j}") for j in range(code.shape[1]) for c in ("right", "size")]
    got = sums.groupBy("lang").agg(F.sum("n").alias("n"), *parts).collect()
    model.calibrate([r.lang for r in got], *(np.array([[r[f"{c}{j}"] for j in range(code.shape[1])] for r in got]) for c in ("right", "size")),
                    np.array([r.n for r in got]))
    return model


def _predict(shared):
    def predict(batches):
        model: Model | None = shared.value if shared is not None else None
        for b in small(batches):
            readable = np.array(b.column(2).to_pylist(), bool)
            blobs = utf8(b.column(1))
            langs, scores = np.full(len(blobs), "und", object), np.zeros(len(blobs))
            for lo, hi in slices(blobs) if model is not None else ():
                best, score = model.decode(model.margins(blobs[lo:hi]))
                ok = readable[lo:hi]
                langs[lo:hi][ok] = np.array(model.langs, object)[best[ok]]
                scores[lo:hi][ok] = score[ok]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores), pa.array(scores < CLEAR)],
                                             names=["row", "lang_pred", "score", "ambiguous"])

    return predict


def predict(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` has two columns: any long to carry along, and the text. Returns row, lang_pred,
    score and ambiguous."""
    shared = rows.sparkSession.sparkContext.broadcast(model) if model is not None else None
    row, text = (F.col(f"`{c}`") for c in rows.columns)
    known = rows.select(row.cast("long").alias("row"), text.cast("string").alias("text"))
    known = known.withColumn("readable", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return known.mapInArrow(_predict(shared), "row long, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str):
    """True for the rows kept out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled rows of ``docs`` that are not held out, and predict all of them."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = base.where("doc_id is not null and text is not null and lang is not null").where(~held_out("doc_id")).select("lang", "text")
    found = predict(base.select("doc_id", "text"), train(known))
    return found.select(F.col("row").alias("doc_id"), held_out("row").alias("held_out"), "lang_pred", "score", "ambiguous")
