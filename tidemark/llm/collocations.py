"""Phrase collocations: Misra-Gries summaries per hash partition, then an exact second pass.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into
words at spaces and tabs. A phrase is 2 to ``max_words`` consecutive words of a piece. Everything
is counted per language.

Pass 1. Texts are dealt into chunks of some megabytes, written once. A chunk counts its
distinct n-grams (single words included) and sends them, as 24-bit fingerprints with counts, to
the hash partition of each n-gram. A partition merges these summaries in a Misra-Gries summary
whose capacity exceeds the partition's mass divided by the threshold; so the total that merging
subtracts from a counter stays below the threshold, and every n-gram that is frequent enough
survives. (Fingerprints that coincide only add survivors.) Each chunk gets back one bit for
each n-gram it sent.

Pass 2. The chunks count their survivors by their words and send them, sorted and packed, to their
hash partition again, which adds them up: exact numbers, of which those below the threshold are
dropped. Parts of a frequent phrase are frequent
themselves, so all counts that a score needs are there.

Bounds: a chunk holds about ``chunk_bytes`` of text, a partition about ``partition_mass``
occurrences, whatever the size of the table; a hot word is one entry a chunk. Chunks times
partitions is the number of summaries moved: raise both with the executors' memory beyond some
tens of terabytes. Within a chunk words are told apart by 64-bit hashes. Parts with at least one
in ``HOT`` of all words (hence at most ``HOT`` words and ``HOT`` phrases of each length, of
average length) are joined by broadcast, all others by a shuffle.

Null texts count as empty, null languages as ``und``; repeated rows count each time; an empty
table gives no rows. Texts longer than a chunk are cut at the end of a piece. Extra columns
are ignored. Scores are exact for counts below 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import HASHER, LOWER, U64, byte_class, materialise, mix, small, utf8

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
CHUNK_BYTES = 4 << 20
PARTITION_MASS = 4_000_000
HOT = 20_000
SALTS = 64
_STEP = U64(0x9E3779B97F4A7C15)
_LOW = U64((1 << 24) - 1)  # several times the n-grams of a partition

PIECE_END = byte_class(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
WORD = byte_class(lambda b: b not in (0x20, 0x09)) & ~PIECE_END


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters; a count is too low by ``error`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Adds another summary's counters (with that summary's own error)."""
        self.error += error
        keys, counts = np.concatenate((self.keys, keys)), np.concatenate((self.counts, counts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        spare = len(self.keys) - self.capacity
        if spare > 0:
            # The largest of those that must go is taken off all: at least capacity + 1 units each time.
            off = int(np.partition(self.counts, spare - 1)[spare - 1])
            self.error += off
            keep = self.counts > off
            self.keys, self.counts = self.keys[keep], self.counts[keep] - off

    def frequent(self, least: int) -> np.ndarray:
        """The keys that may have ``least`` occurrences, sorted."""
        return self.keys[self.counts + self.error >= least]


def _cut(blob: bytes, limit: int) -> Iterator[bytes]:
    """A long text in parts of at most ``limit`` bytes, where a piece ends there at all."""
    at = 0
    while len(blob) - at > limit:
        ends = np.flatnonzero(PIECE_END[np.frombuffer(blob, np.uint8, limit, at)])
        if len(ends) == 0:
            ends = np.flatnonzero(PIECE_END[np.frombuffer(blob, np.uint8, offset=at)])[:1]
        if len(ends) == 0:
            break
        stop = at + int(ends[-1]) + 1
        yield blob[at:stop]
        at = stop
    yield blob[at:]


def _bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = WORD[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _chunks(limit: int):
    """Rows (langs, ends, n_words, texts): texts of a chunk joined by line ends, compressed (Arrow
    batches hold many chunks)."""

    def row(langs, blobs):
        texts = b"\n".join(blobs)
        ends = np.cumsum([len(b) + 1 for b in blobs]) - 1
        start, _ = _bounds(np.frombuffer(texts, np.uint8))
        n = np.diff(np.searchsorted(start, np.concatenate(([0], ends))))
        return pa.RecordBatch.from_arrays(
            [pa.array([langs], pa.list_(pa.string())), pa.array([ends.tolist()], pa.list_(pa.int64())),
             pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([zstandard.compress(texts)], pa.binary())],
            names=["langs", "ends", "n_words", "texts"])

    def chunks(batches):
        langs, blobs, size = [], [], 0
        for b in small(batches):
            for lang, whole in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for blob in _cut(whole, limit):
                    if blobs and size + len(blob) > limit:
                        yield row(langs, blobs)
                        langs, blobs, size = [], [], 0
                    langs.append(lang)
                    blobs.append(blob)
                    size += len(blob) + 1
        if blobs:
            yield row(langs, blobs)

    return chunks


class _Chunk:
    """The distinct n-grams of a chunk, in the order of their hash partition and fingerprint.

    ``grams`` lists for each length the words (as rows of word numbers), ``count`` their
    occurrences, ``code`` (partition << 32 | fingerprint) in ascending order, and ``order`` the
    n-gram of each code."""

    def __init__(self, langs: list[str], ends: np.ndarray, texts: bytes, partitions: int, max_words: int):
        self.buf = LOWER[np.frombuffer(texts, np.uint8)]
        self.start, self.end = _bounds(self.buf)
        n = len(self.start)
        doc = np.searchsorted(ends, self.start)
        names, which = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.langs = names.tolist()
        salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], U64)
        hashes = np.empty(n, U64)
        at = 0
        while at < n:  # about a megabyte at a time
            stop = max(at + 1, int(np.searchsorted(self.end, self.start[at] + (1 << 20), "right")))
            lo = self.start[at]
            prefix = HASHER.prefix(self.buf[lo : self.end[stop - 1]])
            hashes[at:stop] = HASHER.ranges(prefix, self.start[at:stop] - lo, self.end[at:stop] - lo)
            at = stop
        lang = which[doc]
        words, self.first, ids, count = np.unique(mix(hashes ^ salt[lang]), return_index=True, return_inverse=True, return_counts=True)
        self.lang = lang[self.first]
        piece = np.cumsum(PIECE_END[self.buf], dtype=np.int32)[self.start]
        near = piece[1:] == piece[:-1]
        v = max(1, len(words))
        self.grams, counts, codes = [np.arange(len(words))[:, None]], [count], [words]
        at, last, raw = np.arange(n), ids, words
        for k in range(2, max_words + 1):
            # n-grams of k - 1 words that go on: last[i] is the one that starts at word at[i].
            go = at + k - 1 < n
            go[go] = near[at[go] + k - 2]
            at, last = at[go], last[go]
            key, last, count = np.unique(last * v + ids[at + k - 1], return_inverse=True, return_counts=True)
            self.grams.append(np.column_stack((self.grams[-1][key // v], key % v)))
            raw = raw[key // v] * _STEP + words[key % v]
            counts.append(count)
            codes.append(mix(raw + U64(k)))
        self.count = np.concatenate(counts)
        codes = np.concatenate(codes)
        codes = ((codes >> U64(32)) % U64(partitions) << U64(32)) | (codes & _LOW)
        self.order = np.argsort(codes, kind="stable")
        self.code = codes[self.order]
        self.edges = np.searchsorted(self.code >> U64(32), np.arange(partitions + 1, dtype=U64))


def _planes(a: np.ndarray) -> bytes:
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


def _open(row, partitions: int, max_words: int) -> _Chunk:
    return _Chunk(row["langs"], np.array(row["ends"], np.int64), zstandard.decompress(row["texts"]), partitions, max_words)


def _summaries(partitions: int, max_words: int):
    """Each chunk's counts, cut by hash partition."""

    def send(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in small(batches, 1):
            row = b.to_pylist()[0]
            c = _open(row, partitions, max_words)
            fps, counts = (c.code & _LOW).astype(np.int64), c.count[c.order]
            rows = []
            for p in np.flatnonzero(np.diff(c.edges)).tolist():
                lo, hi = c.edges[p], c.edges[p + 1]
                blob = _planes(np.diff(fps[lo:hi], prepend=0)) + _planes(counts[lo:hi])
                rows.append((row["chunk"], p, int(counts[lo:hi].sum()), press.compress(blob)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             names=["chunk", "part", "mass", "grams"])

    return send


def _counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    half = len(raw) // 2
    return np.cumsum(_from_planes(raw[:half]), dtype=np.int64).astype(np.uint32), _from_planes(raw[half:]).astype(np.int64)


def survivors(blobs: list[bytes], mass: int, least: int) -> np.ndarray:
    """Fingerprints of a partition that may be frequent; none that is frequent is missing."""
    summary = MisraGries(mass // least + 1)
    waiting, size = [], 0
    for i, blob in enumerate(blobs):
        waiting.append(_counts(blob))
        size += len(waiting[-1][0])
        if size >= summary.capacity or i == len(blobs) - 1:
            summary.merge(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting, size = [], 0
    return summary.frequent(least)


def _answer(least: int):
    """One bit for each n-gram that a chunk sent to this partition."""

    def answer(t: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in t.column("grams")]
        found = survivors(blobs, sum(t.column("mass").to_pylist()), least)
        bits = []
        for blob in blobs:
            fps, _ = _counts(blob)
            at = np.searchsorted(found, fps)
            at[at == len(found)] = 0
            hit = found[at] == fps if len(found) else np.zeros(len(fps), bool)
            bits.append(zstandard.compress(np.packbits(hit).tobytes(), 1) if hit.any() else None)
        return pa.table({"chunk": t.column("chunk"), "part": t.column("part"), "bits": pa.array(bits, pa.binary())})

    return answer


def _count(partitions: int, max_words: int):
    """The survivors of each chunk by their words, with their occurrences there: packed, sorted,
    for each hash partition and language."""

    def count(batches):
        press = zstandard.ZstdCompressor()
        for b in small(batches, 1):
            row = b.to_pylist()[0]
            c = _open(row, partitions, max_words)
            picked, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a in row["answers"]:
                lo, hi = c.edges[a["part"]], c.edges[a["part"] + 1]
                hit = np.unpackbits(np.frombuffer(zstandard.decompress(a["bits"]), np.uint8))[: hi - lo].astype(bool)
                picked.append(c.order[lo:hi][hit])
                parts.append(np.full(len(picked[-1]), a["part"]))
            picked, parts = np.concatenate(picked), np.concatenate(parts)
            raw = c.buf.tobytes()
            words = pa.array([raw[s:e] for s, e in zip(c.start[c.first].tolist(), c.end[c.first].tolist(), strict=True)], pa.binary())
            base, found = 0, []
            for k, grams in enumerate(c.grams, 1):
                own = (picked >= base) & (picked < base + len(grams))
                ids = grams[picked[own] - base]
                base += len(grams)
                one = [words.take(pa.array(ids[:, i])) for i in range(k)]
                found.append(pa.table({"group": parts[own] * len(c.langs) + c.lang[ids[:, 0]],
                                       "phrase": one[0] if k == 1 else pc.binary_join_element_wise(*one, b" "), "a": c.count[picked[own]]}))
            found = pa.concat_tables(found)
            found = found.take(pc.sort_indices(found, [("group", "ascending"), ("phrase", "ascending")])).combine_chunks()
            group, n = found.column("group").to_numpy(), found.column("a").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))).tolist() if len(group) else []
            rows = [(int(group[lo]) // len(c.langs), c.langs[int(group[lo]) % len(c.langs)], hi - lo,
                     press.compress(_planes(n[lo:hi]) + b"\n".join(found.column("phrase").slice(lo, hi - lo).to_pylist())))
                    for lo, hi in zip(edges, edges[1:])]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                                             names=["part", "lang", "n", "grams"])

    return count


def _sum(least: int):
    """The phrases of a hash partition and language with at least ``least`` occurrences."""

    def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        phrases, counts = [], []
        for n, blob in zip(t.column("n").to_pylist(), t.column("grams"), strict=True):
            raw = zstandard.decompress(blob.as_py())
            counts.append(_from_planes(raw[: 4 * n]).astype(np.int64))
            phrases.append(pa.array(raw[4 * n :].split(b"\n"), pa.binary()))
        g = pa.table({"phrase": pa.chunked_array(phrases), "a": np.concatenate(counts)}).group_by("phrase", use_threads=False).aggregate([("a", "sum")])
        g = g.filter(pc.greater_equal(g.column("a_sum"), least))
        phrase = g.column("phrase").cast(pa.string())
        return pa.table({"lang": pa.array([key[1].as_py()] * len(g), pa.string()), "phrase": phrase,
                         "k": pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32()), "a": g.column("a_sum")})

    return total


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, chunk_bytes: int = CHUNK_BYTES, partition_mass: int = PARTITION_MASS) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): every phrase of 1 to ``max_words`` words with at least ``least``
    occurrences (lang, phrase, k words, a occurrences), and each language's words (lang, n)."""
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = base.mapInArrow(_chunks(chunk_bytes), "langs array<string>, ends array<long>, n_words array<long>, texts binary")
    chunks = materialise(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    totals = chunks.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n_words").alias("n"))
    mass = max_words * (totals.agg(F.sum("n")).first()[0] or 0)
    partitions = max(1, -(-mass // partition_mass))
    sent = chunks.mapInArrow(_summaries(partitions, max_words), "chunk long, part long, mass long, grams binary")
    answers = sent.groupBy("part").applyInArrow(_answer(least), "chunk long, part long, bits binary").where("bits is not null")
    answers = materialise(answers, "answers").groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    own = chunks.select("chunk", "langs", "ends", "texts").join(answers.hint("shuffle_hash"), "chunk")
    counted = own.mapInArrow(_count(partitions, max_words), "part long, lang string, n long, grams binary")
    frequent = counted.groupBy("part", "lang").applyInArrow(_sum(least), "lang string, phrase string, k int, a long")
    return materialise(frequent, "frequent"), totals


def _score(a, left, right):
    exact = [F.col(x).cast("decimal(18,0)") for x in (a, left, right)]
    return F.call_function("div", exact[0] * exact[0] * F.lit(1_000_000).cast("decimal(7,0)"), exact[1] * exact[2]).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP, inside_percent: int = 50, **bounds) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(10^6 a^2 / (l r)) with l and r the counts of its two sides; the
    lowest cut counts. Phrases inside a longer one that has ``inside_percent`` of their
    occurrences or more are left out."""
    frequent, totals = frequent_phrases(docs, text_col, lang_col, least, max_words, **bounds)
    total = totals.agg(F.sum("n")).first()[0] or 0
    found = frequent.where("k > 1").withColumn("words", F.split("phrase", " "))

    def side(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    asked = cuts.select("lang", "phrase", "k", "a", "cut", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), side(F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit("r").alias("side"), side(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))).alias("x"))
    asked = asked.select("lang", "phrase", "k", "a", "cut", "x.side", "x.part")
    counts = frequent.where(F.col("k") < max_words).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    hot = F.broadcast(counts.where(F.col("f") * HOT >= total))
    known = asked.join(hot, ["lang", "part"]).unionByName(asked.join(hot, ["lang", "part"], "left_anti").join(counts, ["lang", "part"]))
    wide = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"{s}{c}") for c in range(1, max_words) for s in "lr"]
    scored = known.groupBy("lang", "phrase", "k", "a").agg(*wide)
    options = [F.when(F.col(f"l{c}").isNotNull(), F.struct(_score("a", f"l{c}", f"r{c}").alias("score"), F.lit(c).alias("cut"),
                                                            F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, max_words)]
    scored = scored.withColumn("best", F.least(*options) if len(options) > 1 else options[0])
    scored = scored.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")
    # The most frequent longer phrase around each shorter one.
    longer = found.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    longer = longer.select("lang", side(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"around is null or 100 * around < {int(inside_percent)} * a"))
    # The best of each salt first, so that a large language is not ranked in one task.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for split in (Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))), Window.partitionBy("lang")):
        scored = scored.withColumn("rank", F.row_number().over(split.orderBy(*order))).where(F.col("rank") <= top)
    return scored.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


# The same rows in SQL over the table ``documents``.
ORACLE = r"""
WITH pieces AS (
  SELECT lang, unnest(pieces) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents WHERE text IS NOT NULL)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS lp, array_to_string(list_slice(w, c + 1, k), ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS c FROM counts WHERE k > 1)),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.phrase = x.lp AND l.k = x.c JOIN counts r ON r.lang = x.lang AND r.phrase = x.rp AND r.k = x.k - x.c),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_of AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS phrase
    FROM (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k = 3)) GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_of o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.around IS NULL OR 100 * o.around < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
