"""Collocations, source audit and language identification against plain versions; edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import collocations, language_id, source_audit

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["phrase", "term", "digest", "copies", "row", "k", "a", "n", "words", "chunk", "rank", "part", "value"]
LONG = " ".join(f"word{i % 97} of the{i % 7}{'.' if i % 11 == 0 else ''}" for i in range(40_000))
EDGES = [(1, None, None, None), (2, "", "en", ""), (3, " \t\n.,;", "en", "a"), (4, "One", None, "a"), (5, LONG, "en", "a"), (5, LONG, "en", "a"),
         (5, LONG, "en", None), (None, "ünï çode 中文 words", "fr", "b"), (6, "x" * 50_000, "de", "b"), (7, "12 34 !?", "de", "c"), (8, "a a a a a. a a\ta", "en", "c")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def zipf_rows(n, seed=5, langs=("en", "fr", None)):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["New York", "of the", "in front of"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        body = "".join(w + rng.choice([" ", " ", " ", "  ", ". ", "\n", "\t"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((i, body, rng.choice(langs), rng.choice(["s0", "s0", "s0", "s1", "s2", None])))
    return rows + rows[: n // 5] + rows[:3] * 20


# --- collocations


def plain_collocations(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in count.items() if a >= least and len(g[1]) > 1}
    best = []
    for (lang, w), a in found.items():
        if any(len(v) > len(w) and m == lang and 100 * b >= 50 * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in found.items()):
            continue
        options = [(10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(options)
        best.append((lang, -score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    out, at = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(best):
        at[lang] += 1
        if at[lang] <= top:
            out.append((lang, at[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"chunk_bytes": 600, "partition_mass": 500}])
def test_collocations_match_counting(spark, bounds):
    rows = zipf_rows(150) + EDGES[:4] + EDGES[7:]
    got = collocations.collocations(frame(spark, rows), least=4, top=40, **bounds)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, 40)


def test_counted_phrases_are_sent_packed():
    """A row for each hash partition and language, of phrases in order; it was a row a phrase."""
    rows = [("en", b"a b c a b. C a b"), ("fr", b"a b a b")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1].decode() for r in rows])], names=["lang", "text"])
    row = next(collocations._chunks(1000)(iter([batch]))).to_pylist()[0]
    c = collocations._open(row, 2, 3)
    bits = [np.packbits(np.ones(c.edges[p + 1] - c.edges[p], bool)).tobytes() for p in range(2)]
    row["answers"] = [{"part": p, "bits": zstandard.compress(b)} for p, b in enumerate(bits)]
    sent = pa.Table.from_batches(collocations._count(2, 3)(iter([pa.RecordBatch.from_pylist([row])] * 2)))
    assert sent.num_rows <= 2 * 2 * 2  # chunks, partitions, languages
    got = {}
    for part, lang in {(r["part"], r["lang"]) for r in sent.to_pylist()}:
        own = sent.filter((pc.field("part") == part) & (pc.field("lang") == lang))
        for r in collocations._sum(4)((pa.scalar(part), pa.scalar(lang)), own).to_pylist():
            assert (r["lang"], r["phrase"]) not in got and r["k"] == len(r["phrase"].split())
            got[r["lang"], r["phrase"]] = r["a"]
    assert got == {("en", "a"): 6, ("en", "b"): 6, ("en", "c"): 4, ("en", "a b"): 6, ("en", "c a"): 4, ("en", "c a b"): 4, ("fr", "a"): 4, ("fr", "b"): 4, ("fr", "a b"): 4}


def test_collocations_edges(spark):
    rows = EDGES
    got = collocations.collocations(frame(spark, rows), chunk_bytes=100_000).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 10, 2000)
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_long_texts_are_cut_between_pieces():
    blob = b"a b c. d e f g h i; jjjjjjjjjjjjjjjjjjjj k l, m"
    parts = list(collocations._cut(blob, 8))
    assert b"".join(parts) == blob and len(parts) > 2
    assert all(p[-1:] in b".,;" for p in parts[:-1])


@pytest.mark.parametrize("seed", range(20))
def test_misra_gries_keeps_what_is_frequent(seed):
    """Merged in any order and batches, no item with ``least`` occurrences is lost, and the
    error stays below it."""
    rng = np.random.default_rng(seed)
    items = np.minimum(rng.zipf(1.3, 5000), 3000).astype(np.uint32)
    least = int(rng.integers(2, 60))
    summary = collocations.MisraGries(len(items) // least + 1)
    for part in np.array_split(items, 17):
        half = collocations.MisraGries(summary.capacity)
        half.merge(*np.unique(part, return_counts=True))
        assert half.error == 0 or len(half.keys) <= half.capacity
        summary.merge(half.keys, half.counts.astype(np.int64), half.error)
        assert len(summary.keys) <= summary.capacity
    assert summary.error < least
    true = collections.Counter(items.tolist())
    assert {k for k, n in true.items() if n >= least} <= set(summary.frequent(least).tolist())
    assert all(true[k] - summary.error <= n <= true[k] for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))


# --- source audit


def plain_audit(rows, min_docs, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for _, _, w in own for t in set(w))
        kept = [t for t, n in df.items() if n >= min_docs]
        count = collections.defaultdict(collections.Counter)
        for _, source, w in own:
            count[source].update(t for t in w if df[t] >= min_docs)
        whole = sum(count.values(), collections.Counter())

        def p(c):
            size = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // size for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in ps:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in ps if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if count[s][t] and ps[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 10])
def test_audit_matches_dense_sums(spark, monkeypatch, min_docs):
    monkeypatch.setattr(source_audit, "FLUSH", 50)
    rows = zipf_rows(200, seed=8) + EDGES
    got = source_audit.audit(frame(spark, rows), min_docs=min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, min_docs)


def test_audit_edges(spark):
    assert source_audit.audit(frame(spark, [])).count() == 0
    rows = [(1, None, None, None), (2, "12 34", "", "x"), (3, "few words", "en", "y"), (4, "few words", "en", "z")]
    got = source_audit.audit(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 10)
    assert {r.value for r in got.collect()} == {0}


def test_texts_are_collapsed_once(spark):
    rows = [(i, "same text here", "en", f"s{i % 3}") for i in range(30)] + [(99, "same text here", "fr", "s0")]
    texts, copies = source_audit.collapse(frame(spark, rows))
    assert texts.count() == 2
    assert sorted((r.lang, r.source, r.n) for r in copies.collect()) == [("en", "s0", 10), ("en", "s1", 10), ("en", "s2", 10), ("fr", "s0", 1)]


# --- language identification

SYLLABLES = {"aa": "ka no mi su to re wa ta ni ha", "bb": "sch ein ung der ich auf keit ver ge zu", "cc": "ción que los ada ente mos ía por el ñ",
             "dd": "при во ста ние ого ать сть ли не ко", "ee": "the ing tion and of er ly ness con pre", "ff": "eau oux ais é le des ment que un ér",
             "gg": "ij oo een van het de lijk aar uu ui", "hh": "του και να ση με ας ον ι ρα κα"}


def language_rows(langs, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = langs[0] if rng.random() < 0.3 else rng.choice(langs)
        s = SYLLABLES[lang].split()
        words = ["".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words).capitalize() + rng.choice([".", " 2024!", ""]), lang, "s"))
    return rows


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa", "bb", "cc", "ee"], list(SYLLABLES)])
def test_languages_of_held_out_texts(spark, langs):
    rows = language_rows(langs, 400)
    # Labels of held-out rows must not matter.
    poisoned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, poisoned)).collect()}
    for i, _, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if got[i].held_out]
    assert len(held) > 60
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_language_edges(spark):
    rows = language_rows(["aa", "ee"], 60) + [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 !? 34 \U0001f600", "aa", ""), (None, "kanomi suto", "zz", ""),
                                              (1003, "ab", None, ""), (1004, " ".join(["kanomi suto rewa"] * 40_000), "aa", ""), (1005, "ка", None, "")]
    rows += rows[:5]
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].ambiguous) == ("und", 0.0, True)
    assert by_id[None].held_out is False and by_id[None].lang_pred == "aa"  # its own label isn't learned
    assert by_id[1004].lang_pred == "aa"
    assert by_id[1005].ambiguous  # no known n-gram
    assert language_id.identify(frame(spark, [])).count() == 0
    none = language_id.identify(frame(spark, [(1, "some words", None, "")])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    one = language_id.identify(frame(spark, [(i, "some words", "en", "") for i in range(8)])).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6, 7, 12, 60])
def test_codewords(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n and len({tuple(x) for x in code.tolist()}) == (n if n != 1 else 1)
    if n > 1:
        assert all(len(set(c)) == 2 for c in code.T.tolist())
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert least >= max(1, code.shape[1] // 4)


def test_ngrams_stay_within_texts():
    blobs = [b"Ab cd", b"", b"x", "é!! zz".encode(), b"   "]
    alone = [[b[e[0] : e[1]].tolist() for b, e in language_id.ngrams([t])] for t in blobs]
    together = language_id.ngrams(blobs)
    for i in range(len(blobs)):
        assert [b[e[i] : e[i + 1]].tolist() for b, e in together] == alone[i]


def test_wrong_bits_are_corrected():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.zeros((code.shape[1], 1)))
    for i in range(4):
        for wrong in range(code.shape[1]):
            margins = code[i].astype(float)
            margins[wrong] *= -1
            best, score = model.decode(margins[None])
            assert best[0] == i and score[0] > 0
    best, score = model.decode(np.zeros((1, code.shape[1])))
    assert best[0] == 0 and score[0] == 0
