"""How the sources of a language differ in their vocabulary, on collapsed duplicate texts.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Identical texts of a
language are grouped first, with the number of copies of each source; each text is then split
into terms once, and adds its document frequencies and counts weighted by those numbers. A
language keeps the V terms that ``min_docs`` of its documents hold.

With count c of a term in a group (a source of a language, or the whole language) and N the
sum of c over kept terms: p = 1 + floor(10^9 (c + 2) / (N + 2 V)), and two groups differ at a
term by f(p, q) = floor((p - q)^2 / (p + q)). ``pair`` rows sum f over all kept terms for each
two sources of a language; ``term`` rows list the terms a source uses more than its language.

Pairs are evaluated sparsely. A term that neither of two sources holds differs by the constant
f(p0, q0); V times that is corrected by what the terms of one source change (added up per
distinct p, of which there are few) and by what the terms held by both change. So the work
grows with the entries of the term table, not with V times the square of the sources.

All numbers are integers and exact, for totals below 9 * 10^13. Null text, lang and source
count as empty; a source without terms has pairs too (0 if V is 0); repeated rows count each
time; an empty table gives no rows; extra columns are ignored. Texts are matched by SHA-256.
No group is collected but the sources of one text, term or language (the result has the square
of these).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, byte_class, materialise, slices, small, utf8

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
FLUSH = 2_000_000  # occurrences added up before they leave a task

LETTER = byte_class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def _flush(parts: list[tuple]) -> pa.RecordBatch:
    """Slices' counts (names of groups, vocabulary, group, term, count, docs) added up."""
    names = sorted({x for p in parts for x in p[0]})
    place = {x: i for i, x in enumerate(names)}
    vocabulary, back = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    text = pa.concat_arrays([p[2] for p in parts])
    first = np.zeros(len(vocabulary), np.int64)
    first[back[::-1]] = np.arange(len(back))[::-1]
    base = np.cumsum([0] + [len(p[1]) for p in parts])
    group = np.concatenate([np.array([place[x] for x in p[0]], np.int64)[p[3]] for p in parts])
    term = np.concatenate([back[base[i] + p[4]] for i, p in enumerate(parts)])
    key = group * max(1, len(vocabulary)) + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count, docs = (np.add.reduceat(np.concatenate([p[i] for p in parts])[order], at) for i in (5, 6))
    group, term = key[at] // max(1, len(vocabulary)), key[at] % max(1, len(vocabulary))
    lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(group)) for i in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, text.take(pa.array(first[term])).cast(pa.string()), pa.array(count), pa.array(docs)],
                                      names=["lang", "source", "term", "c", "d"])


def _slice_counts(langs: list[str], blobs: list[bytes], copies: list[list[dict]]) -> tuple:
    w = Words(blobs, LETTER)
    vocabulary, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.buf.tobytes()
    text = pa.array([raw[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], pa.binary())
    v = max(1, len(vocabulary))
    pair, n = np.unique(w.doc * v + ids, return_counts=True)
    doc, term = pair // v, pair % v
    # Each distinct (text, term) once for each source of the text.
    own = [(lang, x["source"]) for lang, xs in zip(langs, copies, strict=True) for x in xs]
    times = np.array([x["n"] for xs in copies for x in xs], np.int64)
    width = np.array([len(xs) for xs in copies], np.int64)
    start = np.concatenate(([0], np.cumsum(width)))[:-1]
    names = sorted(set(own))
    place = {x: i for i, x in enumerate(names)}
    code = np.array([place[x] for x in own], np.int64)
    many = width[doc]
    row = np.repeat(np.arange(len(pair)), many)
    at = start[doc][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    key, back = np.unique(code[at] * v + term[row], return_inverse=True)
    count, docs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    np.add.at(count, back, n[row] * times[at])
    np.add.at(docs, back, times[at])
    return names, vocabulary, text, key // v, key % v, count, docs


def _term_counts(batches):
    parts, size = [], 0
    for b in small(batches):
        langs, blobs, copies = b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()
        for lo, hi in slices(blobs):
            part = _slice_counts(langs[lo:hi], blobs[lo:hi], copies[lo:hi])
            if len(part[3]):
                parts.append(part)
                size += len(part[3])
            if size >= FLUSH:
                yield _flush(parts)
                parts, size = [], 0
    if parts:
        yield _flush(parts)


def _both(p, q):
    return (p - q) * (p - q) // (p + q)


def _common_terms(batches):
    """For each two sources that share terms, what these change against the one-sided sums."""
    for b in small(batches, 4096):
        lists = b.column(1)
        entries = lists.flatten()
        n = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(n)), n)
        langs = b.column(0).to_pylist()
        groups = [(langs[i], s) for i, s in zip(owner.tolist(), entries.field(0).to_pylist(), strict=True)]
        names = sorted(set(groups))
        place = {x: i for i, x in enumerate(names)}
        code = np.array([place[x] for x in groups], np.int64)
        p, p0 = (entries.field(i).to_numpy() for i in (1, 2))
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, size = [], 0
        widest = int(n.max()) if len(n) else 0
        for step in range(1, widest + 1):
            if step < widest:
                a = np.flatnonzero(owner[:-step] == owner[step:])
                z = a + step
                value = _both(p[a], p[z]) - _both(p[a], p0[z]) - _both(p0[a], p[z]) + _both(p0[a], p0[z])
                waiting.append((np.minimum(code[a], code[z]) * len(names) + np.maximum(code[a], code[z]), value))
                size += len(a)
            if waiting and (size > 1 << 21 or step == widest):
                keys, back = np.unique(np.concatenate([keys, *(x for x, _ in waiting)]), return_inverse=True)
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, back, np.concatenate([sums, *(x for _, x in waiting)]))
                sums, waiting, size = total, [], 0
        one, other = [names[k] for k in (keys // max(1, len(names))).tolist()], [names[k] for k in (keys % max(1, len(names))).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in one], pa.string()), pa.array([x[1] for x in one], pa.string()),
                                          pa.array([x[1] for x in other], pa.string()), pa.array(sums)], names=["lang", "source", "item", "v"])


def _p(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 (count + 2) / whole) by long division in two steps, within 64 bits."""
    c = count + F.lit(2)
    first = c % whole * F.lit(100_000)
    second = first % whole * F.lit(10_000)
    return F.lit(1) + _div(c, whole) * F.lit(SCALE) + _div(first, whole) * F.lit(10_000) + _div(second, whole)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def collapse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(texts, copies): each different text of a language once (lang, digest, text), and the rows
    of each source that hold it (lang, digest, source, n)."""
    clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    base = docs.select(*clean).withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = materialise(base.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n")), "copies")
    return base.groupBy("lang", "digest").agg(F.first("text").alias("text")), copies


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    texts, copies = collapse(docs, text_col, lang_col, source_col)
    sources = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    split = texts.join(sources, ["lang", "digest"]).select("lang", "text", "copies")
    counted = split.mapInArrow(_term_counts, "lang string, source string, term string, c long, d long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    # Dealt by term as plain rows (at most one a source): half the size of partly collected lists.
    terms = counted.repartition("lang", "term").groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("c").alias("all"), F.collect_list(F.struct("source", "c")).alias("own"))
    terms = materialise(terms.where(F.col("d") >= min_docs).drop("d"), "terms")

    entries = terms.select("lang", F.explode("own").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("whole"))
    groups = copies.select("lang", "source").distinct().join(entries, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), "whole",
                           (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("size"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("size"))))
    groups = materialise(groups, "groups")

    # Every entry of the term table as p, with the p that its source gives to absent terms.
    by_lang = groups.where("v > 0").groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", F.struct("size", "p0")))).alias("of"), F.first(F.col("whole") + 2 * F.col("v")).alias("base"))
    rated = terms.join(by_lang, "lang").select(
        "lang", "term", _p(F.col("all"), F.col("base")).alias("q"),
        F.transform("own", lambda x: F.struct(x["source"].alias("source"), _p(x["c"], F.col("of")[x["source"]]["size"]).alias("p"),
                                              F.col("of")[x["source"]]["p0"].alias("p0"))).alias("own"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    constant = groups.join(other, "lang").where("source != item").select(
        "lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _f(F.col("p0"), F.col("q0"))).otherwise(0).alias("v"))
    levels = rated.select("lang", F.explode("own").alias("x")).groupBy("lang", "x.source", "x.p", "x.p0").agg(F.count(F.lit(1)).alias("n"))
    one_sided = levels.join(other, "lang").where("source != item").select(
        "lang", "source", "item", (F.col("n") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))).alias("v"))
    common = rated.select("lang", "own").mapInArrow(_common_terms, "lang string, source string, item string, v long")
    common = common.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    directed = one_sided.unionByName(common)
    swapped = directed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    pairs = constant.unionByName(directed).unionByName(swapped).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))

    own = rated.select("lang", F.col("term").alias("item"), "q", F.explode("own").alias("x")).where("x.p > q")
    own = own.select("lang", "x.source", "item", _f(F.col("x.p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    parts = [d.withColumn("rank", place).withColumn("part", F.lit(part)) for d, part in ((pairs, "pair"), (own, "term"))]
    parts[1] = parts[1].where(F.col("rank") <= top)
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


# The same rows in SQL over the table ``documents``, with every kept term in every group.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
occ AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v, coalesce(t.n, 0) + 2 * coalesce(s.v, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s ON s.lang = g.lang
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) t ON t.lang = g.lang AND t.source = g.source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // g.size AS HUGEINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (s.n + 2 * s.v) AS HUGEINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_values v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
