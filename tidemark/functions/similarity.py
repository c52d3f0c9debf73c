"""Matching-block similarity of short strings (survey V02, V04), exact and vectorised.

The ratio of strings a and b is 2 M / (len a + len b), where M adds up the longest common block
(the earliest in a, then in b, of equal ones) and, in turn, those of the parts left and right of
it. It is not symmetric: a is the known value, b the word looked up. Characters that are frequent
in very long words are not set aside.

Candidates are found by two upper bounds before the blocks are: the lengths alone give
2 min / (la + lb), and the characters in common, however ordered, give 2 C / (la + lb). Pairs of
many strings are made from the counts of character classes that occur (``candidate_pairs``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 22  # cells of a block search at a time


def length_window(length: Column, cutoff: float) -> Column:
    """Lengths that a string may have to reach ``cutoff`` with one of ``length`` characters:
    2 min / (la + lb) >= c means la c / (2 - c) <= lb <= la (2 - c) / c."""
    lo = F.ceil(length * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-9)).cast("int")
    hi = F.floor(length * F.lit((2 - cutoff) / cutoff) + F.lit(1e-9)).cast("int")
    return F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, F.lit(1)))


# Classes of characters that a string is summed up by; all others are one more class.
CLASSES = ["0123456789", "ae", "io", "u", "t", "n", "s", "r", "hl", "dc", "mg", "pf", "kyz"]


def class_counts(c: Column) -> Column:
    """How many characters of each class a string has: an array, all other characters last."""
    counts = [F.length(c) - F.length(F.translate(c, x, "")) for x in CLASSES]
    return F.array(*[n.cast("smallint") for n in counts], F.length(F.translate(c, "".join(CLASSES), "")).cast("smallint"))


def common_at_most(a: Column, b: Column) -> Column:
    """The most characters that strings with these class counts can have in common."""
    return sum((F.least(a[i], b[i]).cast("int") for i in range(1, len(CLASSES) + 1)), F.least(a[0], b[0]).cast("int"))


def candidate_pairs(a: DataFrame, b: DataFrame, left: str, right: str, cutoff: float) -> DataFrame:
    """Rows of ``a`` next to rows of ``b`` whose strings ``left`` and ``right`` (of one character at
    least) may reach ``cutoff``; no pair that does is left out.

    Strings with the same class counts are alike here, so the counts that occur are compared first
    (joined on the lengths that the cutoff allows), and only counts that may reach it lead to
    rows: what is compared grows with the different counts, not with rows times rows."""
    a = a.withColumn("_ca", class_counts(F.col(left)))
    b = b.withColumn("_cb", class_counts(F.col(right)))
    ca = a.groupBy("_ca").agg(F.max(F.length(left)).alias("_la"))
    cb = b.groupBy("_cb").agg(F.max(F.length(right)).alias("_lb"))
    near = ca.select("_ca", "_la", F.explode(length_window(F.col("_la"), cutoff)).alias("_lb")).join(cb, "_lb")
    near = near.where(2 * common_at_most(F.col("_ca"), F.col("_cb")) >= F.lit(cutoff) * (F.col("_la") + F.col("_lb")) - F.lit(1e-9))
    return a.join(near.select("_ca", "_cb"), "_ca").join(b, "_cb").drop("_ca", "_cb")


def _codes(strings: list[str], empty: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters as a padded matrix, and lengths."""
    lens = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), max(1, int(lens.max(initial=0)))), empty, np.int64)
    inside = np.arange(out.shape[1]) < lens[:, None]
    out[inside] = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lens


def common_characters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters that two padded strings share, counted with repetition: the k-th x of one
    meets the k-th x of the other."""
    def numbered(x):
        order = np.argsort(x, axis=1, kind="stable")
        s = np.take_along_axis(x, order, 1)
        at = np.arange(x.shape[1])
        new = np.ones(s.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        start = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        return np.where(s >= 0, s * (1 << 20) + (at - start), s)

    both = np.sort(np.concatenate((numbered(a), numbered(b)), axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)).sum(axis=1)


def matching_characters(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """M for each row: all open parts of all rows are searched at once, one character of a at a time."""
    total = np.zeros(len(a), np.int64)
    row, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros(len(a), np.int64), la.copy(), np.zeros(len(a), np.int64), lb.copy()
    at_b = np.arange(b.shape[1])
    while len(row):
        best, best_i, best_j = (np.zeros(len(row), np.int64) for _ in range(3))
        inside = (at_b >= blo[:, None]) & (at_b < bhi[:, None])
        chars = b[row]
        run = np.zeros((len(row), b.shape[1] + 1), np.int64)  # run[:, j + 1]: block ending at (i, j)
        for i in range(int(alo.min()), int(ahi.max())):
            same = inside & (chars == a[row, i][:, None]) & ((i >= alo) & (i < ahi))[:, None]
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            j = run[:, 1:].argmax(axis=1)
            size = run[np.arange(len(row)), j + 1]
            more = size > best
            best[more], best_i[more], best_j[more] = size[more], i + 1 - size[more], j[more] + 1 - size[more]
        np.add.at(total, row, best)
        ok = best > 0
        row, alo, ahi, blo, bhi, best, best_i, best_j = (x[ok] for x in (row, alo, ahi, blo, bhi, best, best_i, best_j))
        row, alo, ahi, blo, bhi = (np.concatenate(x) for x in (
            (row, row), (alo, best_i + best), (best_i, ahi), (blo, best_j + best), (best_j, bhi)))
        ok = (alo < ahi) & (blo < bhi)
        row, alo, ahi, blo, bhi = (x[ok] for x in (row, alo, ahi, blo, bhi))
    return total


def block_ratio(a: list[str], b: list[str], cutoff: float = 0.0) -> np.ndarray:
    """The ratio of each pair; 0 where an upper bound shows that it is below ``cutoff``."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    order = np.argsort([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], kind="stable").tolist()
    at = 0
    while at < len(order):  # pairs of like length together, a bounded number of cells
        width = max(len(a[order[at]]), len(b[order[at]]), 1)
        own = order[at : at + max(1, CELLS // (width * width))]
        at += len(own)
        x, lx = _codes([a[i] for i in own], -1)
        y, ly = _codes([b[i] for i in own], -2)
        whole = np.maximum(lx + ly, 1)
        ok = np.flatnonzero(2 * common_characters(x, y) >= cutoff * whole - 1e-9)
        found = np.zeros(len(own))
        found[ok] = 2.0 * matching_characters(x[ok], lx[ok], y[ok], ly[ok]) / whole[ok]
        found[(lx + ly) == 0] = 1.0
        out[own] = found
    return out


def block_similarity(a: Column, b: Column, cutoff: float) -> Column:
    """``block_ratio`` as a column (Arrow batches); pairs below the cutoff may give 0."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(block_ratio(x.tolist(), y.tolist(), cutoff))

    return ratio(a, b)


def _best_sql(alo: str, ahi: str, blo: str, bhi: str) -> str:
    return f"""list_max(flatten([[{{'n': list_max([n for n in range(0, least({ahi} - i, {bhi} - j) + 1) if substr(a, i + 1, n) = substr(b, j + 1, n)]),
      'i': -i, 'j': -j}} for j in range({blo}, {bhi})] for i in range({alo}, {ahi})]))"""


def block_ratio_sql(pairs: str, cutoff: float) -> list[tuple[str, str]]:
    """The same ratio in DuckDB: named subqueries of which ``<pairs>_ratio`` has (a, b, s) for
    the pairs (a, b) of ``pairs`` that reach ``cutoff``. Needs WITH RECURSIVE."""
    chars = "list_distinct(string_split(b, ''))"
    common = f"list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) for c in {chars}])"
    return [
        (f"{pairs}_near", f"""SELECT a, b FROM (SELECT DISTINCT a, b FROM {pairs}
             WHERE length(a) > 0 AND length(b) > 0 AND 2.0 * least(length(a), length(b)) >= {cutoff} * (length(a) + length(b)) - 1e-9) x
           WHERE 2.0 * {common} >= {cutoff} * (length(a) + length(b)) - 1e-9"""),
        (f"{pairs}_blocks", f"""SELECT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo, length(b)::BIGINT AS bhi,
             {_best_sql('0', 'length(a)', '0', 'length(b)')} AS m FROM {pairs}_near
           UNION ALL
           SELECT a, b, alo, ahi, blo, bhi, {_best_sql('alo', 'ahi', 'blo', 'bhi')} AS m FROM (
             SELECT a, b, p.alo AS alo, p.ahi AS ahi, p.blo AS blo, p.bhi AS bhi FROM (
               SELECT a, b, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}},
                                    {{'alo': m.n - m.i, 'ahi': ahi, 'blo': m.n - m.j, 'bhi': bhi}}]) AS p FROM {pairs}_blocks WHERE m.n > 0) c
             WHERE p.alo < p.ahi AND p.blo < p.bhi) d"""),
        (f"{pairs}_ratio", f"""SELECT a, b, 2.0 * SUM(m.n) / (length(a) + length(b)) AS s FROM {pairs}_blocks
           GROUP BY a, b HAVING 2.0 * SUM(m.n) / (length(a) + length(b)) >= {cutoff}"""),
    ]
