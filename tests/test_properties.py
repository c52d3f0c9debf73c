"""Property tests: invariants of the marts and exactness of the distributed operators."""

import difflib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.operators.aggregates import CROSS_PAIRS, cross_marts, detail_for_cross, group_two_dims
from tidemark.functions.similarity import block_ratio
from tidemark.operators.search import (
    LANGUAGE_ALIASES,
    MONTH_ALIASES,
    PLATFORM_ALIASES,
    alias_normalise,
    alias_table,
    alias_terms,
    entity_bands,
    entity_catalogue,
    fuzzy_match,
    question_terms,
    questions,
    similarity_topk,
    tokenise,
)
from tidemark.plans.kpi import totals
from tidemark.plans.marts import marts_for
from tidemark.plans.star import dense_ids
from tidemark.sources.domain import Domain


def test_published_never_exceeds_created(spark):
    dom = Domain(spark, SF_SMALL)
    for name in ("users", "channels", "input_types", "channel_user"):
        assert marts_for(dom, name).where(F.col("published_count") > F.col("created_count")).count() == 0


def test_dimension_sums_equal_global_totals(spark):
    dom = Domain(spark, SF_SMALL)
    t = totals(dom).first()
    for name in ("users", "input_types", "languages", "teams"):
        s = marts_for(dom, name).agg(F.sum("uploaded_count"), F.sum("created_count"), F.sum("published_count")).first()
        assert tuple(s) == (t["total_uploaded"], t["total_created"], t["total_published"])
    ch = marts_for(dom, "channels").agg(F.sum("created_count")).first()[0]
    assert ch == t["total_created"]


def test_grouping_sets_equal_separate_group_bys(spark):
    dom = Domain(spark, SF_SMALL)
    x = cross_marts(dom)
    detail = detail_for_cross(dom)
    for a, b in CROSS_PAIRS:
        one = x.where(F.col("pair") == f"{a}|{b}").select(F.col("d1").alias(a), F.col("d2").alias(b), "created_count", "published_count")
        two = group_two_dims(detail, a, b).select(a, b, "created_count", "published_count")
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz", min_size=0, max_size=4), min_size=1, max_size=60))
def test_dense_ids_equal_dense_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k string").repartition(3)
    got = {r["k"]: r["id"] for r in dense_ids(df, ["k"], "id", checkpoint=False).collect()}
    want = {v: i + 1 for i, v in enumerate(sorted(set(values)))}
    assert got == want


words = st.text(alphabet="abcdé 1", max_size=9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=12), st.sampled_from([0.0, 0.7, 0.85]))
def test_block_ratio_equals_difflib(pairs, cutoff):
    got = block_ratio([a for a, _ in pairs], [b for _, b in pairs], cutoff)
    for (a, b), r in zip(pairs, got, strict=True):
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert r == want if want >= cutoff else r < cutoff


def test_block_ratio_of_long_strings():
    rng = random.Random(4)
    a = ["".join(rng.choices("abcdefghij", k=rng.randint(100, 190))) for _ in range(20)]
    b = [x[20:] + "".join(rng.choices("abcdefghij", k=9)) for x in a]
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert np.array_equal(block_ratio(a, b, 0.7), want)


def plain_matches(tokens, values, low=0.70, top=3):
    """(token, value, rank) by difflib's close matches."""
    lower = {v.lower(): v for v in sorted(values)}
    return {(t, lower[m], i) for t in tokens for i, m in enumerate(difflib.get_close_matches(t, list(lower), n=top, cutoff=low), 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcdeB", min_size=1, max_size=7), min_size=1, max_size=25),
       st.lists(st.text(alphabet="abcdeB", min_size=1, max_size=7), min_size=1, max_size=25))
def test_fuzzy_match_equals_difflib(spark, tokens, values):
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    c = spark.createDataFrame([("L", v) for v in set(values)], "label string, value string")
    got = {(r["token"], r["value"], r["rank"]) for r in fuzzy_match(t, c).collect()}
    assert got == plain_matches(set(tokens), set(values))


def test_fuzzy_match_of_all_tokens_and_values(spark):
    dom = Domain(spark, SF_SMALL)
    tokens, catalogue = tokenise(questions(dom)), entity_catalogue(dom)
    got = {(r["token"], r["label"], r["value"], r["rank"]) for r in fuzzy_match(tokens, catalogue).collect()}
    values = {}
    for r in catalogue.collect():
        values.setdefault(r["label"], set()).add(r["value"])
    assert set(values) == {"User", "Channel", "Platform", "Input Type", "Output Type", "Language", "Month"}
    distinct = {r["token"] for r in tokens.collect()}
    assert got == {(t, label, v, i) for label, vs in values.items() for t, v, i in plain_matches(distinct, vs)}


def plain_terms(tokens, known):
    """A question's tokens with the values that aliases add: months, then languages, then platforms."""
    def close(token, aliases, cutoff):
        if token in aliases:
            return aliases[token]
        m = difflib.get_close_matches(token, list(aliases), n=1, cutoff=cutoff)
        return aliases[m[0]] if m else None

    years = [t for t in tokens if len(t) == 4 and t.isdigit() and t.startswith("20")]
    months = [m for m in (close(t, MONTH_ALIASES, 0.75) for t in tokens) if m]
    labels = [f"{m}, {y}" for m in months for y in years] if years else [k for m in months for k in sorted(known) if k.startswith(m + ",")]
    languages = [c for c in (close(t, LANGUAGE_ALIASES, 0.80) for t in tokens) if c]
    return list(dict.fromkeys([*tokens, *labels, *languages, *(PLATFORM_ALIASES[t] for t in tokens if t in PLATFORM_ALIASES)])), set(months)


def plain_bands(terms, catalogue):
    out = {}
    for label, values in catalogue.items():
        high, low = ([x for t in terms for x, _ in sorted(((v, i) for u, v, i in plain_matches([t], values, cutoff)), key=lambda p: p[1])]
                     for cutoff in (0.85, 0.70))
        best = ("high", high) if high else ("low", low) if low else ("none", [])
        out[label] = (best[0], ", ".join(list(dict.fromkeys(best[1]))[:3]))
    return out


ASKED = ["janury", "febuary", "marc", "engish", "hindi", "hndi", "yt", "insta", "twiter", "x", "spansh", "arabc", "octobr", "decmber",
         "mixd", "2024", "2025", "junee", "may", "foo", "facebok", "youtub", "customr"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ASKED), min_size=1, max_size=6, unique=True), min_size=1, max_size=4))
def test_terms_and_bands_equal_difflib(spark, asked):
    known = ["May, 2024", "Jan, 2025", "Jan, 2024", "Oct, 2023"]
    catalogue = {"Platform": {"YouTube", "Facebook", "Instagram", "X"}, "Language": {"en", "hi", "mix"}, "Month": set(known), "User": {"Customer#1", "customers"}}
    toks = spark.createDataFrame([(i, 1, p, w) for i, ws in enumerate(asked) for p, w in enumerate(ws)], "conv_id int, turn int, pos int, token string")
    months = spark.createDataFrame([(k,) for k in known], "label string")
    values = spark.createDataFrame([(l, v) for l, vs in catalogue.items() for v in vs], "label string, value string")
    added = alias_terms(toks, alias_table(spark), months)
    terms = question_terms(toks, added)
    got = {}
    for r in terms.collect():
        got.setdefault(r["conv_id"], []).append((r["place"], r["token"]))
    bands = {}
    for r in entity_bands(terms, fuzzy_match(terms, values), tuple(catalogue)).collect():
        bands.setdefault(r["conv_id"], {})[r["label"]] = (r["confidence"], r["matches"])
    normal = {(r["conv_id"], r["canonical"]) for r in alias_normalise(toks, alias_table(spark), months).where("kind = 'month'").collect()}
    for i, ws in enumerate(asked):
        want, abbreviations = plain_terms(ws, known)
        assert {t for _, t in got[i]} == set(want)
        assert bands[i] == plain_bands([t for _, t in sorted(got[i])], catalogue)
        assert {c for j, c in normal if j == i} == abbreviations
        if not any(w.startswith("20") for w in ws):
            assert [t for _, t in sorted(got[i])][: len(ws)] == ws


def test_two_stage_topk_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, i % 10, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = e.where(F.col("vec_id") < 5).select(F.col("vec_id").alias("q_id"), "embedding")
    got = {(r["q_id"], r["type"], r["vec_id"]) for r in similarity_topk(e, q, min_sim=-1.0).collect()}
    vecs = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, _, v in rows}
    want = set()
    for qi in range(5):
        for t, k in ((0, 4), (1, 3), (2, 3)):
            cands = [(-(vecs[i] @ vecs[qi]) / (np.linalg.norm(vecs[i]) * np.linalg.norm(vecs[qi])), i)
                     for i, lab, _ in rows if lab % 3 == t]
            want |= {(qi, t, i) for _, i in sorted(cands)[:k]}
    assert got == want
