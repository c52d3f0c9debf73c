"""Operators on pages, conversations and vectors; registered queries against their SQL; the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, chat, html_text, near_dup, pii, warc
from tidemark.llm.queries import ORACLE, QUERIES, tokenizer_path

SF_SMALL = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


# ---- WARC

BIG = "<p>" + "payload " * 400


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(1, "http://a.example/x y?q=ü", BIG), (2, None, BIG), (9, "http://a.example/", BIG), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"),
            (None, "u", BIG), (7, "u", "é" * 500), (8, "u", "é" * 500), (7, "u", "é" * 500), (10, "u", "x" * 100_000)]
    rows += [(100 + i, "u", f"<html>{i}" + "common text " * 90) for i in range(60)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("digest", "owner", "payload", "archive")})
    got = warc.archive_round_trip(df).collect()
    want = []
    for page, _, h in rows:
        b = (h or "").encode()
        same = [p for p, _, x in rows if x == h and p is not None]
        owner = max(same) if len(b) >= 1000 and len([1 for _, _, x in rows if x == h]) > 1 and max(same) != page else None
        want.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if owner else "response", owner))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None) == sorted(
        w for w in want if w[0] is not None)
    assert [r.refers_to for r in got if r.page_id is None] == [9]
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_dictionary_frame_and_damage(tmp_path):
    payloads = [f"<html><body>page {i} {'shared words ' * 50}</body></html>".encode() for i in range(200)]
    records = [warc.build_record(i, "http://h/", p, hashlib.sha1(p).hexdigest(), None, len(p)) for i, p in enumerate(payloads)]
    uri = str(tmp_path / "a.warc.zst")
    warc.write_archive(uri, records, warc.train(payloads))
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and data[8:12] == warc.FULL_DICT
    assert [b.partition(b"\r\n\r\n")[2] for _, b in warc.read_archive(uri)] == payloads
    warc.write_archive(uri, records[:1], b"")
    assert len(list(warc.read_archive(uri))) == 1


# ---- chat

HARD = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [[INST]]", "plain", "", None, "<|endoftext|> <s></s>", "é\n\n中文  x"]


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = ["<", "[", "/", "\\", "s>", "INST]", "x", "<s>", "[/INST]", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(m in e for m in chat.MARKS)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_chat_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK_TOKENS", chunk)
    rng = random.Random(chunk)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole"]), rng.choice(HARD)) for c in (*range(12), None) for t in (*range(rng.randint(1, 9)), None)]
    rows += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (50, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(0) for c in ("ids", "mask", "chunk")})
    got = {r.conv_id: r for r in chat.chat_round_trip(df, tokenizer_path()).collect()}
    least = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (least(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_round_trip(df.limit(0), tokenizer_path()).count() == 0


# ---- HTML

def site_page(i, body):
    return f"<html><head><title>t{i}</title><script>var a='</p>'</script></head><body><div class='top-{i}'>Welcome to the site</div>{body}<div class=legal>All rights kept</div>"


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, "http://h.example/x", site_page(i, f"<div class=body><h2>Title {i}</h2><p>Text {i} &amp; more<br>here</p></div>")) for i in range(12)]
    rows += [(50 + i, "http://few.example/", site_page(i, f"<p>alone {i}")) for i in range(2)]
    rows += [(60, None, "<p>no url"), (61, "http://h.example/", None), (62, "http://h.example/", ""), (63, "http://h.example/", "text &lt only"), (3, "http://h.example/x", rows[3][2])]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(0) for c in ("host", "nodes", "noise", "digest")})
    got = html_text.extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[4] == "Title 4\nText 4 & more here" and text[3] == "Title 3\nText 3 & more here"
    assert text[50] == "Welcome to the site\nalone 0\nAll rights kept" and text[60] == "no url" and text[61] == text[62] == ""
    assert text[63] == "text < only" and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_copies_of_one_article_stay(spark):
    rows = [(i, "http://c.example/", f"<body><nav>m{i}</nav><article><h1>Same</h1><p>Same text</article><footer>f{i}</footer>") for i in range(30)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"Same\nSame text"}


def test_rare_layouts_keep_their_text_on_a_large_host(spark):
    own = lambda i: hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    page = lambda i, cls, text: f"<body><div class=wrap><div class=legal>All rights kept</div><div class={cls}><p>{text} {i}</div></div>"
    rows = [(i, "http://big.example/", page(i, "body", "Common")) for i in range(3000)]
    rows += [(10_000 + i, "http://big.example/", page(i, "rare", "Rare")) for i in range(8)]
    rows += [(20_000 + i, "http://big.example/", f"<body class=post-{own(i)}><div class=text-{own(i)}><p>Slug {i}</div>") for i in range(8)]
    rows += [(30_000, "http://big.example/", page(0, "single", "Single"))]
    text = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert text[7] == "Common 7" and text[30_000] == "Single 0"
    assert all(text[10_000 + i] == f"Rare {i}" and text[20_000 + i] == f"Slug {i}" for i in range(8))


def test_parser_structure():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id=top class='cookie-notice'>We use cookies</div>
    <main><!-- x --><h2>Hello &amp; bye</h2><p>One <b>two\n three</b><p>Four &#39;x&#39;&nbsp; y<ul><li>a<li>b <ul><li>c</ul></ul><table><tr><td>1<td>2</table>
    <form>f</form><div class="comments"><p>c</div>a < b<style>p{}</style><aside>s</aside><p hidden>h</p></main><footer>x</footer><scr"""
    blocks, _ = html_text.parse(page)
    assert [t for _, _, t in blocks] == ["Hello & bye", "One two three", "Four 'x' y", "a", "b", "c", "1", "2", "a < b"]
    assert html_text.parse("<p>cut <a href=\"x")[0][0][2] == "cut" and html_text.parse("<" * 50)[0][0][2] == "<" * 50


def test_articles_are_judged_by_the_tree_too(spark):
    # Title and lead outside the article; a box in it that reads the same everywhere; a teaser article on a div page.
    rows = [(i, "http://a.example/", f"<body><div class=slogan>We print news</div><h1>Title {i}</h1><p class=lead>Lead {i}</p><article><p>Story {i} of some length"
             "<div class=box>Printed in Utopia</div></article>") for i in range(20)]
    rows += [(100 + i, "http://d.example/", f"<body><div class=slogan>We print news</div><div class=body><p>Story {i} of some length, told in a div</div>"
              "<article>Teaser</article>") for i in range(20)]
    text = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(text[i] == f"Title {i}\nLead {i}\nStory {i} of some length" and text[100 + i] == f"Story {i} of some length, told in a div" for i in range(20))


@pytest.mark.parametrize("wrapper", ["<div class='content has-sidebar'>", "<div class='page no-sidebar'>", "<main class='with-banner'>", "<div id='share-story'>",
                                     "<div class='sidebar'>", "<section class='page-header'>", "<span class=social>"])
@pytest.mark.parametrize("inside", ["<article class='post comments-open'><p>Story text of some length<div class=ad>Buy</div></article>", "<article class=related><p>Story text of some length</article>",
                                    "<div><p>Story text of some length</div>"])
def test_names_leave_out_no_main_text(wrapper, inside):
    page = f"<body><div class=cookie-notice>Cookies</div>{wrapper}{inside}</{wrapper[1:].split()[0]}><div class='share related'>More</div></body>"
    assert [t for _, _, t in html_text.parse(page)[0]] == ["Story text of some length"]


def test_names_leave_out_what_stands_beside_the_main_text():
    story, more = "<article><p>Story text of some length</article>", "<div class=related><article>Teaser</article></div>"
    assert [t for _, _, t in html_text.parse(story + more + "<p class=ad-2>Buy<p>a <b class=share>b</b> c")[0]] == ["Story text of some length", "a c"]
    assert [t for _, _, t in html_text.parse("<div class=ad>An advert longer than the article</div><article>Short</article>")[0]] == ["Short"]


# ---- vectors

VECTORS = "vec_id long, embedding array<float>"


def brute_neighbours(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), np.array(v, np.float64))
    out = {}
    for (i, t), v in good.items():
        if i % 50 == 0:
            near = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for (j, _), w in good.items() if j != i)
            out[i] = near[:k]
    return out


def test_neighbours_edges_are_exact_on_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(200)]
    hot = rows[50][1]
    rows += [(1000 + i, hot) for i in range(40)] + [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [None] + [1.0] * 7), (2200, [float("nan")] * 8), (2250, [1.0] * 5),
                                                    (None, hot), (1000, hot), (2300, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(0) for c in ("vector", "leaf", "rank")})
    got = ann.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()
    want = brute_neighbours(rows)
    assert {r.query_id for r in got} == set(want)
    for q, near in want.items():
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        np.testing.assert_allclose([r.score for r in own], [-s for s, _ in near], rtol=1e-12)
        if abs(near[0][0] + 1) < 1e-9:
            assert [r.vec_id for r in own] == sorted(j for s, j in near)
    assert ann.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:3], VECTORS), lambda i: i % 50 == 0).count() == 2


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    got = QUERIES["op10_rp_forest_neighbours"](spark, "/root/testdata/sf0.01").collect()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        true = set(ids[np.argsort(-near)[:5]].tolist())
        hits += len(true & {r.vec_id for r in got if r.query_id == ids[i]})
        total += 5
    assert hits >= 0.9 * total


# ---- registered queries and the pipeline

@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, duck, key):
    got = QUERIES[key](spark, SF_SMALL)
    want = duck.sql(ORACLE[key])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = sorted(map(str, (tuple(r) for r in got.select(*cols).collect())))
    assert rows == sorted(map(str, duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE[key]})").fetchall()))


def test_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    good = corpus_pipeline.keep_quality(spark, docs, SF_SMALL)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum(1 for d, l in labels.items() if l == (1, 0) and d in kept) >= 0.9 * sum(1 for l in labels.values() if l == (1, 0))
    once = corpus_pipeline.drop_near_duplicates(spark, docs, SF_SMALL)
    want = near_dup.near_duplicates(docs, percent=80)
    assert once.columns == docs.columns and once.count() == want.where("kept").count() == want.select("component_id").distinct().count()
    clean = corpus_pipeline.drop_leaks(spark, docs, SF_SMALL)
    leaks = QUERIES["op2_benchmark_decontamination"](spark, SF_SMALL).where("contaminated").count()
    assert clean.count() == docs.count() - leaks and leaks > 0
    new = corpus_pipeline.replace_personal_data(spark, docs, SF_SMALL)
    assert new.columns == docs.columns and new.count() == docs.count()
    assert not new.where(F.col("text").rlike(r"@mail[0-9]\.example")).count() and docs.where(F.col("text").rlike(r"@mail[0-9]\.example")).count()


def test_pipeline_runs(spark):
    packed = corpus_pipeline.run(spark, SF_SMALL)
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert rows and max(r.n for r in rows) <= 1024


def test_pii_plan_has_no_python(spark):
    plan = pii.replace_entities(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
