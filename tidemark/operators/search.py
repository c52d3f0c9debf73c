"""Text search, entity matching and similarity retrieval as Spark joins (survey §2.13, V01–V09).

* Tokenising is ``regexp_extract_all`` + ``explode`` on whole texts (no prefixes, no caps).
* Alias normalisation is an equi-join against small fixed alias tables (broadcast: their
  size is fixed by the lists below); close matches join on the alias lengths the cutoff allows.
* Close matches and entity matching compare distinct tokens with distinct aliases or catalogue
  values by the matching-block ratio (``functions/similarity.py``). Candidate pairs are
  generated EXACTLY, by equi-joins and without a nested loop: for the alias lists on the lengths
  that the cutoff allows, for the catalogue on the counts of character classes that may reach it;
  no pair that could reach the cutoff is skipped, and common characters rule out most of the rest
  before any blocks are searched.
* Cosine top-k: the query vectors (one centroid per label, derived from the whole table) meet
  the stored vectors in blocks of ``QUERY_BLOCK``, each one array value scored where a vector is
  read; the ranking's literal limit prunes every task's rows before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import round_half_up, round_sql, with_scalars
from tidemark.functions.similarity import block_ratio_sql, block_similarity, candidate_pairs, length_window
from tidemark.registry import query
from tidemark.session import scratch_dir
from tidemark.sources.domain import Domain, oracle

# ---------------------------------------------------------------------------------
# Fixed values (stop words and alias tables of the reference's question normaliser)
# ---------------------------------------------------------------------------------
STOPWORDS = [
    "a", "an", "the", "is", "are", "how", "give", "me", "show", "about", "for", "any", "info", "information", "user",
    "channel", "relevant", "and", "or", "can", "u", "his", "her", "their", "what", "which", "who", "get", "find", "list",
    "tell", "with", "all", "do", "did", "has", "have", "please", "want", "now", "current", "previous", "last", "next",
    "month", "months", "performance", "data", "report", "stats", "statistics", "trend", "on",
]
MONTH_ALIASES = {
    "january": "Jan", "february": "Feb", "march": "Mar", "april": "Apr", "may": "May", "june": "Jun",
    "july": "Jul", "august": "Aug", "september": "Sep", "october": "Oct", "november": "Nov", "december": "Dec",
}
LANGUAGE_ALIASES = {"english": "en", "hindi": "hi", "spanish": "es", "arabic": "ar", "marathi": "mr", "mixed": "mix"}
PLATFORM_ALIASES = {
    "yt": "youtube", "youtube": "youtube", "ig": "instagram", "insta": "instagram", "instagram": "instagram",
    "fb": "facebook", "facebook": "facebook", "tw": "x", "twitter": "x", "x": "x", "tt": "tiktok", "tiktok": "tiktok",
    "li": "linkedin", "linkedin": "linkedin", "thread": "threads", "threads": "threads", "shorts": "shorts", "reels": "reels",
}
MONTH_CUTOFF, LANGUAGE_CUTOFF = 0.75, 0.80
STAGE = {"month": 9, "month_label": 1, "language": 2, "platform": 3}  # order in which aliases add terms to a question (9: none)
HIGH, LOW, TOP_MATCHES = 0.85, 0.70, 3
TOKEN_RE = "[a-zA-Z0-9]+"
RESCUE_RE = r"(?i)\b(?:channel|for|about|of)\s+([a-zA-Z])\b"


def D(spark, sf):
    return Domain(spark, sf)


# ---------------------------------------------------------------------------------
# V01 tokens of questions
# ---------------------------------------------------------------------------------
def questions(dom: Domain) -> DataFrame:
    c = dom.t("conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", "text")


def tokenise(df: DataFrame, text: str = "text", keys=("conv_id", "turn")) -> DataFrame:
    """Lower alphanumeric tokens without stop words in their order (``pos``), then the single
    letters rescued after 'channel/for/about/of'; each token once."""
    toks = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN_RE), 0), lambda t: F.lower(t)),
                    lambda t: ~t.isin(STOPWORDS))
    rescued = F.transform(F.regexp_extract_all(F.col(text), F.lit(RESCUE_RE), 1), lambda t: F.lower(t))
    return df.select(*keys, F.posexplode(F.array_distinct(F.concat(toks, rescued))).alias("pos", "token"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
_Q_SQL = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
_TOKENS_SQL = f"""SELECT DISTINCT conv_id, turn, token FROM (
  SELECT conv_id, turn, lower(unnest(regexp_extract_all(text, '{TOKEN_RE}'))) AS token FROM q) t WHERE token NOT IN ({_STOP_SQL})
UNION SELECT DISTINCT conv_id, turn, lower(unnest(regexp_extract_all(text, '(?i)\\b(?:channel|for|about|of)\\s+([a-zA-Z])\\b', 1))) FROM q"""


@query("v01_tokenise_question", oracle(
    "SELECT token, CAST(COUNT(*) AS BIGINT) AS n FROM toks GROUP BY token", extra=[("q", _Q_SQL), ("toks", _TOKENS_SQL)]))
def v01(spark, sf):
    t = tokenise(questions(D(spark, sf)))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------
# V02 alias normalisation
# ---------------------------------------------------------------------------------
def alias_table(spark) -> DataFrame:
    rows = [("month", k, v, MONTH_CUTOFF) for k, v in MONTH_ALIASES.items()]
    rows += [("language", k, v, LANGUAGE_CUTOFF) for k, v in LANGUAGE_ALIASES.items()]
    rows += [("platform", k, v, 1.0) for k, v in PLATFORM_ALIASES.items()]
    return spark.createDataFrame(rows, "kind string, alias string, canonical string, cutoff double")


def close_aliases(words: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct ``words`` (token) with the alias they stand for, per kind: (token, kind, canonical).
    An alias itself counts first; else, for months and languages, the closest alias that reaches
    the kind's cutoff (equal ones: the greater alias). Platform aliases match exactly."""
    a = aliases.withColumn("alias_len", F.length("alias"))
    kinds = [("month", MONTH_CUTOFF), ("language", LANGUAGE_CUTOFF)]
    windows = F.array(*[F.struct(F.lit(k).alias("kind"), length_window(F.length("token"), c).alias("lens")) for k, c in kinds])
    by_length = words.select("token", F.inline(windows)).select("token", "kind", F.explode("lens").alias("alias_len"))
    # fixed-size alias lists: broadcast (their size is fixed by the lists above)
    near = by_length.join(F.broadcast(a.where(F.col("kind") != "platform")), ["kind", "alias_len"])
    near = near.withColumn("s", block_similarity(F.col("alias"), F.col("token"), min(c for _, c in kinds))).where(F.col("s") >= F.col("cutoff"))
    best = near.groupBy("token", "kind").agg(F.max(F.struct("s", "alias", "canonical")).alias("best")).select("token", "kind", "best.canonical")
    exact = words.join(F.broadcast(a.where(F.col("kind") == "platform")), F.col("token") == F.col("alias"))
    return best.unionByName(exact.select("token", "kind", "canonical"))


def alias_terms(tokens: DataFrame, aliases: DataFrame, known_months: DataFrame) -> DataFrame:
    """V02 in order: the terms that aliases add to a question, (conv_id, turn, kind, canonical,
    stage, pos, then). A month goes with every year of the question ('Feb, 2026'), or without
    one with all known labels of that month (``known_months``: one column, label)."""
    found = tokens.join(close_aliases(tokens.select("token").distinct(), aliases), "token")
    keys = ["conv_id", "turn"]
    years = tokens.where(F.col("token").rlike("^20[0-9]{2}$")).select(*keys, F.col("token").alias("year"), F.col("pos").alias("year_pos"))
    months = found.where(F.col("kind") == "month").select(*keys, "canonical", "pos")
    dated = months.join(years, keys).select(*keys, F.concat("canonical", F.lit(", "), "year").alias("canonical"), "pos", F.col("year_pos").alias("then"))
    known = known_months.select(F.col("label"), F.substring_index("label", ",", 1).alias("canonical"), F.lit(0).alias("then")).where(F.col("label").contains(","))
    undated = months.join(years.select(*keys), keys, "left_anti").join(known, "canonical").select(*keys, F.col("label").alias("canonical"), "pos", "then")
    labels = dated.unionByName(undated).withColumn("kind", F.lit("month_label"))
    cols = [*keys, "kind", "canonical", F.create_map(*[F.lit(x) for k, v in STAGE.items() for x in (k, v)])[F.col("kind")].alias("stage"), "pos", "then"]
    return labels.select(*cols).unionByName(found.withColumn("then", F.lit(0)).select(*cols))


def alias_normalise(tokens: DataFrame, aliases: DataFrame, known_months: DataFrame) -> DataFrame:
    """The distinct canonical values of each question."""
    return alias_terms(tokens, aliases, known_months).select("conv_id", "turn", "kind", "canonical").distinct()


def _alias_values_sql():
    rows = [f"('month', '{k}', '{v}', {MONTH_CUTOFF})" for k, v in MONTH_ALIASES.items()]
    rows += [f"('language', '{k}', '{v}', {LANGUAGE_CUTOFF})" for k, v in LANGUAGE_ALIASES.items()]
    rows += [f"('platform', '{k}', '{v}', 1.0)" for k, v in PLATFORM_ALIASES.items()]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(kind, alias, canonical, cutoff)"


# Pairs of aliases and tokens, and what they come to, in the question's order.
_ORDERED_SQL = f"""SELECT conv_id, turn, token, MIN(i) AS i FROM (
  SELECT conv_id, turn, lower(t) AS token, i FROM (
    SELECT conv_id, turn, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '{TOKEN_RE}') AS l FROM q) x) y
  WHERE lower(t) NOT IN ({_STOP_SQL})
  UNION ALL SELECT conv_id, turn, lower(t), 1000000 + i FROM (
    SELECT conv_id, turn, unnest(l) AS t, unnest(range(len(l))) AS i FROM (
      SELECT conv_id, turn, regexp_extract_all(text, '(?i)\\b(?:channel|for|about|of)\\s+([a-zA-Z])\\b', 1) AS l FROM q) x) y) z
GROUP BY conv_id, turn, token"""
_ALIAS_SQL = [
    ("q", _Q_SQL), ("toks", _ORDERED_SQL), ("aliases", _alias_values_sql()),
    ("al", "SELECT DISTINCT alias AS a, token AS b FROM aliases CROSS JOIN (SELECT DISTINCT token FROM toks) t WHERE kind <> 'platform'"),
    *block_ratio_sql("al", MONTH_CUTOFF),
    ("known", "SELECT DISTINCT month AS label FROM clips"),
    ("found", """SELECT token, kind, canonical FROM (
       SELECT r.b AS token, x.kind, x.canonical, ROW_NUMBER() OVER (PARTITION BY r.b, x.kind ORDER BY r.s DESC, x.alias DESC) AS rn
         FROM al_ratio r JOIN aliases x ON x.alias = r.a WHERE x.kind <> 'platform' AND r.s >= x.cutoff) y WHERE rn = 1
       UNION ALL SELECT t.token, x.kind, x.canonical FROM (SELECT DISTINCT token FROM toks) t JOIN aliases x ON x.alias = t.token WHERE x.kind = 'platform'"""),
    ("years", "SELECT conv_id, turn, token AS year, i AS year_i FROM toks WHERE regexp_full_match(token, '20[0-9]{2}')"),
    ("months", "SELECT t.conv_id, t.turn, f.canonical, t.i FROM toks t JOIN found f ON f.token = t.token WHERE f.kind = 'month'"),
    ("added", """SELECT t.conv_id, t.turn, f.kind, f.canonical, CASE f.kind WHEN 'month' THEN 9 WHEN 'language' THEN 2 ELSE 3 END AS stage, t.i, 0 AS y
         FROM toks t JOIN found f ON f.token = t.token
       UNION ALL SELECT m.conv_id, m.turn, 'month_label', m.canonical || ', ' || y.year, 1, m.i, y.year_i FROM months m JOIN years y ON y.conv_id = m.conv_id AND y.turn = m.turn
       UNION ALL SELECT m.conv_id, m.turn, 'month_label', k.label, 1, m.i, 0 FROM months m JOIN known k ON starts_with(k.label, m.canonical || ',')
         WHERE NOT EXISTS (SELECT 1 FROM years y WHERE y.conv_id = m.conv_id AND y.turn = m.turn)"""),
]


def known_months(dom: Domain) -> DataFrame:
    return dom.clips("month").select(F.col("month").alias("label")).where("label is not null").distinct()


@query("v02_alias_normalise", oracle("SELECT DISTINCT conv_id, turn, kind, canonical FROM added", "clips", extra=_ALIAS_SQL))
def v02(spark, sf):
    dom = D(spark, sf)
    return alias_normalise(tokenise(questions(dom)), alias_table(spark), known_months(dom))


# ---------------------------------------------------------------------------------
# V03 entity catalogue, V04 fuzzy matching
# ---------------------------------------------------------------------------------
CATALOGUE = [("User", "user_name"), ("Channel", "channel_name"), ("Platform", "platform"), ("Input Type", "input_type"),
             ("Output Type", "output_type"), ("Language", "language"), ("Month", "month")]


def entity_catalogue(dom: Domain) -> DataFrame:
    """Distinct non-null values per dimension with their label (one scan, one shuffle)."""
    c = dom.clips(*[col for _, col in CATALOGUE])
    pairs = c.select(F.inline(F.array(*[F.struct(F.lit(l).alias("label"), F.col(col).alias("value")) for l, col in CATALOGUE])))
    return pairs.where(F.col("value").isNotNull()).distinct()


_CAT_SQL = " UNION ".join(f"SELECT DISTINCT '{l}' AS label, {c} AS value FROM clips WHERE {c} IS NOT NULL" for l, c in CATALOGUE)


@query("v03_entity_catalogue", oracle(_CAT_SQL, "clips"))
def v03(spark, sf):
    return entity_catalogue(D(spark, sf))


def question_terms(tokens: DataFrame, added: DataFrame) -> DataFrame:
    """The terms looked up for each question: its tokens, then the values that aliases add."""
    keys = ["conv_id", "turn"]
    own = tokens.select(*keys, "token", F.struct(F.lit(0).alias("stage"), "pos", F.lit(0).alias("then"), "token").alias("place"))
    more = added.where(F.col("stage") < 9).select(*keys, F.col("canonical").alias("token"), F.struct("stage", "pos", "then", F.col("canonical").alias("token")).alias("place"))
    return own.unionByName(more).groupBy(*keys, "token").agg(F.min("place").alias("place"))


def fuzzy_match(tokens: DataFrame, catalogue: DataFrame, low: float = LOW, high: float = HIGH, top: int = TOP_MATCHES) -> DataFrame:
    """Per (token, label) the best ``top`` values with similarity ≥ ``low``; band high/low.
    Values that differ only in case count as one (the greatest); equal similarity: the greater value first."""
    # Each is read for its character classes and again for its rows, so neither is made twice.
    t = tokens.select("token").distinct().checkpoint()
    v = catalogue.groupBy("label", F.lower("value").alias("v")).agg(F.max("value").alias("value")).checkpoint()
    # AQE broadcasts a side when it measures it small; a larger one is shuffled on its character
    # classes and skewed ones are split.
    pairs = candidate_pairs(t, v, "token", "v", low)
    pairs = pairs.withColumn("s", block_similarity(F.col("v"), F.col("token"), low)).where(F.col("s") >= low)
    from tidemark.operators.windows import top_n_per_group

    # two-stage (salted by value) so a token with many candidates is not ranked in one task
    order = [F.col("s").desc(), F.col("v").desc()]
    best = top_n_per_group(pairs, ["token", "label"], order, top, salt=["value"])
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("token", "label").orderBy(*order)))
    return best.select("token", "label", "value", round_half_up(F.col("s"), 6).alias("similarity"),
                       F.when(F.col("s") >= high, "high").otherwise("low").alias("confidence"), "rank")


def entity_bands(terms: DataFrame, matches: DataFrame, labels=tuple(l for l, _ in CATALOGUE), top: int = TOP_MATCHES) -> DataFrame:
    """V04 per question and label: the band (high, else low, else none) and its first ``top``
    different values in the order of the question's terms, then of rank."""
    keys = ["conv_id", "turn", "label"]
    found = terms.join(matches, "token").groupBy(*keys, "confidence", "value").agg(F.min(F.struct("place", "rank")).alias("first"))
    bands = found.groupBy(*keys).agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("confidence", "first", "value"))).alias("all"))
    # 'high' sorts before 'low', so the band's own values come first
    own = F.slice(F.filter("all", lambda x: x["confidence"] == F.col("confidence")), 1, top)
    bands = bands.select(*keys, "confidence", F.array_join(F.transform(own, lambda x: x["value"]), ", ").alias("matches"))
    asked = terms.select("conv_id", "turn").distinct().select("conv_id", "turn", F.explode(F.array(*[F.lit(l) for l in labels])).alias("label"))
    return asked.join(bands, keys, "left").select(*keys, F.coalesce("confidence", F.lit("none")).alias("confidence"), F.coalesce("matches", F.lit("")).alias("matches"))


_MATCH_SQL = [
    *_ALIAS_SQL,
    ("terms", """SELECT conv_id, turn, token, MIN({'s': s, 'i': i, 'y': y, 't': token}) AS place FROM (
       SELECT conv_id, turn, token, 0 AS s, i, 0 AS y FROM toks UNION ALL SELECT conv_id, turn, canonical, stage, i, y FROM added WHERE stage < 9) u
       GROUP BY conv_id, turn, token"""),
    ("cat", f"SELECT label, lower(value) AS v, MAX(value) AS value FROM ({_CAT_SQL}) c GROUP BY 1, 2"),
    ("en", "SELECT DISTINCT v AS a, token AS b FROM cat JOIN (SELECT DISTINCT token FROM terms) t ON length(v) BETWEEN 0.5 * length(token) AND 2 * length(token)"),
    *block_ratio_sql("en", LOW),
    ("matched", f"""SELECT * FROM (SELECT r.b AS token, c.label, c.value, r.s, ROW_NUMBER() OVER (PARTITION BY r.b, c.label ORDER BY r.s DESC, c.v DESC) AS rank
       FROM en_ratio r JOIN cat c ON c.v = r.a) x WHERE rank <= {TOP_MATCHES}"""),
]


@query("v04_entity_fuzzy_match", oracle(
    f"""SELECT token, label, value, {round_sql('s', 6)} AS similarity, CASE WHEN s >= {HIGH} THEN 'high' ELSE 'low' END AS confidence,
       CAST(rank AS INTEGER) AS rank FROM matched""", "clips", extra=_MATCH_SQL))
def v04(spark, sf):
    dom = D(spark, sf)
    toks = tokenise(questions(dom))
    return fuzzy_match(question_terms(toks, alias_terms(toks, alias_table(spark), known_months(dom))), entity_catalogue(dom))


@query("v04_entity_bands", oracle(
    f"""WITH f AS (SELECT t.conv_id, t.turn, m.label, CASE WHEN m.s >= {HIGH} THEN 'high' ELSE 'low' END AS confidence, m.value, MIN({{'p': t.place, 'r': m.rank}}) AS first
        FROM terms t JOIN matched m ON m.token = t.token GROUP BY ALL),
 b AS (SELECT conv_id, turn, label, MIN(confidence) AS confidence FROM f GROUP BY ALL),
 v AS (SELECT f.conv_id, f.turn, f.label, f.confidence, list(f.value ORDER BY f.first)[1:{TOP_MATCHES}] AS vals
         FROM f JOIN b ON b.conv_id = f.conv_id AND b.turn = f.turn AND b.label = f.label AND b.confidence = f.confidence GROUP BY ALL)
SELECT q.conv_id, q.turn, q.label, COALESCE(v.confidence, 'none') AS confidence, COALESCE(array_to_string(v.vals, ', '), '') AS matches
  FROM (SELECT DISTINCT conv_id, turn, unnest([{', '.join(f"'{l}'" for l, _ in CATALOGUE)}]) AS label FROM terms) q
  LEFT JOIN v ON v.conv_id = q.conv_id AND v.turn = q.turn AND v.label = q.label""", "clips", extra=_MATCH_SQL))
def v04_bands(spark, sf):
    dom = D(spark, sf)
    toks = tokenise(questions(dom))
    terms = question_terms(toks, alias_terms(toks, alias_table(spark), known_months(dom)))
    return entity_bands(terms, fuzzy_match(terms, entity_catalogue(dom)))


# ---------------------------------------------------------------------------------
# V05–V07 vectors
# ---------------------------------------------------------------------------------
TYPES = [(0, 4), (1, 3), (2, 3)]  # (label % 3, k): tables / metrics / examples
MIN_SIM = 0.20
QUERY_BLOCK = 256  # query vectors scored in one pass


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Query vectors derived from the whole table: the mean embedding of every label.
    Element-wise means are an aggregation keyed by (label, position); the per-label list is
    bounded by the embedding dimension."""
    x = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    g = x.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = g.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s"))
    return c.select(F.col("label").alias("q_id"), F.transform("s", lambda t: t["m"]).alias("embedding"))


def similarity_topk(vectors: DataFrame, queries: DataFrame, k_by_type=TYPES, min_sim: float = MIN_SIM) -> DataFrame:
    """Per query and type, the top-k stored vectors by cosine similarity (≥ min_sim).

    The stated queries meet all rows in blocks of QUERY_BLOCK: a block is one array value
    (a scalar subquery) scored next to each stored vector where it is read. The literal limit
    of the first ranking lets Spark prune every task's rows before the shuffle."""
    v = vectors.select("vec_id", "label", "embedding", F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("n"))
    q = queries.select("q_id", F.col("embedding").alias("q_emb"), F.sqrt(_dot(F.col("embedding"), F.col("embedding"))).alias("qn"))
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    order = [F.col("sim").desc(), "vec_id"]
    most = max(k for _, k in k_by_type)
    out = None
    for b in range(n_blocks):
        block = q.where(F.pmod(F.xxhash64("q_id"), F.lit(n_blocks)) == b).agg(F.collect_list(F.struct("q_id", "q_emb", "qn")).alias("_queries"))
        scored = F.transform("_queries", lambda x: F.struct(
            x["q_id"].alias("q_id"), (_dot(F.col("embedding"), x["q_emb"]) / (F.col("n") * x["qn"])).alias("sim")))
        s = with_scalars(v, block).select("vec_id", F.pmod(F.col("label"), F.lit(3)).alias("type"), F.inline(F.filter(scored, lambda x: x["sim"] >= min_sim)))
        ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("q_id", "type").orderBy(*order))).where(F.col("rank") <= most)
        out = ranked if out is None else out.unionByName(ranked)
    kmap = F.create_map(*[x for t, k in k_by_type for x in (F.lit(t), F.lit(k))])
    return out.where(F.col("rank") <= kmap[F.col("type")]).select("q_id", "type", "vec_id", round_half_up(F.col("sim"), 6).alias("similarity"), "rank")


_VEC_SQL = f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 x AS (SELECT label, unnest(range(0, len(e))) AS pos, unnest(e) AS val FROM v),
 c AS (SELECT label, pos, AVG(val) AS m FROM x GROUP BY label, pos),
 q AS (SELECT label AS q_id, list(m ORDER BY pos) AS qe FROM c GROUP BY label),
 s AS (SELECT q_id, vec_id, label % 3 AS type,
              list_inner_product(e, qe) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe))) AS sim
         FROM v CROSS JOIN q),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q_id, type ORDER BY sim DESC, vec_id) AS rank FROM s WHERE sim >= {MIN_SIM})
SELECT q_id, CAST(type AS INTEGER) AS type, vec_id, {round_sql('sim', 6)} AS similarity, CAST(rank AS INTEGER) AS rank FROM r
 WHERE rank <= CASE type {' '.join(f'WHEN {t} THEN {k}' for t, k in TYPES)} END"""


def _vectors(spark, sf):
    e = D(spark, sf).t("embeddings")
    return e, label_centroids(e)


@query("v05_similarity_topk", oracle(_VEC_SQL))
def v05(spark, sf):
    e, q = _vectors(spark, sf)
    return similarity_topk(e, q)


@query("v06_retrieve_and_merge", oracle(
    f"""WITH t AS ({_VEC_SQL})
SELECT q_id, vec_id, MIN(type) AS list, arg_min(rank, type) AS pos FROM t GROUP BY q_id, vec_id"""))
def v06(spark, sf):
    e, q = _vectors(spark, sf)
    t = similarity_topk(e, q)
    # the three typed lists concatenated in type order; a vector keeps its first position
    first = t.groupBy("q_id", "vec_id").agg(F.min(F.struct("type", "rank")).alias("p"))
    return first.select("q_id", "vec_id", F.col("p.type").alias("list"), F.col("p.rank").alias("pos"))


UPDATED_LABELS = 5  # a new version arrives for every vector whose label is below this


@query("v07_upsert_vectors", oracle(
    f"""SELECT vec_id, CASE WHEN label < {UPDATED_LABELS} THEN label + 100 ELSE label END AS label FROM embeddings"""))
def v07(spark, sf):
    from tidemark.sources.keyed_table import KeyedTable

    e = D(spark, sf).t("embeddings").select("vec_id", "label", "embedding")
    base = scratch_dir(spark, "vectors")
    stored = KeyedTable(spark, "vectors_" + base.rsplit("-", 1)[1], base, "vec_id", "version")
    stored.upsert(e.withColumn("version", F.lit(1)))
    stored.upsert(e.where(F.col("label") < UPDATED_LABELS).withColumn("label", F.col("label") + 100).withColumn("version", F.lit(2)))
    return stored.rows().select("vec_id", "label")


# ---------------------------------------------------------------------------------
# V08 result-shape profile, V09 headline search with an inverted index
# ---------------------------------------------------------------------------------
def result_shape_profile(df: DataFrame, time_cols=("month",)) -> DataFrame:
    """Classify columns (time / number / category), count distinct values (one aggregation),
    and choose the chart data shape: trend (time + number), heat table (two categories + number)
    or ranked table; rows are capped at 20 for trends and 15 otherwise."""
    roles = {}
    for c, t in df.dtypes:
        if c in time_cols or t in ("date", "timestamp", "timestamp_ntz"):
            roles[c] = "time"
        elif t in ("bigint", "int", "double", "float", "smallint", "decimal"):
            roles[c] = "number"
        else:
            roles[c] = "category"
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns])
    n_time = sum(r == "time" for r in roles.values())
    n_num = sum(r == "number" for r in roles.values())
    n_cat = sum(r == "category" for r in roles.values())
    chart = "trend" if n_time and n_num else "heat_table" if n_cat >= 2 and n_num else "ranked_table"
    cap = 20 if chart == "trend" else 15
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(roles[c]).alias("role"),
                                                      F.col(f"`{c}`").cast("bigint").alias("distinct_values")) for c in df.columns])))
    return long.withColumn("chart", F.lit(chart)).withColumn("row_cap", F.lit(cap))


@query("v08_result_shape_profile", oracle(
    """SELECT r.c AS "column", r.role, d.distinct_values, 'trend' AS chart, 20 AS row_cap
  FROM (VALUES ('month', 'time'), ('uploaded_count', 'number'), ('published_count', 'number')) r(c, role)
  JOIN (SELECT 'month' AS c, CAST(COUNT(DISTINCT month) AS BIGINT) AS distinct_values FROM mart_monthly
        UNION ALL SELECT 'uploaded_count', COUNT(DISTINCT uploaded_count) FROM mart_monthly
        UNION ALL SELECT 'published_count', COUNT(DISTINCT published_count) FROM mart_monthly) d ON r.c = d.c""", "mart_monthly"))
def v08(spark, sf):
    from tidemark.plans.marts import monthly_mart

    m = monthly_mart(D(spark, sf)).select("month", "uploaded_count", "published_count")
    return result_shape_profile(m)


# Columns that are rates, columns that are labels whatever their type, names of time columns.
RATE_COLS = ["publish_rate_pct", "upload_to_publish_rate_pct", "compression_ratio", "creation_multiplier"]
LABEL_COLS = ["Month", "Channel", "User", "Input Type", "Output Type", "Language", "platform", "uploaded_by", "input_type", "published_platform",
              "video_id", "headline", "_raw", "ingested_at"]
TIME_COLS = ["month", "date", "week"]
HEAT_ROWS, HEAT_COLS, TOP_DUAL, TOP_BARS, MOST_BARS = 20, 10, 15, 20, 4


def chart_frame(df: DataFrame) -> tuple[str | None, DataFrame | None]:
    """The chart that fits a result, and its data as rows (x, series, value, place).

    A time column gives a line of all numbers, or the first volume with the first rate. Two
    labels and one number give a heat map of sums, missing cells 0, up to 20 by 10 members. One
    label gives its 15 largest rows with a rate, else up to four volumes of all rows, else the 20
    largest rows of the one number. Results of fewer than two rows, and others, have no chart.
    ``place`` ranks the rows of a capped chart (equal values by label); null elsewhere."""
    labels = [c for c, t in df.dtypes if c in LABEL_COLS or c.endswith("_raw") or t == "string"]
    numbers = [c for c in df.columns if c not in labels]
    rates, volumes = [c for c in numbers if c in RATE_COLS], [c for c in numbers if c not in RATE_COLS]
    time = next((c for c in df.columns if c.lower() in TIME_COLS), None)
    size = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(labels[:2])]).first()
    if size["n"] < 2:
        return None, None

    def long(rows, x, series):
        entries = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("double").alias("value")) for c in series])
        return rows.select(F.col(f"`{x}`").cast("string").alias("x"), F.inline(entries), F.col("_place").alias("place"))

    def top(by, n):
        order = [F.col(f"`{by}`").desc(), F.col(f"`{labels[0]}`")]
        first = df.orderBy(*order).limit(n)
        return first.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))

    every = df.withColumn("_place", F.lit(None).cast("int"))
    if time:
        return ("dual_axis", long(every, time, [volumes[0], rates[0]])) if volumes and rates else ("line", long(every, time, numbers))
    if len(labels) >= 2 and len(numbers) == 1 and size["m0"] <= HEAT_ROWS and size["m1"] <= HEAT_COLS:
        row, col, value = labels[0], labels[1], numbers[0]
        cells = df.groupBy(row, col).agg(F.sum(F.col(f"`{value}`").cast("double")).alias("value"))
        # one map a row, laid out over all (at most 10) members of the second label
        maps = cells.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, "value"))).alias("cells"))
        full = with_scalars(maps, df.agg(F.collect_set(col).alias("members"))).select(F.col(row).alias("x"), "cells", F.explode("members").alias("series"))
        return "heatmap", full.select("x", "series", F.coalesce(F.try_element_at("cells", F.col("series")), F.lit(0.0)).alias("value"), F.lit(None).cast("int").alias("place"))
    if labels and volumes and len(rates) == 1:
        return "dual_axis", long(top(volumes[0], TOP_DUAL), labels[0], [volumes[0], rates[0]])
    if labels and len(volumes) >= 2:
        return "bar", long(every, labels[0], volumes[:MOST_BARS])
    if labels and len(numbers) == 1:
        return "bar", long(top(numbers[0], TOP_BARS), labels[0], numbers)
    return None, None


_RATE_SQL = round_sql("CAST(published_count AS DOUBLE) * 100.0 / NULLIF(CAST(created_count AS DOUBLE), 0)", 2)


def _unpivot_sql(name: str, chart: str, source: str, x: str, series: dict[str, str], place: str = "NULL") -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS result, '{chart}' AS chart, {x} AS x, '{c}' AS series, CAST({e} AS DOUBLE) AS value, CAST({place} AS INTEGER) AS place FROM {source}"
                              for c, e in series.items())


@query("v08_chart_frames", oracle(
    " UNION ALL ".join([
        _unpivot_sql("months", "dual_axis", "mart_monthly", "month", {"uploaded_count": "uploaded_count", "publish_rate_pct": _RATE_SQL}),
        _unpivot_sql("month volumes", "line", "mart_monthly", "month", {"uploaded_count": "uploaded_count", "published_count": "published_count"}),
        """SELECT 'cells' AS result, 'heatmap' AS chart, g.input_type AS x, g.language AS series, CAST(COALESCE(SUM(m.n), 0) AS DOUBLE) AS value, CAST(NULL AS INTEGER) AS place
  FROM (SELECT a.input_type, b.language FROM (SELECT DISTINCT input_type FROM cells) a CROSS JOIN (SELECT DISTINCT language FROM cells) b) g
  LEFT JOIN cells m ON m.input_type = g.input_type AND m.language = g.language GROUP BY ALL""",
        _unpivot_sql("users", "dual_axis", f"(SELECT *, ROW_NUMBER() OVER (ORDER BY created_count DESC, user_name) AS rn FROM mart_users QUALIFY rn <= {TOP_DUAL}) u", "user_name",
                     {"created_count": "created_count", "publish_rate_pct": _RATE_SQL}, "rn"),
        _unpivot_sql("top users", "bar", f"(SELECT *, ROW_NUMBER() OVER (ORDER BY uploaded_count DESC, user_name) AS rn FROM mart_users QUALIFY rn <= {TOP_BARS}) u", "user_name",
                     {"uploaded_count": "uploaded_count"}, "rn"),
        _unpivot_sql("languages", "bar", "mart_languages", "language", {c: c for c in ("uploaded_count", "created_count", "published_count")})]),
    "mart_monthly", "mart_users", "mart_languages", "clips",
    extra=[("cells", "SELECT input_type, language, COUNT(*) AS n FROM clips WHERE platform = 'Brand#3' GROUP BY 1, 2")]))
def v08_frames(spark, sf):
    from tidemark.plans.marts import marts_for, monthly_mart

    dom = D(spark, sf)
    rate = round_half_up(F.col("published_count") * F.lit(100.0) / F.nullif(F.col("created_count"), F.lit(0)), 2).alias("publish_rate_pct")
    months, users = monthly_mart(dom), marts_for(dom, "users")
    cells = dom.clips("input_type", "language", "platform").where("platform = 'Brand#3'").groupBy("input_type", "language").agg(F.count(F.lit(1)).alias("n"))
    results = {"months": months.select("month", "uploaded_count", rate), "month volumes": months.select("month", "uploaded_count", "published_count"), "cells": cells,
               "users": users.select("user_name", "created_count", rate), "top users": users.select("user_name", "uploaded_count"),
               "languages": marts_for(dom, "languages").select("language", "uploaded_count", "created_count", "published_count")}
    out = None
    for name, df in results.items():
        chart, frame = chart_frame(df)
        if frame is not None:
            frame = frame.select(F.lit(name).alias("result"), F.lit(chart).alias("chart"), "x", "series", "value", "place")
            out = frame if out is None else out.unionByName(frame)
    return out


SEARCH_TERMS = ["the", "of"]


INDEX_BUCKETS = 64
INDEX_SPREAD = 64  # tasks that may share a bucket
INDEX_BLOCK_BITS = 16  # documents of one block share all but the last 16 bits of their id


def _delta_bytes(ids: np.ndarray) -> bytes:
    """Ascending numbers as differences of 7 bits a byte, the high bit set on all but the last."""
    gaps = np.diff(ids, prepend=0).astype(np.uint64)
    parts = [(gaps >> np.uint64(7 * i)) & np.uint64(0x7F) for i in range(3)]  # below 2^21
    size = 1 + (gaps >= 1 << 7) + (gaps >= 1 << 14)
    out = np.zeros((len(gaps), 3), np.uint8)
    for i in range(3):
        out[:, i] = parts[i] | np.where(size > i + 1, 0x80, 0).astype(np.uint64)
    return out[np.arange(3) < size[:, None]].tobytes()


def _from_delta_bytes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    gaps = np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * place), first)
    return np.cumsum(gaps)


def _posting_lists(key: str):
    """Sorted (token, doc) rows of a task → one delta-coded list a token and block of documents;
    a repeated row counts once."""

    def encode(batches):
        held = None  # the open list may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            tokens, docs = t.column("token").combine_chunks().dictionary_encode(), t.column(key).to_numpy()
            block = docs >> INDEX_BLOCK_BITS
            code = tokens.indices.to_numpy()
            once = np.concatenate(([True], (code[1:] != code[:-1]) | (docs[1:] != docs[:-1])))
            if not once.all():
                t, code, docs, block = t.filter(pa.array(once)), code[once], docs[once], block[once]
            new = np.concatenate(([True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])))
            start = np.flatnonzero(new)
            held = t.slice(int(start[-1]))
            yield from lists(t, docs, block, start[:-1], start[1:])
        if held is not None and held.num_rows:
            docs = held.column(key).to_numpy()
            yield from lists(held, docs, docs >> INDEX_BLOCK_BITS, np.array([0]), np.array([len(docs)]))

    def lists(t, docs, block, start, end):
        if len(start):
            low = docs & ((1 << INDEX_BLOCK_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [t.column("bucket").combine_chunks().take(pa.array(start)), t.column("token").combine_chunks().take(pa.array(start)), pa.array(block[start]),
                 pa.array((end - start).astype(np.int32)), pa.array([_delta_bytes(low[i:j]) for i, j in zip(start, end, strict=True)], pa.binary())],
                names=["bucket", "token", "block", "n", "docs"])

    return encode


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", buckets: int = INDEX_BUCKETS) -> None:
    """An inverted index kept as a table partitioned by token bucket. A row is the posting list
    of a token in a block of 2^16 ids, so a frequent token is many rows of bounded size. Tokens
    are the distinct runs [a-z0-9]+ of the whole lower-cased text; rows without id are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), 0))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.explode(words).alias("token"))
    rows = rows.select(_bucket(F.col("token"), buckets).alias("bucket"), "token", key, F.shiftright(key, INDEX_BLOCK_BITS).alias("block"))
    # One shuffle, dealt by bucket and block, so that no token is one task's alone.
    rows = rows.repartition("bucket", F.pmod("block", F.lit(INDEX_SPREAD))).sortWithinPartitions("bucket", "token", key)
    rows.select("bucket", "token", key).mapInArrow(_posting_lists(key), "bucket int, token string, block long, n int, docs binary").write.partitionBy("bucket").parquet(path)


def search_all_terms(spark, path: str, terms: list[str], key: str = "doc_id", buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Ids of the documents that hold every term, from the terms' buckets alone. The lists of
    a block meet in one row; sorted lists are merged, the shortest first."""
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        raise ValueError("no search terms")
    at = [r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(F.lit(t), buckets) for t in wanted]))).collect()]
    lists = spark.read.schema("token string, block long, n int, docs binary, bucket int").parquet(path).where(F.col("bucket").isin(sorted(set(at))) & F.col("token").isin(wanted))
    blocks = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "docs"))).alias("lists")).where(F.size("lists") == len(wanted))

    def merge(batches):
        for b in batches:
            out = [np.zeros(0, np.int64)]
            for block, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = _from_delta_bytes(found[0]["docs"])
                for x in found[1:]:
                    other = _from_delta_bytes(x["docs"])
                    place = np.minimum(np.searchsorted(other, ids), len(other) - 1)
                    ids = ids[other[place] == ids]
                out.append(ids + (block << INDEX_BLOCK_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=[key])

    return blocks.mapInArrow(merge, f"{key} long")


@query("v09_catalogue_terms_search", oracle(
    f"""SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) i
 WHERE token IN ({', '.join(f"'{t}'" for t in SEARCH_TERMS)}) GROUP BY doc_id HAVING COUNT(DISTINCT token) = {len(set(SEARCH_TERMS))}"""))
def v09(spark, sf):
    path = scratch_dir(spark, "index")
    write_index(D(spark, sf).t("documents").select("doc_id", "text"), path)
    return search_all_terms(spark, path, SEARCH_TERMS)
