"""Data-quality checks (survey §2.11, Q01–Q26, plus A19/A21/O04/O05/U05/F15/K07).

Every check yields rows ``name, status, message, count, pct, field, tbl``.

Scale design: checks are grouped into *blocks*. A block is ONE aggregation over one source
(many ``count_if``/``sum`` expressions in a single ``agg``: one scan, partial aggregation,
one tiny shuffle), producing a one-row frame of named counters. The check rows are then
generated from that row with ``inline`` (no data-sized work). Duplicate checks need a
group-by on the key first (one shuffle keyed by the key, partially aggregated), then the
same one-row reduction. The full run is a union of ~10 one-row frames.

A run reads ``lineitem`` whole twice: once for the detail rows and once for the uploads, both
written as tables of the needed columns that all blocks read (``StoredDomain``), and column by
column for the foreign keys (their values are counted before they meet the dimensions). Its rows are stored under the state of the input files; the reports read them
(``stored_checks``) instead of running the suite again.

The same block/check specification renders DuckDB SQL, so the whole suite has an oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import HMS_PATTERN, MONTH_LABEL_PATTERN, NULLISH, is_nullish, round_half_up, round_sql, with_scalars
from tidemark.operators.filters import HMS_TEXT_SQL, hms_text, qa_exact_mask
from tidemark.plans.marts import marts_for, monthly_mart
from tidemark.registry import query
from tidemark.sources.domain import QA_ACCOUNTS, WIDE_COLS, Domain, StoredDomain, oracle

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
RESULT_COLS = ["name", "status", "message", "count", "pct", "field", "tbl"]
_NULLISH_SQL = ", ".join(f"'{v}'" for v in NULLISH)
_QA_SQL = ", ".join(f"'{a}'" for a in QA_ACCOUNTS)


def D(spark, sf):
    return Domain(spark, sf)


@dataclass
class Check:
    name: str
    field: str
    rule: str  # fail_if_any | warn_if_any | missing_fail | missing_warn | warn_above | coverage | rowcount | rowcount12 | required
    cnt: str  # counter column in the block's one-row frame
    den: str  # denominator column
    param: float = 0.0


@dataclass
class Block:
    tbl: str
    frame: object  # domain -> one-row DataFrame with the counters
    sql: str  # DuckDB one-row SELECT with the same counters (may reference oracle views)
    checks: list
    views: tuple = ()


# ---------------------------------------------------------------------------------
# Status / message / pct from a rule (Spark and SQL renderings of the same logic)
# ---------------------------------------------------------------------------------
def _status(rule: str, c: str, d: str, p: float) -> str:
    """Spark SQL status expression of a rule over counter ``c`` and denominator ``d``
    (doubles written as ``D`` literals: Spark reads a bare ``0.3`` as a decimal)."""
    pct = f"({c} * 100.0D / nullif(CAST({d} AS DOUBLE), 0.0D))"
    if rule in ("fail_if_any", "missing_fail", "required"):
        return f"CASE WHEN {c} > 0 THEN '{FAIL}' ELSE '{PASS}' END"
    if rule in ("warn_if_any", "missing_warn"):
        return f"CASE WHEN {c} > 0 THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "warn_above":
        return f"CASE WHEN {c} > {d} * {float(p)!r}D THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "coverage":
        return f"CASE WHEN {pct} > 90 THEN '{FAIL}' WHEN {pct} > 50 THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "rowcount":
        return f"CASE WHEN {c} > 0 THEN '{PASS}' ELSE '{FAIL}' END"
    if rule == "rowcount12":
        return f"CASE WHEN {c} = 12 THEN '{PASS}' WHEN {c} > 13 THEN '{FAIL}' ELSE '{WARN}' END"
    raise ValueError(rule)


def _status_sql(rule: str, c: str, d: str, p: float) -> str:
    pct = f"({c} * 100.0 / NULLIF(CAST({d} AS DOUBLE), 0))"
    if rule in ("fail_if_any", "missing_fail", "required"):
        return f"CASE WHEN {c} > 0 THEN '{FAIL}' ELSE '{PASS}' END"
    if rule in ("warn_if_any", "missing_warn"):
        return f"CASE WHEN {c} > 0 THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "warn_above":
        return f"CASE WHEN {c} > {d} * {p} THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "coverage":
        return f"CASE WHEN {pct} > 90 THEN '{FAIL}' WHEN {pct} > 50 THEN '{WARN}' ELSE '{PASS}' END"
    if rule == "rowcount":
        return f"CASE WHEN {c} > 0 THEN '{PASS}' ELSE '{FAIL}' END"
    if rule == "rowcount12":
        return f"CASE WHEN {c} = 12 THEN '{PASS}' WHEN {c} > 13 THEN '{FAIL}' ELSE '{WARN}' END"
    raise ValueError(rule)


def _rows_spark(one: DataFrame, block: Block) -> DataFrame:
    """One-row counter frame → one result row per check. The rows are a single
    ``inline(array(named_struct(...)))`` expression handed to Spark as SQL text: one parse on
    the JVM side instead of hundreds of small expression objects built from Python."""
    structs = []
    for ch in block.checks:
        c, d = f"CAST(`{ch.cnt}` AS BIGINT)", f"CAST(`{ch.den}` AS BIGINT)"
        pct = f"CASE WHEN {d} = 0 THEN 0.0D ELSE CAST(floor({c} * 100.0D / {d} * 10.0D + 0.5D) / 10.0D AS DOUBLE) END"
        structs.append(
            f"named_struct('name', {_q(ch.name)}, 'status', {_status(ch.rule, c, d, ch.param)}, "
            f"'message', format_string('%d of %d', {c}, {d}), 'count', CAST({c} AS BIGINT), 'pct', {pct}, "
            f"'field', {_q(ch.field)}, 'tbl', {_q(block.tbl)})")
    return one.select(F.expr(f"inline(array({', '.join(structs)}))"))


def _q(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rows_sql(block: Block, alias: str) -> str:
    parts = []
    for ch in block.checks:
        c, d = f"CAST({alias}.{ch.cnt} AS BIGINT)", f"CAST({alias}.{ch.den} AS BIGINT)"
        parts.append(
            f"SELECT '{ch.name}' AS name, {_status_sql(ch.rule, c, d, ch.param)} AS status, printf('%d of %d', {c}, {d}) AS message, "
            f"CAST({c} AS BIGINT) AS count, CASE WHEN {d} = 0 THEN 0.0 ELSE {round_sql(f'{c} * 100.0 / {d}', 1)} END AS pct, "
            f"'{ch.field}' AS field, '{block.tbl}' AS tbl FROM ({block.sql}) {alias}"
        )
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------------------------
# Blocks
# ---------------------------------------------------------------------------------
def _nl(c: str) -> Column:
    return is_nullish(c)


def _nl_sql(c: str) -> str:
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ({_NULLISH_SQL}))"


DETAIL_FIELDS = [("video_id", "missing_fail"), ("user_name", "missing_fail"), ("headline", "missing_warn"),
                 ("team_name", "missing_fail"), ("input_type", "missing_warn")]
BAD_LINE = 7


def _detail_frame(dom):
    c = dom.clips("video_id", "user_name", "headline", "team_name", "input_type", "is_published", "platform",
                           "published_url", "created_secs", "line_no")
    dur = F.when(F.col("line_no") == BAD_LINE, F.concat(hms_text("created_secs"), F.lit("x"))).otherwise(hms_text("created_secs"))
    pub = F.col("is_published")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(pub).alias("n_pub")]
    aggs += [F.count_if(_nl(f)).alias(f"m_{f}") for f, _ in DETAIL_FIELDS]
    aggs += [
        F.count_if(pub & _nl("platform")).alias("m_pub_platform"),
        F.count_if(pub & _nl("published_url")).alias("m_pub_url"),
        F.count_if(F.col("team_name").isNull()).alias("unknown_team"),
        F.count_if(qa_exact_mask("user_name")).alias("qa_rows"),
        F.count_if(~F.trim(dur).rlike(HMS_PATTERN)).alias("bad_duration"),
    ]
    return c.agg(*aggs)


def _detail_sql():
    dur = f"CASE WHEN line_no = {BAD_LINE} THEN {HMS_TEXT_SQL.format(s='created_secs')} || 'x' ELSE {HMS_TEXT_SQL.format(s='created_secs')} END"
    cols = ["COUNT(*) AS n", "COUNT(*) FILTER (WHERE is_published) AS n_pub"]
    cols += [f"COUNT(*) FILTER (WHERE {_nl_sql(f)}) AS m_{f}" for f, _ in DETAIL_FIELDS]
    cols += [
        f"COUNT(*) FILTER (WHERE is_published AND {_nl_sql('platform')}) AS m_pub_platform",
        f"COUNT(*) FILTER (WHERE is_published AND {_nl_sql('published_url')}) AS m_pub_url",
        "COUNT(*) FILTER (WHERE team_name IS NULL) AS unknown_team",
        f"COUNT(*) FILTER (WHERE COALESCE(lower(trim(user_name)) IN ({_QA_SQL}), false)) AS qa_rows",
        f"COUNT(*) FILTER (WHERE NOT regexp_full_match(trim({dur}), '{HMS_PATTERN[1:-1]}')) AS bad_duration",
    ]
    return "SELECT " + ", ".join(cols) + " FROM clips"


DETAIL = Block(
    "detail", _detail_frame, _detail_sql(),
    [Check(f"missing:detail.{f}", f, r, f"m_{f}", "n") for f, r in DETAIL_FIELDS]
    + [
        Check("missing:detail.platform", "platform", "warn_if_any", "m_pub_platform", "n_pub"),
        Check("missing:detail.published_url", "published_url", "warn_if_any", "m_pub_url", "n_pub"),
        Check("consistency:detail.published_without_platform", "platform", "warn_if_any", "m_pub_platform", "n_pub"),
        Check("consistency:detail.published_without_url", "published_url", "warn_if_any", "m_pub_url", "n_pub"),
        Check("coverage:detail.team_name", "team_name", "coverage", "unknown_team", "n"),
        Check("leakage:detail.qa_rows", "user_name", "fail_if_any", "qa_rows", "n"),
        Check("format:detail.duration", "duration", "warn_if_any", "bad_duration", "n"),
        Check("rowcount:detail", "", "rowcount", "n", "n"),
    ],
    ("clips",),
)


def _dup_frame_spark(df: DataFrame, key: list[str], n_col="n") -> DataFrame:
    """Rows beyond the first per key and number of repeated keys (Q04/Q05); null keys ignored."""
    k = df.where(F.greatest(*[F.col(c).isNull() for c in key]) == F.lit(False)) if len(key) > 1 else df.where(F.col(key[0]).isNotNull())
    per = k.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    g = per.agg(F.sum(F.col("_c") - 1).alias("dup_rows"), F.count_if(F.col("_c") > 1).alias("dup_keys"))
    tot = df.agg(F.count(F.lit(1)).alias(n_col))
    return with_scalars(g, tot).select(F.coalesce("dup_rows", F.lit(0)).alias("dup_rows"), "dup_keys", n_col)


def _dup_sql(src: str, key: list[str], extra_where: str = "") -> str:
    k = ", ".join(key)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in key)
    w = f"WHERE {nn}" + (f" AND {extra_where}" if extra_where else "")
    return f"""SELECT COALESCE(SUM(_c - 1), 0) AS dup_rows, COUNT(*) FILTER (WHERE _c > 1) AS dup_keys, (SELECT COUNT(*) FROM {src}) AS n
  FROM (SELECT {k}, COUNT(*) AS _c FROM {src} {w} GROUP BY {k}) g"""


DUP_VIDEO = Block(
    "detail", lambda dom: _dup_frame_spark(dom.clips("video_id"), ["video_id"]),
    _dup_sql("clips", ["video_id"]),
    [Check("duplicates:detail.video_id", "video_id", "fail_if_any", "dup_rows", "n"),
     Check("duplicates:detail.video_id_keys", "video_id", "fail_if_any", "dup_keys", "n")],
    ("clips",),
)


def _dup_headline(dom):
    c = dom.clips("headline")
    nonempty = c.where(~is_nullish("headline"))
    return with_scalars(_dup_frame_spark(nonempty, ["headline"]).drop("n"), c.agg(F.count(F.lit(1)).alias("n")))


DUP_HEADLINE = Block(
    "detail", _dup_headline,
    f"""SELECT COALESCE(SUM(_c - 1), 0) AS dup_rows, COUNT(*) FILTER (WHERE _c > 1) AS dup_keys, (SELECT COUNT(*) FROM clips) AS n
  FROM (SELECT headline, COUNT(*) AS _c FROM clips WHERE NOT {_nl_sql('headline')} GROUP BY headline) g""",
    [Check("duplicates:detail.headline", "headline", "warn_above", "dup_rows", "n", 0.05)],
    ("clips",),
)


def _monthly_frame(dom):
    m = monthly_mart(dom)
    return m.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.trim("month").rlike(MONTH_LABEL_PATTERN)).alias("bad_month"),
        F.count_if(~F.trim(hms_text("created_secs")).rlike(HMS_PATTERN)).alias("bad_dur"),
        F.count_if(F.col("published_count") > F.col("created_count")).alias("non_mono"),
        F.count_if(is_nullish("uploaded_count")).alias("m_uploaded"),
    )


MONTHLY = Block(
    "monthly", _monthly_frame,
    f"""SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT regexp_full_match(trim(month), '{MONTH_LABEL_PATTERN[1:-1]}')) AS bad_month,
       COUNT(*) FILTER (WHERE NOT regexp_full_match(trim({HMS_TEXT_SQL.format(s='created_secs')}), '{HMS_PATTERN[1:-1]}')) AS bad_dur,
       COUNT(*) FILTER (WHERE published_count > created_count) AS non_mono,
       COUNT(*) FILTER (WHERE {_nl_sql('uploaded_count')}) AS m_uploaded FROM mart_monthly""",
    [Check("rowcount:monthly", "", "rowcount12", "n", "n"),
     Check("format:monthly.month", "month", "warn_if_any", "bad_month", "n"),
     Check("format:monthly.created_duration", "created_duration", "warn_if_any", "bad_dur", "n"),
     Check("monotonicity:monthly", "", "fail_if_any", "non_mono", "n"),
     Check("missing:monthly.uploaded_count", "uploaded_count", "missing_fail", "m_uploaded", "n")],
    ("mart_monthly",),
)


def _users_frame(dom):
    m = marts_for(dom, "users")
    return m.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c) < 0).alias(f"neg_{c}") for c in ("uploaded_count", "created_count", "published_count")],
        F.count_if((F.col("publish_rate") < 0) | (F.col("publish_rate") > 100)).alias("rate_oob"),
        F.count_if(F.col("published_count") > F.col("created_count")).alias("non_mono"),
    )


USERS = Block(
    "users", _users_frame,
    "SELECT COUNT(*) AS n, " + ", ".join(f"COUNT(*) FILTER (WHERE {c} < 0) AS neg_{c}" for c in ("uploaded_count", "created_count", "published_count"))
    + ", COUNT(*) FILTER (WHERE publish_rate < 0 OR publish_rate > 100) AS rate_oob, COUNT(*) FILTER (WHERE published_count > created_count) AS non_mono FROM mart_users",
    [Check(f"negative:users.{c}", c, "fail_if_any", f"neg_{c}", "n") for c in ("uploaded_count", "created_count", "published_count")]
    + [Check("kpi_bounds:users.publish_rate", "publish_rate", "fail_if_any", "rate_oob", "n"),
       Check("monotonicity:users", "", "fail_if_any", "non_mono", "n"),
       Check("rowcount:users", "", "rowcount", "n", "n")],
    ("mart_users",),
)

DUP_USERS = Block(
    "users", lambda dom: _dup_frame_spark(marts_for(dom, "users"), ["user_name"]),
    _dup_sql("mart_users", ["user_name"]),
    [Check("duplicates:users.user_name", "user_name", "fail_if_any", "dup_rows", "n")],
    ("mart_users",),
)

DUP_CHANNEL_USER = Block(
    "channel_user", lambda dom: _dup_frame_spark(dom.clips("channel_name", "user_name"), ["channel_name", "user_name"]),
    _dup_sql("clips", ["channel_name", "user_name"]),
    [Check("duplicates:channel_user.pair", "channel_name,user_name", "warn_if_any", "dup_keys", "n")],
    ("clips",),
)


def missing_columns(spark, path: str, required: list[str]) -> list[str]:
    """Q10: required columns that a stored export's header lacks."""
    from tidemark.sources.exports import read_export

    header = {c.strip() for c in read_export(spark, path).columns}
    return [c for c in required if c not in header]


def _publishing_frame(dom):
    from tidemark.functions.expr import horizontal_sum
    from tidemark.operators.reshape import publishing_wide
    from tidemark.session import scratch_dir
    from tidemark.sources.exports import PLATFORM_TITLES, export_frame

    w = publishing_wide(dom)
    stored = scratch_dir(dom.spark, "publishing")
    export_frame(dom, "publishing.csv").write.option("header", True).csv(stored)
    # Rows for every channel (channels without any platform row are dead rows with all zeros).
    chans = dom.clips("channel_name").distinct()
    full = chans.join(w, "channel_name", "left").fillna(0, subset=WIDE_COLS)
    missing = missing_columns(dom.spark, stored, PLATFORM_TITLES)
    return full.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(horizontal_sum(WIDE_COLS) == 0).alias("dead"),
        F.lit(len(missing)).cast("bigint").alias("missing_cols"),
        F.lit(len(PLATFORM_TITLES)).cast("bigint").alias("n_cols"),
        F.count_if(F.least(*[F.col(c) for c in WIDE_COLS]) < 0).alias("neg"),
    )


PUBLISHING = Block(
    "publishing", _publishing_frame,
    """SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE p IS NULL) AS dead, 0 AS missing_cols, 26 AS n_cols, 0 AS neg
  FROM (SELECT DISTINCT channel_name FROM clips) c
  LEFT JOIN (SELECT channel_name AS cn, COUNT(*) AS p FROM clips WHERE platform IS NOT NULL GROUP BY 1) x ON c.channel_name = x.cn""",
    [Check("zero_pub:publishing.dead_channels", "", "warn_above", "dead", "n", 0.3),
     Check("columns:publishing.platforms", "", "required", "missing_cols", "n_cols"),
     Check("negative:publishing.platforms", "", "fail_if_any", "neg", "n")],
    ("clips",),
)

# Expected members of the language dimension (one is absent from the data on purpose).
EXPECTED_LANGUAGES = ["AMERICA", "ASIA", "ANTARCTICA"]


def _languages_frame(dom):
    m = marts_for(dom, "languages").select(F.lower(F.trim("language")).alias("v")).distinct()
    exp = dom.spark.createDataFrame([(v.lower(),) for v in EXPECTED_LANGUAGES], "v string")
    miss = exp.join(m, "v", "left_anti").agg(F.count(F.lit(1)).alias("missing_members"))
    return miss.select("missing_members", F.lit(len(EXPECTED_LANGUAGES)).cast("bigint").alias("n_expected"))


LANGUAGES = Block(
    "languages", _languages_frame,
    "SELECT COUNT(*) AS missing_members, " + str(len(EXPECTED_LANGUAGES)) + " AS n_expected FROM (VALUES "
    + ", ".join(f"('{v.lower()}')" for v in EXPECTED_LANGUAGES)
    + ") e(v) WHERE v NOT IN (SELECT DISTINCT lower(trim(language)) FROM mart_languages WHERE language IS NOT NULL)",
    [Check("required_values:languages.language", "language", "fail_if_any", "missing_members", "n_expected")],
    ("mart_languages",),
)

# Foreign keys of the raw tables: (fact, fk, dim, pk)
FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("customer", "c_nationkey", "nation", "n_nationkey")]


def _ref_frame(dom):
    """Orphans of each foreign key: a fact's keys are counted by value, a key at a time (one narrow
    column, and a hash table of that key's values only), and the counts of the values without a
    dimension row added up."""
    counts = None
    for i, (t, fk, dt, pk) in enumerate(FKS):
        g = dom.t(t).where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
        g = g.join(dom.t(dt).select(F.col(pk).alias(fk)), fk, "left_anti")
        one = g.agg(F.sum("n").alias("n")).select(F.lit(i).alias("fk"), "n")
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.unionByName(dom.t("lineitem").agg(F.count(F.lit(1)).alias("n")).select(F.lit(-1).alias("fk"), "n"))
    total = [F.coalesce(F.sum(F.when(F.col("fk") == i, F.col("n"))), F.lit(0)).alias(f"orph_{i}") for i in range(len(FKS))]
    return counts.agg(*total, F.coalesce(F.sum(F.when(F.col("fk") == -1, F.col("n"))), F.lit(0)).alias("n"))


REFERENTIAL = Block(
    "referential", _ref_frame,
    "SELECT " + ", ".join(
        f"(SELECT COUNT(*) FROM {t} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {dt})) AS orph_{i}"
        for i, (t, fk, dt, pk) in enumerate(FKS)) + ", (SELECT COUNT(*) FROM lineitem) AS n",
    [Check(f"referential:{t}.{fk}", fk, "fail_if_any", f"orph_{i}", "n") for i, (t, fk, dt, pk) in enumerate(FKS)],
)

BLOCKS = [DETAIL, DUP_VIDEO, DUP_HEADLINE, MONTHLY, USERS, DUP_USERS, DUP_CHANNEL_USER, PUBLISHING, LANGUAGES, REFERENTIAL]


CLIPS_READ = ["video_id", "upload_id", "user_name", "headline", "team_name", "input_type", "is_published", "platform", "published_url", "created_secs",
              "published_secs", "line_no", "channel_name", "upload_secs"]
UPLOADS_READ = ["upload_id", "user_name", "month", "language", "upload_secs", "created_count", "published_count", "created_secs", "published_secs"]


def run_all(spark, sf, blocks=BLOCKS) -> DataFrame:
    """Union of all check rows."""
    dom = StoredDomain(spark, sf, CLIPS_READ, UPLOADS_READ) if len(blocks) > 3 else D(spark, sf)
    out = None
    for b in blocks:
        r = _rows_spark(b.frame(dom), b)
        out = r if out is None else out.unionByName(r)
    return out


CHECKED_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region"]


def store_checks(spark, sf) -> DataFrame:
    """Run the suite and keep its rows under the state of the input files."""
    from tidemark.session import rename_path, scratch_dir

    path = _checks_path(spark, sf)
    made = scratch_dir(spark, "checks")
    run_all(spark, sf).coalesce(1).write.parquet(made)
    # A run over the same files that was faster wins; the rows are the same.
    return spark.read.parquet(path if rename_path(spark, made, path) else made)


def stored_checks(spark, sf) -> DataFrame:
    """The rows of the last run over these very files; runs the suite if there is none."""
    from tidemark.session import path_exists

    path = _checks_path(spark, sf)
    return spark.read.parquet(path) if path_exists(spark, path) else store_checks(spark, sf)


def _checks_path(spark, sf) -> str:
    """Named after the files' sizes and times, so changed tables are checked anew."""
    import hashlib

    from tidemark.session import ensure_checkpoint_dir, file_states
    from tidemark.sources.tables import table_path

    state = "\n".join(x for t in CHECKED_TABLES for x in file_states(spark, table_path(sf, t)))
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidemark-checks-{hashlib.sha256(state.encode()).hexdigest()[:24]}"


def _views(blocks):
    v = []
    for b in blocks:
        for x in b.views:
            if x not in v:
                v.append(x)
    return v


def run_all_sql(blocks=BLOCKS) -> str:
    return "\nUNION ALL ".join(_rows_sql(b, f"b{i}") for i, b in enumerate(blocks))


def _o(body: str, blocks=BLOCKS) -> str:
    return oracle(body, *_views(blocks), extra=[("checks", run_all_sql(blocks))])


def all_pass_rows(results: DataFrame) -> DataFrame:
    """Q18: one PASS row per table whose checks are all PASS."""
    g = results.groupBy("tbl").agg(F.count_if(F.col("status") != PASS).alias("bad"))
    return g.where(F.col("bad") == 0).select(
        F.concat(F.lit("all_checks:"), F.col("tbl")).alias("name"), F.lit(PASS).alias("status"), F.lit("no problems").alias("message"),
        F.lit(0).alias("count"), F.lit(0.0).alias("pct"), F.lit("").alias("field"), "tbl")


_ALLPASS_SQL = """SELECT 'all_checks:' || tbl AS name, 'PASS' AS status, 'no problems' AS message, 0 AS count, CAST(0.0 AS DOUBLE) AS pct, '' AS field, tbl
  FROM checks GROUP BY tbl HAVING COUNT(*) FILTER (WHERE status <> 'PASS') = 0"""


# ---------------------------------------------------------------------------------
# Keys: individual checks
# ---------------------------------------------------------------------------------
def _key_for(key: str, blocks: list, names: list | None = None):
    def fn(spark, sf):
        r = run_all(spark, sf, blocks)
        return r.where(F.col("name").isin(names)) if names else r

    where = "" if not names else " WHERE name IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    query(key, _o(f"SELECT * FROM checks{where}", blocks))(fn)


_key_for("q01_dq_row_count", [MONTHLY, USERS, DETAIL], ["rowcount:monthly", "rowcount:users", "rowcount:detail"])
_key_for("q02_dq_missing", [DETAIL], [f"missing:detail.{f}" for f, _ in DETAIL_FIELDS])
_key_for("q03_dq_missing_conditional", [DETAIL], ["missing:detail.platform", "missing:detail.published_url"])
_key_for("q04_dq_duplicates", [DUP_VIDEO, DUP_USERS])
_key_for("q05_dq_duplicates_composite", [DUP_CHANNEL_USER])
_key_for("q06_dq_duplicates_threshold", [DUP_HEADLINE])
_key_for("q07_dq_format_regex", [DETAIL, MONTHLY], ["format:detail.duration", "format:monthly.month", "format:monthly.created_duration"])
_key_for("q08_dq_monotonic", [MONTHLY, USERS], ["monotonicity:monthly", "monotonicity:users"])
_key_for("q09_dq_negative", [USERS, PUBLISHING], [f"negative:users.{c}" for c in ("uploaded_count", "created_count", "published_count")]
         + ["negative:publishing.platforms"])
_key_for("q10_dq_required_columns", [PUBLISHING], ["columns:publishing.platforms"])
_key_for("q11_dq_required_values", [LANGUAGES])
_key_for("q12_dq_dead_rows", [PUBLISHING], ["zero_pub:publishing.dead_channels"])
_key_for("q13_dq_consistency", [DETAIL], ["consistency:detail.published_without_platform", "consistency:detail.published_without_url"])
_key_for("q14_dq_referential", [REFERENTIAL])
_key_for("q15_dq_kpi_bounds", [USERS], ["kpi_bounds:users.publish_rate"])
_key_for("q16_dq_leakage", [DETAIL], ["leakage:detail.qa_rows"])
_key_for("q17_dq_coverage", [DETAIL], ["coverage:detail.team_name"])


@query("q18_dq_all_pass_row", _o(_ALLPASS_SQL))
def q18(spark, sf):
    return all_pass_rows(stored_checks(spark, sf))


@query("q20_dq_run_all", _o(f"SELECT * FROM checks UNION ALL {_ALLPASS_SQL}"))
def q20(spark, sf):
    r = store_checks(spark, sf)
    return r.unionByName(all_pass_rows(r))


@query("u05_union_checks", _o("SELECT * FROM checks"))
def u05(spark, sf):
    return stored_checks(spark, sf)


# ---------------------------------------------------------------------------------
# Q19: checks chosen from the schema by column names
# ---------------------------------------------------------------------------------
def auto_checks(df: DataFrame, tbl: str) -> DataFrame:
    """Counts (``*_count``) get missing + negative checks, ``*_duration`` text gets a format
    check, and a (created, published) pair gets a monotonicity check — one aggregation."""
    counts = [c for c in df.columns if c.endswith("_count")]
    durs = [c for c in df.columns if c.endswith("_duration")]
    aggs, checks = [F.count(F.lit(1)).alias("n")], []
    for c in counts:
        aggs += [F.count_if(is_nullish(c)).alias(f"m_{c}"), F.count_if(F.col(c) < 0).alias(f"neg_{c}")]
        checks += [Check(f"missing:{tbl}.{c}", c, "missing_fail", f"m_{c}", "n"), Check(f"negative:{tbl}.{c}", c, "fail_if_any", f"neg_{c}", "n")]
    for c in durs:
        aggs.append(F.count_if(~F.trim(c).rlike(HMS_PATTERN)).alias(f"fmt_{c}"))
        checks.append(Check(f"format:{tbl}.{c}", c, "warn_if_any", f"fmt_{c}", "n"))
    if "created_count" in counts and "published_count" in counts:
        aggs.append(F.count_if(F.col("published_count") > F.col("created_count")).alias("mono"))
        checks.append(Check(f"monotonicity:{tbl}", "", "fail_if_any", "mono", "n"))
    blk = Block(tbl, None, "", checks)
    return _rows_spark(df.agg(*aggs), blk)


@query("q19_dq_auto_columns", oracle(
    "SELECT * FROM checks", "mart_channels",
    extra=[("checks", _rows_sql(Block("channels", None,
        "SELECT COUNT(*) AS n, " + ", ".join(
            f"COUNT(*) FILTER (WHERE {_nl_sql(c)}) AS m_{c}, COUNT(*) FILTER (WHERE {c} < 0) AS neg_{c}"
            for c in ("uploaded_count", "created_count", "published_count"))
        + ", " + ", ".join(f"COUNT(*) FILTER (WHERE NOT regexp_full_match(trim({HMS_TEXT_SQL.format(s=s + '_secs')}), '{HMS_PATTERN[1:-1]}')) AS fmt_{s}_duration"
                           for s in ("uploaded", "created", "published"))
        + ", COUNT(*) FILTER (WHERE published_count > created_count) AS mono FROM mart_channels",
        [c for x in ("uploaded_count", "created_count", "published_count")
         for c in (Check(f"missing:channels.{x}", x, "missing_fail", f"m_{x}", "n"), Check(f"negative:channels.{x}", x, "fail_if_any", f"neg_{x}", "n"))]
        + [Check(f"format:channels.{s}_duration", f"{s}_duration", "warn_if_any", f"fmt_{s}_duration", "n") for s in ("uploaded", "created", "published")]
        + [Check("monotonicity:channels", "", "fail_if_any", "mono", "n")]), "b"))]))
def q19(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    m = m.select("channel_name", "uploaded_count", "created_count", "published_count",
                 *[hms_text(f"{s}_secs").alias(f"{s}_duration") for s in ("uploaded", "created", "published")])
    return auto_checks(m, "channels")


# ---------------------------------------------------------------------------------
# Reports over the check rows
# ---------------------------------------------------------------------------------
def file_scores(results: DataFrame, other_weight: int = 2) -> DataFrame:
    """Q21/Q25: per table fails, warns, score = max(0, 100 − 15·fail − 8·warn − w·other)."""
    g = results.groupBy("tbl").agg(
        F.count_if(F.col("status") == FAIL).alias("fails"),
        F.count_if(F.col("status") == WARN).alias("warns"),
        F.count_if(~F.col("status").isin(FAIL, WARN, PASS)).alias("others"),
        F.count(F.lit(1)).alias("checks"),
    )
    other = F.col("others") * other_weight
    score = F.greatest(F.lit(0), F.lit(100) - F.col("fails") * 15 - F.col("warns") * 8 - other).cast("int")
    return g.select("tbl", "fails", "warns", "checks", score.alias("score"),
                    F.when(F.col("fails") > 0, FAIL).when(F.col("warns") > 0, WARN).otherwise(PASS).alias("status"))


_SCORES_SQL = f"""SELECT tbl, CAST(COUNT(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS fails,
       CAST(COUNT(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS warns, CAST(COUNT(*) AS BIGINT) AS checks,
       CAST(GREATEST(0, 100 - 15 * COUNT(*) FILTER (WHERE status = 'FAIL') - 8 * COUNT(*) FILTER (WHERE status = 'WARN')) AS INTEGER) AS score,
       CASE WHEN COUNT(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN COUNT(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS status
  FROM checks GROUP BY tbl"""


@query("q21_dq_audit_report", _o(_SCORES_SQL))
def q21(spark, sf):
    return file_scores(stored_checks(spark, sf))


@query("q25_dq_file_score", _o(f"SELECT tbl, score FROM ({_SCORES_SQL}) s"))
def q25(spark, sf):
    return file_scores(stored_checks(spark, sf)).select("tbl", "score")


@query("a21_group_mean_score", _o(f"SELECT {round_sql('AVG(score)', 2)} AS mean_score FROM ({_SCORES_SQL}) s"))
def a21(spark, sf):
    return file_scores(stored_checks(spark, sf)).agg(round_half_up(F.avg("score"), 2).alias("mean_score"))


SAMPLES = 3


@query("q22_dq_audit_issue_samples", oracle(
    f"""SELECT 'detail.video_id' AS field, list(video_id ORDER BY video_id) AS samples FROM (
  SELECT video_id FROM clips GROUP BY video_id HAVING COUNT(*) > 1 ORDER BY video_id LIMIT {SAMPLES}) s""", "clips"))
def q22(spark, sf):
    c = D(spark, sf).clips("video_id")
    dups = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Bounded sample: a top-k (TakeOrderedAndProject), never a collect of all duplicate keys.
    top = dups.orderBy("video_id").limit(SAMPLES)
    return top.agg(F.array_sort(F.collect_list("video_id")).alias("samples")).select(F.lit("detail.video_id").alias("field"), "samples")


@query("q23_dq_overall_summary", _o(f"""SELECT CAST(COUNT(*) AS BIGINT) AS files, CAST(SUM(fails + warns) AS BIGINT) AS issues,
       CAST(SUM(fails) AS BIGINT) AS fails, CAST(SUM(warns) AS BIGINT) AS warns, {round_sql('AVG(score)', 2)} AS mean_score
  FROM ({_SCORES_SQL}) s"""))
def q23(spark, sf):
    s = file_scores(stored_checks(spark, sf))
    return s.agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("fails") + F.col("warns")).cast("bigint").alias("issues"),
                 F.sum("fails").cast("bigint").alias("fails"), F.sum("warns").cast("bigint").alias("warns"),
                 round_half_up(F.avg("score"), 2).alias("mean_score"))


PROFILE_FIELDS = ["headline", "team_name", "platform"]


@query("q24_dq_detail_profile", oracle(
    f"""WITH p AS (SELECT COUNT(*) AS total, """ + ", ".join(f"COUNT(*) FILTER (WHERE {_nl_sql(f)}) AS m_{f}" for f in PROFILE_FIELDS)
    + f""", COUNT(*) FILTER (WHERE team_name IS NULL) AS unknown_team,
       COUNT(*) FILTER (WHERE is_published AND platform IS NULL) AS published_no_platform FROM clips),
 d AS (SELECT COALESCE(SUM(c - 1), 0) AS dup_ids FROM (SELECT video_id, COUNT(*) AS c FROM clips GROUP BY video_id) x)
SELECT CAST(total AS BIGINT) AS total, """ + ", ".join(f"{round_sql(f'm_{f} * 100.0 / total', 2)} AS missing_{f}_pct" for f in PROFILE_FIELDS)
    + f""", CAST(dup_ids AS BIGINT) AS duplicate_ids, CAST(unknown_team AS BIGINT) AS unknown_team,
       CAST(published_no_platform AS BIGINT) AS published_no_platform,
       {round_sql('100.0 - (' + ' + '.join(f'{round_sql(f"m_{f} * 100.0 / total", 2)}' for f in PROFILE_FIELDS) + ') / 3', 2)} AS score
  FROM p, d""", "clips"))
def q24(spark, sf):
    c = D(spark, sf).clips("video_id", "headline", "team_name", "platform", "is_published")
    p = c.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_nullish(f)).alias(f"m_{f}") for f in PROFILE_FIELDS],
              F.count_if(F.col("team_name").isNull()).cast("bigint").alias("unknown_team"),
              F.count_if(F.col("is_published") & F.col("platform").isNull()).cast("bigint").alias("published_no_platform"))
    d = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_ids"))
    j = with_scalars(p, d)
    pct = {f: round_half_up(F.col(f"m_{f}") * F.lit(100.0) / F.col("total"), 2) for f in PROFILE_FIELDS}
    mean = (pct[PROFILE_FIELDS[0]] + pct[PROFILE_FIELDS[1]] + pct[PROFILE_FIELDS[2]]) / F.lit(3)
    return j.select("total", *[pct[f].alias(f"missing_{f}_pct") for f in PROFILE_FIELDS], "duplicate_ids", "unknown_team",
                    "published_no_platform", round_half_up(F.lit(100.0) - mean, 2).alias("score"))


@query("q26_dq_checks_by_file", _o("""SELECT tbl, CAST(COUNT(*) FILTER (WHERE status = 'PASS') AS BIGINT) AS pass,
       CAST(COUNT(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS warn, CAST(COUNT(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS fail,
       list_sort(list(name)) AS checks FROM checks GROUP BY tbl"""))
def q26(spark, sf):
    r = stored_checks(spark, sf)
    # The per-table list is bounded by the number of checks defined for that table.
    return r.groupBy("tbl").agg(F.count_if(F.col("status") == PASS).alias("pass"), F.count_if(F.col("status") == WARN).alias("warn"),
                                F.count_if(F.col("status") == FAIL).alias("fail"), F.array_sort(F.collect_list("name")).alias("checks"))


@query("a19_group_by_status_file", _o("""SELECT tbl, CAST(COUNT(*) FILTER (WHERE status = 'FAIL') AS BIGINT) AS "FAIL",
       CAST(COUNT(*) FILTER (WHERE status = 'WARN') AS BIGINT) AS "WARN", CAST(COUNT(*) FILTER (WHERE status = 'PASS') AS BIGINT) AS "PASS"
  FROM checks GROUP BY tbl"""))
def a19(spark, sf):
    r = stored_checks(spark, sf)
    p = r.groupBy("tbl").pivot("status", [FAIL, WARN, PASS]).count()
    return p.select("tbl", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in (FAIL, WARN, PASS)])


def status_rank(c: str = "status") -> Column:
    return F.when(F.col(c) == FAIL, 0).when(F.col(c) == WARN, 1).otherwise(2)


@query("o04_sort_status_rank", _o("SELECT name, status, tbl FROM checks"))
def o04(spark, sf):
    return stored_checks(spark, sf).orderBy(status_rank(), "tbl", "name").select("name", "status", "tbl")


@query("o05_sort_files_by_severity", _o(f"SELECT tbl, fails, warns FROM ({_SCORES_SQL}) s"))
def o05(spark, sf):
    return file_scores(stored_checks(spark, sf)).orderBy(F.col("fails").desc(), F.col("warns").desc(), "tbl").select("tbl", "fails", "warns")


def check_search(results: DataFrame, status: str | None, term: str | None) -> DataFrame:
    """status filter + case-insensitive substring over name, message or table."""
    r = results
    if status:
        r = r.where(F.col("status") == status)
    if term:
        t = term.lower()
        r = r.where(F.lower("name").contains(t) | F.lower("message").contains(t) | F.lower("tbl").contains(t))
    return r


@query("f15_check_search", _o("""SELECT * FROM checks WHERE status = 'WARN'
   AND (contains(lower(name), 'detail') OR contains(lower(message), 'detail') OR contains(lower(tbl), 'detail'))"""))
def f15(spark, sf):
    return check_search(stored_checks(spark, sf), WARN, "detail")


@query("k07_append_check_results", _o("SELECT * FROM checks"))
def k07(spark, sf):
    from tidemark.session import scratch_dir

    r = stored_checks(spark, sf).withColumn("ran_at", F.current_timestamp()).withColumn("run_date", F.to_date("ran_at"))
    path = scratch_dir(spark, "validation_results")
    # History partitioned by run date; this run's partition is replaced.
    r.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    return spark.read.parquet(path).select(*RESULT_COLS)
