"""Filters and predicates (survey §2.4, F01–F16).

Library functions take a DataFrame and return a filtered DataFrame; the predicates are
built-in column expressions, so Catalyst pushes those on raw columns into the Parquet scan
(``PushedFilters``) and the rest run inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import HMS_PATTERN, contains_ci, ieq
from tidemark.plans.marts import marts_for, monthly_mart
from tidemark.registry import query
from tidemark.sources.domain import QA_ACCOUNTS, QA_EXTRA_NAMES, QA_PREFIX, Domain, oracle

_QA_SQL = ", ".join(f"'{a}'" for a in QA_ACCOUNTS)
_QA_EXTRA_SQL = ", ".join(f"'{a}'" for a in QA_EXTRA_NAMES)


# ---------------------------------------------------------------------------------
# Library
# ---------------------------------------------------------------------------------
def qa_exact_mask(c: str = "user_name") -> Column:
    """True for QA accounts by the exact list (trimmed, case-insensitive)."""
    return F.coalesce(F.lower(F.trim(F.col(c))).isin(QA_ACCOUNTS), F.lit(False))


def qa_like_mask(c: str = "user_name") -> Column:
    """True for QA accounts by the prefix rule plus a short list of names."""
    return F.coalesce(F.col(c).like(QA_PREFIX + "%") | F.col(c).isin(QA_EXTRA_NAMES), F.lit(False))


def qa_exclude_exact(df: DataFrame, c: str = "user_name") -> DataFrame:
    """drop exact-list test accounts; null names are kept."""
    return df.where(~qa_exact_mask(c))


def qa_exclude_like(df: DataFrame, c: str = "user_name") -> DataFrame:
    """F02."""
    return df.where(~qa_like_mask(c))


def qa_only(df: DataFrame, c: str = "user_name") -> DataFrame:
    """F03."""
    return df.where(qa_like_mask(c))


def optional_filter_chain(df: DataFrame, filters: dict) -> DataFrame:
    """conjunction of only the supplied filters.

    keys: ``<col>`` for case-insensitive equality, ``is_published`` for a boolean,
    ``search`` for a case-insensitive headline substring. ``None`` values are skipped.
    """
    preds = []
    for k, v in filters.items():
        if v is None:
            continue
        if k == "is_published":
            preds.append(F.col("is_published") == F.lit(bool(v)))
        elif k == "search":
            preds.append(contains_ci("headline", v))
        else:
            preds.append(ieq(k, v))
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))


def year_filter(df: DataFrame, year: int) -> DataFrame:
    """monthly rows of one year; raises when the year has no rows."""
    out = df.where(F.col("year") == year)
    if out.isEmpty():
        raise ValueError(f"no monthly rows for year {year}")
    return out


def hms_text(secs: str) -> Column:
    """Seconds → 'h:mm:ss' text (hours may exceed 24)."""
    s = F.col(secs).cast("bigint")
    text = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit("null:null:null"))


HMS_TEXT_SQL = "printf('%d:%02d:%02d', CAST(floor({s} / 3600) AS BIGINT), CAST(floor(({s} % 3600) / 60) AS BIGINT), {s} % 60)"


# ---------------------------------------------------------------------------------
# Keys
# ---------------------------------------------------------------------------------
def D(spark, sf):
    return Domain(spark, sf)


@query("f01_qa_exclude_exact", oracle(
    f"SELECT user_name, created_count FROM mart_users WHERE NOT COALESCE(lower(trim(user_name)) IN ({_QA_SQL}), false)",
    "mart_users"))
def f01(spark, sf):
    return qa_exclude_exact(marts_for(D(spark, sf), "users")).select("user_name", "created_count")


@query("f02_qa_exclude_like", oracle(
    f"""SELECT user_name, created_count FROM mart_users
  WHERE NOT COALESCE(user_name LIKE '{QA_PREFIX}%' OR user_name IN ({_QA_EXTRA_SQL}), false)""", "mart_users"))
def f02(spark, sf):
    return qa_exclude_like(marts_for(D(spark, sf), "users")).select("user_name", "created_count")


@query("f03_qa_only", oracle(
    f"""SELECT user_name, created_count FROM mart_users
  WHERE user_name LIKE '{QA_PREFIX}%' OR user_name IN ({_QA_EXTRA_SQL})""", "mart_users"))
def f03(spark, sf):
    return qa_only(marts_for(D(spark, sf), "users")).select("user_name", "created_count")


CHANNEL_ONE = "nation_3"


@query("f04_ieq_filter", oracle(
    f"SELECT video_id, upload_id, is_published FROM clips WHERE lower(channel_name) = '{CHANNEL_ONE}'", "clips"))
def f04(spark, sf):
    c = D(spark, sf).clips("video_id", "upload_id", "is_published", "channel_name")
    return c.where(ieq("channel_name", CHANNEL_ONE)).select("video_id", "upload_id", "is_published")


@query("f05_bool_filter", oracle(
    "SELECT video_id, created_secs FROM clips WHERE is_published = true", "clips"))
def f05(spark, sf):
    c = D(spark, sf).clips("video_id", "created_secs", "is_published")
    return c.where(F.col("is_published") == F.lit(True)).select("video_id", "created_secs")


SEARCH_TERM = "Ring"


@query("f06_contains_filter", oracle(
    f"SELECT video_id, headline FROM clips WHERE COALESCE(contains(lower(headline), '{SEARCH_TERM.lower()}'), false)", "clips"))
def f06(spark, sf):
    c = D(spark, sf).clips("video_id", "headline")
    return c.where(contains_ci("headline", SEARCH_TERM))


CHAIN = {"user_name": None, "input_type": "1-urgent", "is_published": True, "search": "red", "team_name": None}


@query("f07_optional_filter_chain", oracle(
    """SELECT video_id, user_name, headline FROM clips
  WHERE lower(input_type) = '1-urgent' AND is_published = true AND COALESCE(contains(lower(headline), 'red'), false)""",
    "clips"))
def f07(spark, sf):
    c = D(spark, sf).clips("video_id", "user_name", "headline", "input_type", "is_published", "team_name")
    return optional_filter_chain(c, CHAIN).select("video_id", "user_name", "headline")


YEAR_ONE = 1998


@query("f08_year_filter", oracle(f"SELECT month, uploaded_count FROM mart_monthly WHERE year = {YEAR_ONE}", "mart_monthly"))
def f08(spark, sf):
    return year_filter(monthly_mart(D(spark, sf)), YEAR_ONE).select("month", "uploaded_count")


MONTH_ONE = "Mar, 1998"


@query("f09_label_equals", oracle(
    f"SELECT month, uploaded_count, created_count, published_count FROM mart_monthly WHERE month = '{MONTH_ONE}'", "mart_monthly"))
def f09(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.where(F.col("month") == MONTH_ONE).select("month", "uploaded_count", "created_count", "published_count")


@query("f10_positive_any", oracle(
    """SELECT channel_name, platform, publish_count, published_mins FROM (
  SELECT c.channel_name, p.platform, COALESCE(m.publish_count, 0) AS publish_count, m.published_mins
    FROM (SELECT DISTINCT channel_name FROM mart_publishing) c
   CROSS JOIN (SELECT DISTINCT platform FROM mart_publishing) p
    LEFT JOIN mart_publishing m ON m.channel_name = c.channel_name AND m.platform = p.platform) x
 WHERE publish_count > 0 OR COALESCE(published_mins > 0, false)""", "mart_publishing"))
def f10(spark, sf):
    from tidemark.operators.reshape import melt_platforms, publishing_totals, publishing_totals_secs

    dom = D(spark, sf)
    long = melt_platforms(publishing_totals(dom), publishing_totals_secs(dom))
    return long.where((F.col("publish_count") > 0) | F.coalesce(F.col("published_mins") > 0, F.lit(False)))


@query("f11_not_null_and_flag", oracle(
    "SELECT video_id, platform FROM clips WHERE is_published AND platform IS NOT NULL", "clips"))
def f11(spark, sf):
    c = D(spark, sf).clips("video_id", "platform", "is_published")
    return c.where(F.col("is_published") & F.col("platform").isNotNull()).select("video_id", "platform")


@query("f12_range_violation", oracle(
    """SELECT month, CAST(created_count AS DOUBLE) * 100.0 / NULLIF(CAST(uploaded_count AS DOUBLE), 0) AS create_pct
  FROM mart_monthly
 WHERE CAST(created_count AS DOUBLE) * 100.0 / NULLIF(CAST(uploaded_count AS DOUBLE), 0) < 0
    OR CAST(created_count AS DOUBLE) * 100.0 / NULLIF(CAST(uploaded_count AS DOUBLE), 0) > 100""", "mart_monthly"))
def f12(spark, sf):
    from tidemark.functions.expr import safe_ratio_pct

    m = monthly_mart(D(spark, sf)).select("month", safe_ratio_pct("created_count", "uploaded_count").alias("create_pct"))
    return m.where((F.col("create_pct") < 0) | (F.col("create_pct") > 100))


def _dur_text_spark(c: DataFrame) -> DataFrame:
    # Malformed values are injected by expression: every 7th line gets a trailing 'x'.
    t = hms_text("created_secs")
    return c.select("video_id", F.when(F.col("line_no") == 7, F.concat(t, F.lit("x"))).otherwise(t).alias("duration"))


_DUR_TEXT_SQL = f"""SELECT video_id, CASE WHEN line_no = 7 THEN {HMS_TEXT_SQL.format(s='created_secs')} || 'x'
       ELSE {HMS_TEXT_SQL.format(s='created_secs')} END AS duration FROM clips"""


@query("f13_regex_violation", oracle(
    f"SELECT video_id, duration FROM d WHERE NOT regexp_full_match(trim(duration), '{HMS_PATTERN[1:-1]}')",
    "clips", extra=[("d", _DUR_TEXT_SQL)]))
def f13(spark, sf):
    d = _dur_text_spark(D(spark, sf).clips("video_id", "line_no", "created_secs"))
    return d.where(~F.trim("duration").rlike(HMS_PATTERN))


@query("f14_nonzero_or_active_rows", oracle(
    "SELECT month, uploaded_count, created_count FROM mart_monthly WHERE uploaded_count > 0 OR created_count > 0",
    "mart_monthly"))
def f14(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.where((F.col("uploaded_count") > 0) | (F.col("created_count") > 0)).select("month", "uploaded_count", "created_count")


@query("f16_zero_publish_rows", oracle(
    "SELECT user_name, created_count FROM mart_users WHERE published_count = 0 AND created_count > 0", "mart_users"))
def f16(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.where((F.col("published_count") == 0) & (F.col("created_count") > 0)).select("user_name", "created_count")
