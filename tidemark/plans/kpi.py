"""KPI marts and metric queries (survey §2.10: M01–M35, T01–T02, A01 totals).

All metrics read the aggregate marts (``plans/marts.py``) or the order/clip views. One-row
metrics are single aggregates; "best/peak" rows use an argmax aggregate
(``min(struct(-value, tie))``) instead of a global sort or window, so they are a partial +
final aggregate whatever the data size. One-row aggregates are attached as scalar subqueries
(``with_scalars``: computed once, inlined; no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import (
    growth_pct,
    publish_rate,
    round_half_up,
    round_sql,
    safe_ratio,
    safe_ratio_pct,
    secs_to_hours,
    with_scalars,
)
from tidemark.plans.marts import MARTS, marts_for, monthly_mart, publishing_long
from tidemark.registry import query
from tidemark.sources.domain import QA_ACCOUNTS, Domain, oracle


def D(spark, sf) -> Domain:
    return Domain(spark, sf)


def argmax(value: str, tie: str, *carry: str, neg: bool = True):
    """Aggregate returning the struct of the row with the largest ``value`` (smallest ``tie`` on
    ties); rows without a value take no part."""
    v = -F.col(value) if neg else F.col(value)
    row = F.struct(v.alias("_v"), F.col(tie).alias(tie), *[F.col(c).alias(c) for c in carry])
    return F.min(F.when(F.col(value).isNotNull(), row))


def _pct2(a: str, b: str):
    return round_half_up(safe_ratio_pct(a, b), 2)


def _pct2_sql(a: str, b: str) -> str:
    return round_sql(f"CAST({a} AS DOUBLE) * 100.0 / NULLIF(CAST({b} AS DOUBLE), 0)", 2)


# ---------------------------------------------------------------------------------
# Marts as keys (N08 on every dimension, M25 monthly, R05 publishing)
# ---------------------------------------------------------------------------------
def _mart_key(name):
    def fn(spark, sf):
        return marts_for(D(spark, sf), name)

    return fn


for _name in MARTS:
    query(f"n08_add_kpis_{_name}", oracle(f"SELECT * FROM mart_{_name}", f"mart_{_name}"))(_mart_key(_name))


@query("m25_monthly_mart", oracle("SELECT * FROM mart_monthly", "mart_monthly"))
def m25_monthly_mart(spark, sf):
    return monthly_mart(D(spark, sf)).orderBy("year", "month_number")


@query("r05_publishing_long", oracle("SELECT * FROM mart_publishing", "mart_publishing"))
def r05_publishing_long(spark, sf):
    return publishing_long(D(spark, sf))


# ---------------------------------------------------------------------------------
# Flagship: monthly funnel (M25 + M26)
# ---------------------------------------------------------------------------------
def monthly_funnel(spark, sf) -> DataFrame:
    m = monthly_mart(D(spark, sf))
    return m.select(
        "month", "year", "month_number", "uploaded_count", "created_count", "published_count",
        round_half_up(safe_ratio_pct("created_count", "uploaded_count"), 2).alias("upload_to_create_pct"),
        round_half_up(safe_ratio_pct("published_count", "created_count"), 2).alias("create_to_publish_pct"),
    ).orderBy("year", "month_number")


@query(
    "m26_pipeline_conversion",
    oracle(
        f"""SELECT month, year, month_number, uploaded_count, created_count, published_count,
       {_pct2_sql('created_count', 'uploaded_count')} AS upload_to_create_pct,
       {_pct2_sql('published_count', 'created_count')} AS create_to_publish_pct
  FROM mart_monthly""",
        "mart_monthly",
    ),
)
def m26_pipeline_conversion(spark, sf):
    return monthly_funnel(spark, sf)


# ---------------------------------------------------------------------------------
# Per-entity KPI columns
# ---------------------------------------------------------------------------------
@query("m01_kpi_publish_rate", oracle(
    "SELECT channel_name, published_count, created_count, publish_rate FROM mart_channels", "mart_channels"))
def m01(spark, sf):
    return marts_for(D(spark, sf), "channels").select("channel_name", "published_count", "created_count", "publish_rate")


@query("m02_kpi_multiplication_ratio", oracle(
    "SELECT user_name, created_count, uploaded_count, multiplication_ratio FROM mart_users", "mart_users"))
def m02(spark, sf):
    return marts_for(D(spark, sf), "users").select("user_name", "created_count", "uploaded_count", "multiplication_ratio")


@query("m03_kpi_unpublished_gap", oracle(
    "SELECT input_type, created_count, published_count, unpublished_gap FROM mart_input_types", "mart_input_types"))
def m03(spark, sf):
    return marts_for(D(spark, sf), "input_types").select("input_type", "created_count", "published_count", "unpublished_gap")


@query("m04_kpi_active_channel_rate", oracle(
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_channels,
       CAST(COUNT(*) FILTER (WHERE published_count > 0) AS BIGINT) AS active_channels,
       {round_sql("CAST(COUNT(*) FILTER (WHERE published_count > 0) AS DOUBLE) * 100.0 / COUNT(*)", 2)} AS active_rate,
       {round_sql("CAST(COUNT(*) FILTER (WHERE published_count = 0) AS DOUBLE) * 100.0 / COUNT(*)", 2)} AS dead_rate
  FROM mart_channels""", "mart_channels"))
def m04(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    g = m.agg(
        F.count(F.lit(1)).alias("total_channels"),
        F.count_if(F.col("published_count") > 0).alias("active_channels"),
        F.count_if(F.col("published_count") == 0).alias("_dead"),
    )
    return g.select(
        "total_channels", "active_channels",
        round_half_up(F.col("active_channels") * F.lit(100.0) / F.col("total_channels"), 2).alias("active_rate"),
        round_half_up(F.col("_dead") * F.lit(100.0) / F.col("total_channels"), 2).alias("dead_rate"),
    )


def _mom(spark, sf):
    m = monthly_mart(D(spark, sf))
    w = Window.orderBy("year", "month_number")  # 12–80 rows: the aggregated frame, not raw data
    prev = F.lag("uploaded_count").over(w)
    return m.select(
        "month", "year", "month_number", "uploaded_count",
        prev.alias("prev_uploaded"),
        round_half_up(growth_pct(F.col("uploaded_count"), prev), 2).alias("mom_growth_pct"),
    )


@query("m05_kpi_mom_growth", oracle(
    f"""SELECT month, year, month_number, uploaded_count, prev_uploaded,
       {round_sql("(CAST(uploaded_count AS DOUBLE) - CAST(prev_uploaded AS DOUBLE)) * 100.0 / NULLIF(CAST(prev_uploaded AS DOUBLE), 0)", 2)} AS mom_growth_pct
  FROM (SELECT *, LAG(uploaded_count) OVER (ORDER BY year, month_number) AS prev_uploaded FROM mart_monthly) x""",
    "mart_monthly"))
def m05(spark, sf):
    return _mom(spark, sf)


# ---------------------------------------------------------------------------------
# Global totals and the one-row KPIs derived from them
# ---------------------------------------------------------------------------------
def totals(dom: Domain) -> DataFrame:
    """A01 over uploads: one scan of orders + one pre-aggregated scan of lineitem."""
    u = dom.uploads("upload_secs", "created_count", "published_count", "created_secs", "published_secs")
    return u.agg(
        F.count(F.lit(1)).alias("total_uploaded"),
        F.sum("created_count").cast("bigint").alias("total_created"),
        F.sum("published_count").cast("bigint").alias("total_published"),
        F.sum("upload_secs").cast("bigint").alias("uploaded_secs"),
        F.sum("created_secs").cast("bigint").alias("created_secs"),
        F.sum("published_secs").cast("bigint").alias("published_secs"),
    )


TOTALS_SQL = """SELECT CAST(COUNT(*) AS BIGINT) AS total_uploaded, CAST(SUM(created_count) AS BIGINT) AS total_created,
       CAST(SUM(published_count) AS BIGINT) AS total_published, CAST(SUM(upload_secs) AS BIGINT) AS uploaded_secs,
       CAST(SUM(created_secs) AS BIGINT) AS created_secs, CAST(SUM(published_secs) AS BIGINT) AS published_secs
  FROM uploads"""


@query("a01_global_sums", oracle(TOTALS_SQL, "uploads"))
def a01(spark, sf):
    return totals(D(spark, sf))


@query("m06_kpi_upload_to_publish", oracle(
    f"SELECT total_uploaded, total_published, {_pct2_sql('total_published', 'total_uploaded')} AS upload_to_publish_rate FROM t",
    "uploads", extra=[("t", TOTALS_SQL)]))
def m06(spark, sf):
    t = totals(D(spark, sf))
    return t.select("total_uploaded", "total_published", _pct2("total_published", "total_uploaded").alias("upload_to_publish_rate"))


@query("m07_kpi_waste_rate", oracle(
    f"SELECT {round_sql('100.0 - CAST(total_published AS DOUBLE) * 100.0 / NULLIF(CAST(total_created AS DOUBLE), 0)', 2)} AS waste_rate FROM t",
    "uploads", extra=[("t", TOTALS_SQL)]))
def m07(spark, sf):
    t = totals(D(spark, sf))
    return t.select(round_half_up(F.lit(100.0) - safe_ratio_pct("total_published", "total_created"), 2).alias("waste_rate"))


@query("m08_kpi_clips_per_publish", oracle(
    f"SELECT {round_sql('CAST(total_created AS DOUBLE) / NULLIF(CAST(total_published AS DOUBLE), 0)', 2)} AS clips_per_publish FROM t",
    "uploads", extra=[("t", TOTALS_SQL)]))
def m08(spark, sf):
    t = totals(D(spark, sf))
    return t.select(round_half_up(safe_ratio("total_created", "total_published"), 2).alias("clips_per_publish"))


@query("m09_kpi_compression_ratio", oracle(
    f"""SELECT month, uploaded_secs, created_secs,
       {round_sql('CAST(created_secs AS DOUBLE) / NULLIF(CAST(uploaded_secs AS DOUBLE), 0)', 3)} AS compression_ratio
  FROM mart_monthly""", "mart_monthly"))
def m09(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.select("month", "uploaded_secs", "created_secs",
                    round_half_up(safe_ratio("created_secs", "uploaded_secs"), 3).alias("compression_ratio"))


@query("m10_kpi_avg_duration", oracle(
    f"""SELECT month, {round_sql('CAST(uploaded_secs AS DOUBLE) / NULLIF(CAST(uploaded_count AS DOUBLE), 0) / 60.0', 2)} AS avg_upload_mins,
       {round_sql('CAST(created_secs AS DOUBLE) / NULLIF(CAST(created_count AS DOUBLE), 0) / 60.0', 2)} AS avg_clip_mins
  FROM mart_monthly""", "mart_monthly"))
def m10(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.select(
        "month",
        round_half_up(safe_ratio("uploaded_secs", "uploaded_count") / F.lit(60.0), 2).alias("avg_upload_mins"),
        round_half_up(safe_ratio("created_secs", "created_count") / F.lit(60.0), 2).alias("avg_clip_mins"),
    )


# Two named languages compared by M11 (regions of the driver data).
LANG_A, LANG_B = "AMERICA", "ASIA"


@query("m11_kpi_language_efficiency", oracle(
    f"""SELECT MAX(CASE WHEN language = '{LANG_A}' THEN publish_rate END) AS rate_a,
       MAX(CASE WHEN language = '{LANG_B}' THEN publish_rate END) AS rate_b,
       {round_sql(f"MAX(CASE WHEN language = '{LANG_A}' THEN publish_rate END) / NULLIF(MAX(CASE WHEN language = '{LANG_B}' THEN publish_rate END), 0)", 2)} AS a_to_b,
       {round_sql(f"MAX(CASE WHEN language = '{LANG_A}' THEN CAST(created_count AS DOUBLE) / NULLIF(published_count, 0) END)", 2)} AS gen_cost_a,
       {round_sql(f"MAX(CASE WHEN language = '{LANG_B}' THEN CAST(created_count AS DOUBLE) / NULLIF(published_count, 0) END)", 2)} AS gen_cost_b
  FROM mart_languages""", "mart_languages"))
def m11(spark, sf):
    m = marts_for(D(spark, sf), "languages")
    cost = F.col("created_count").cast("double") / F.nullif(F.col("published_count").cast("double"), F.lit(0.0))

    def pick(lang, c):
        return F.max(F.when(F.col("language") == lang, c))

    g = m.agg(
        pick(LANG_A, F.col("publish_rate")).alias("rate_a"),
        pick(LANG_B, F.col("publish_rate")).alias("rate_b"),
        pick(LANG_A, cost).alias("ca"),
        pick(LANG_B, cost).alias("cb"),
    )
    return g.select(
        "rate_a", "rate_b",
        round_half_up(F.col("rate_a") / F.nullif(F.col("rate_b"), F.lit(0.0)), 2).alias("a_to_b"),
        round_half_up(F.col("ca"), 2).alias("gen_cost_a"),
        round_half_up(F.col("cb"), 2).alias("gen_cost_b"),
    )


def _not_qa(c="user_name"):
    return ~F.lower(F.trim(F.col(c))).isin(QA_ACCOUNTS)


_QA_SQL = ", ".join(f"'{a}'" for a in QA_ACCOUNTS)


@query("m12_kpi_user_efficiency", oracle(
    f"""WITH u AS (SELECT * FROM mart_users WHERE lower(trim(user_name)) NOT IN ({_QA_SQL}))
SELECT (SELECT user_name FROM u ORDER BY created_count DESC, user_name LIMIT 1) AS top_volume_user,
       (SELECT user_name FROM u WHERE published_count >= 1 ORDER BY publish_rate DESC, user_name LIMIT 1) AS best_rate_user,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM u WHERE published_count = 0) AS zero_publish_users""", "mart_users"))
def m12(spark, sf):
    u = marts_for(D(spark, sf), "users").where(_not_qa())
    g = u.agg(
        argmax("created_count", "user_name").alias("top"),
        F.min(F.when(F.col("published_count") >= 1, F.struct((-F.col("publish_rate")).alias("_v"), F.col("user_name")))).alias("best"),
        F.count_if(F.col("published_count") == 0).alias("zero_publish_users"),
    )
    return g.select(F.col("top.user_name").alias("top_volume_user"), F.col("best.user_name").alias("best_rate_user"), "zero_publish_users")


@query("m13_kpi_best_channel", oracle(
    "SELECT channel_name, publish_rate FROM mart_channels ORDER BY publish_rate DESC NULLS LAST, channel_name LIMIT 1",
    "mart_channels"))
def m13(spark, sf):
    m = marts_for(D(spark, sf), "channels").where(F.col("publish_rate").isNotNull())
    g = m.agg(argmax("publish_rate", "channel_name").alias("b"))
    return g.select(F.col("b.channel_name").alias("channel_name"), (-F.col("b._v")).alias("publish_rate"))


@query("m14_kpi_contribution", oracle(
    f"""SELECT channel_name, published_count,
       {round_sql('CAST(published_count AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(published_count) OVER () AS DOUBLE), 0)', 2)} AS share_pct
  FROM mart_channels""", "mart_channels"))
def m14(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    # The total is a one-row aggregate attached as a scalar (no global window over rows).
    tot = m.agg(F.sum("published_count").alias("_tot"))
    return with_scalars(m, tot).select(
        "channel_name", "published_count", round_half_up(safe_ratio_pct("published_count", "_tot"), 2).alias("share_pct")
    )


@query("m15_kpi_peak_workload", oracle(
    f"""SELECT month, created_count, multiplication_ratio FROM mart_monthly
  ORDER BY created_count DESC, year, month_number LIMIT 1""", "mart_monthly"))
def m15(spark, sf):
    m = monthly_mart(D(spark, sf)).withColumn("_o", F.col("year") * 100 + F.col("month_number"))
    g = m.agg(argmax("created_count", "_o", "month", "created_count", "multiplication_ratio").alias("b"))
    return g.select("b.month", "b.created_count", "b.multiplication_ratio")


@query("m16_kpi_peak_value", oracle(
    "SELECT month, published_count FROM mart_monthly ORDER BY published_count DESC, year, month_number LIMIT 1",
    "mart_monthly"))
def m16(spark, sf):
    m = monthly_mart(D(spark, sf)).withColumn("_o", F.col("year") * 100 + F.col("month_number"))
    g = m.agg(argmax("published_count", "_o", "month", "published_count").alias("b"))
    return g.select("b.month", "b.published_count")


PERIOD_FROM, PERIOD_TO = "Dec, 1999", "Feb, 2000"


@query("m17_kpi_period_surge", oracle(
    f"""SELECT MAX(CASE WHEN month = '{PERIOD_FROM}' THEN uploaded_count END) AS from_uploaded,
       MAX(CASE WHEN month = '{PERIOD_TO}' THEN uploaded_count END) AS to_uploaded,
       {round_sql(f"(CAST(MAX(CASE WHEN month = '{PERIOD_TO}' THEN uploaded_count END) AS DOUBLE) - MAX(CASE WHEN month = '{PERIOD_FROM}' THEN uploaded_count END)) * 100.0 / NULLIF(CAST(MAX(CASE WHEN month = '{PERIOD_FROM}' THEN uploaded_count END) AS DOUBLE), 0)", 2)} AS surge_pct
  FROM mart_monthly""", "mart_monthly"))
def m17(spark, sf):
    m = monthly_mart(D(spark, sf)).where(F.col("month").isin(PERIOD_FROM, PERIOD_TO))
    g = m.agg(
        F.max(F.when(F.col("month") == PERIOD_FROM, F.col("uploaded_count"))).alias("from_uploaded"),
        F.max(F.when(F.col("month") == PERIOD_TO, F.col("uploaded_count"))).alias("to_uploaded"),
    )
    return g.select("from_uploaded", "to_uploaded",
                    round_half_up(growth_pct(F.col("to_uploaded"), F.col("from_uploaded")), 2).alias("surge_pct"))


PLATFORM_ONE = "Brand#1"


@query("m18_kpi_platform_workload", oracle(
    f"SELECT {round_sql(f'SUM(published_secs) FILTER (WHERE platform = {chr(39)}{PLATFORM_ONE}{chr(39)}) / 60.0', 2)} AS platform_published_mins FROM clips",
    "clips"))
def m18(spark, sf):
    # Whole seconds are added up and divided once, so the sum does not depend on the order.
    p = D(spark, sf).clips("platform", "published_secs").where(F.col("platform") == PLATFORM_ONE)
    return p.agg(round_half_up(F.sum("published_secs") / F.lit(60.0), 2).alias("platform_published_mins"))


@query("m19_kpi_unknown_attribution", oracle(
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, CAST(COUNT(*) FILTER (WHERE team_name IS NULL) AS BIGINT) AS unknown_rows,
       {round_sql("CAST(COUNT(*) FILTER (WHERE team_name IS NULL) AS DOUBLE) * 100.0 / COUNT(*)", 2)} AS unknown_pct
  FROM clips""", "clips"))
def m19(spark, sf):
    c = D(spark, sf).clips("team_name")
    g = c.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("team_name").isNull()).alias("unknown_rows"))
    return g.select("total_rows", "unknown_rows", round_half_up(safe_ratio_pct("unknown_rows", "total_rows"), 2).alias("unknown_pct"))


@query("m20_kpi_monthly_averages", oracle(
    f"""SELECT {round_sql('AVG(uploaded_count)', 2)} AS avg_uploaded, {round_sql('AVG(created_count)', 2)} AS avg_created,
       {round_sql('AVG(published_count)', 2)} AS avg_published FROM mart_monthly""", "mart_monthly"))
def m20(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.agg(
        round_half_up(F.avg("uploaded_count"), 2).alias("avg_uploaded"),
        round_half_up(F.avg("created_count"), 2).alias("avg_created"),
        round_half_up(F.avg("published_count"), 2).alias("avg_published"),
    )


# ---------------------------------------------------------------------------------
# M21 summary row and M22 funnel
# ---------------------------------------------------------------------------------
# The channel whose share of all published clips the summary reports.
SHARE_CHANNEL = "NATION_0"


def summary_stats(spark, sf) -> DataFrame:
    """One row of all headline figures; each part is one small aggregate attached as a scalar."""
    dom = D(spark, sf)
    t = totals(dom).select(
        "*",
        _pct2("total_published", "total_created").alias("publish_rate"),
        _pct2("total_published", "total_uploaded").alias("upload_to_publish_rate"),
        round_half_up(F.lit(100.0) - safe_ratio_pct("total_published", "total_created"), 2).alias("waste_rate"),
        round_half_up(safe_ratio("total_created", "total_uploaded"), 2).alias("multiplication_ratio"),
        round_half_up(safe_ratio("total_created", "total_published"), 2).alias("clips_per_publish"),
        round_half_up(F.col("uploaded_secs") / F.lit(60.0), 2).alias("total_uploaded_mins"),
        round_half_up(F.col("created_secs") / F.lit(60.0), 2).alias("total_created_mins"),
        round_half_up(F.col("published_secs") / F.lit(60.0), 2).alias("total_published_mins"),
        round_half_up(F.col("created_secs") / F.lit(3600.0), 2).alias("compute_hours"),
        round_half_up(F.col("published_secs") / F.lit(3600.0), 4).alias("published_hours"),
    ).drop("uploaded_secs", "created_secs", "published_secs")

    lang = marts_for(dom, "languages")

    def of(name, c):
        return F.max(F.when(F.col("language") == name, F.col(c)))

    lg = lang.agg(of(LANG_A, "publish_rate").alias("rate_a"), of(LANG_B, "publish_rate").alias("rate_b"),
                  of(LANG_A, "created_count").alias("ca"), of(LANG_A, "published_count").alias("pa"),
                  of(LANG_B, "created_count").alias("cb"), of(LANG_B, "published_count").alias("pb")).select(
        round_half_up(F.col("rate_a") / F.greatest("rate_b", F.lit(0.001)), 2).alias("language_multiplier"),
        F.col("rate_a").alias("language_rate_a"), F.col("rate_b").alias("language_rate_b"),
        round_half_up(F.col("ca") / F.greatest("pa", F.lit(1)).cast("double"), 0).alias("gen_cost_a"),
        round_half_up(F.col("cb") / F.greatest("pb", F.lit(1)).cast("double"), 0).alias("gen_cost_b"))

    ch = marts_for(dom, "channels").agg(
        F.count(F.lit(1)).alias("total_channels"),
        F.count_if(F.col("published_count") > 0).alias("active_channels"),
        argmax("publish_rate", "channel_name").alias("_best"),
        F.sum("published_count").alias("_all"),
        F.max(F.when(F.col("channel_name") == SHARE_CHANNEL, F.col("published_count"))).alias("_one"),
    ).select("total_channels", "active_channels",
             round_half_up(safe_ratio_pct("active_channels", "total_channels"), 2).alias("active_channel_ratio"),
             round_half_up((F.col("total_channels") - F.col("active_channels")) * F.lit(100.0) / F.col("total_channels"), 2).alias("dead_channel_pct"),
             F.col("_best.channel_name").alias("best_channel"), (-F.col("_best._v")).alias("best_channel_rate"),
             round_half_up(F.coalesce(safe_ratio_pct("_one", "_all"), F.lit(0.0)), 2).alias("channel_share_pct"))

    eff = F.when(F.col("published_count") > 0, round_half_up(safe_ratio_pct("published_count", "created_count"), 2))
    users = marts_for(dom, "users").where(_not_qa()).withColumn("_eff", eff)
    us = users.agg(
        argmax("uploaded_count", "user_name").alias("_u"),
        argmax("_eff", "user_name").alias("_e"),
        F.count_if(F.col("published_count") == 0).alias("zero_value_users"),
    ).select(F.col("_u.user_name").alias("top_volume_user"), (-F.col("_u._v")).alias("top_volume_uploads"),
             F.col("_e.user_name").alias("best_efficiency_user"), (-F.col("_e._v")).alias("best_efficiency_rate"), "zero_value_users")

    mm = monthly_mart(dom).withColumn("_o", F.col("year") * 100 + F.col("month_number")).agg(
        argmax("created_count", "_o", "month", "uploaded_count").alias("_pw"),
        argmax("published_count", "_o", "month").alias("_pv"),
        round_half_up(F.avg("uploaded_count"), 2).alias("avg_monthly_uploaded"),
        round_half_up(F.avg("created_count"), 2).alias("avg_monthly_created"),
        round_half_up(F.avg("published_count"), 2).alias("avg_monthly_published"),
        F.max(F.when(F.col("month") == PERIOD_FROM, F.col("uploaded_count"))).alias("_from"),
        F.max(F.when(F.col("month") == PERIOD_TO, F.col("uploaded_count"))).alias("_to"),
    ).select(F.col("_pw.month").alias("peak_workload_month"), (-F.col("_pw._v")).alias("peak_workload_clips"),
             round_half_up(-F.col("_pw._v") / F.nullif(F.col("_pw.uploaded_count").cast("double"), F.lit(0.0)), 2).alias("peak_slice_ratio"),
             F.col("_pv.month").alias("peak_published_month"), (-F.col("_pv._v")).alias("peak_published_clips"),
             "avg_monthly_uploaded", "avg_monthly_created", "avg_monthly_published",
             round_half_up(F.coalesce((F.coalesce("_to", F.lit(0)) - F.col("_from")) * F.lit(100.0) / F.nullif(F.col("_from").cast("double"), F.lit(0.0)), F.lit(0.0)), 1).alias("period_surge_pct"))

    # One pass over the clips for the platform's workload and the share of unknown teams.
    cl = dom.clips("platform", "published_secs", "team_name").agg(
        F.coalesce(F.sum(F.when(F.col("platform") == PLATFORM_ONE, F.col("published_secs"))), F.lit(0)).cast("bigint").alias("platform_workload_secs"),
        F.count_if(F.col("team_name").isNull()).alias("_u"), F.count(F.lit(1)).alias("_n"),
    ).select("platform_workload_secs", round_half_up(safe_ratio_pct("_u", "_n"), 2).alias("unknown_team_pct"))
    return with_scalars(t, lg, ch, us, mm, cl)


def _one(column: str, table: str, order: str) -> str:
    return f"(SELECT {column} FROM {table} ORDER BY {order} LIMIT 1)"


_EFF_SQL = round_sql("CAST(published_count AS DOUBLE) * 100.0 / created_count", 2)
_BY_CREATED, _BY_PUBLISHED = "created_count DESC, year, month_number", "published_count DESC, year, month_number"
_BEST_CHANNEL = "publish_rate DESC NULLS LAST, channel_name"
SUMMARY_SQL = f"""WITH t AS ({TOTALS_SQL}),
 u AS (SELECT * FROM mart_users WHERE lower(trim(user_name)) NOT IN ({_QA_SQL})),
 e AS (SELECT user_name, {_EFF_SQL} AS eff FROM u WHERE published_count > 0),
 la AS (SELECT publish_rate AS r, created_count AS c, published_count AS p FROM mart_languages WHERE language = '{LANG_A}'),
 lb AS (SELECT publish_rate AS r, created_count AS c, published_count AS p FROM mart_languages WHERE language = '{LANG_B}'),
 pf AS (SELECT MAX(uploaded_count) FILTER (WHERE month = '{PERIOD_FROM}') AS a, MAX(uploaded_count) FILTER (WHERE month = '{PERIOD_TO}') AS b FROM mart_monthly)
SELECT total_uploaded, total_created, total_published,
       {_pct2_sql('total_published', 'total_created')} AS publish_rate,
       {_pct2_sql('total_published', 'total_uploaded')} AS upload_to_publish_rate,
       {round_sql('100.0 - CAST(total_published AS DOUBLE) * 100.0 / NULLIF(CAST(total_created AS DOUBLE), 0)', 2)} AS waste_rate,
       {round_sql('CAST(total_created AS DOUBLE) / NULLIF(CAST(total_uploaded AS DOUBLE), 0)', 2)} AS multiplication_ratio,
       {round_sql('CAST(total_created AS DOUBLE) / NULLIF(CAST(total_published AS DOUBLE), 0)', 2)} AS clips_per_publish,
       {round_sql('uploaded_secs / 60.0', 2)} AS total_uploaded_mins, {round_sql('created_secs / 60.0', 2)} AS total_created_mins,
       {round_sql('published_secs / 60.0', 2)} AS total_published_mins,
       {round_sql('created_secs / 3600.0', 2)} AS compute_hours, {round_sql('published_secs / 3600.0', 4)} AS published_hours,
       {round_sql('(SELECT r FROM la) / greatest((SELECT r FROM lb), 0.001)', 2)} AS language_multiplier,
       (SELECT r FROM la) AS language_rate_a, (SELECT r FROM lb) AS language_rate_b,
       {round_sql('(SELECT c / CAST(greatest(p, 1) AS DOUBLE) FROM la)', 0)} AS gen_cost_a,
       {round_sql('(SELECT c / CAST(greatest(p, 1) AS DOUBLE) FROM lb)', 0)} AS gen_cost_b,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM mart_channels) AS total_channels,
       (SELECT CAST(COUNT(*) FILTER (WHERE published_count > 0) AS BIGINT) FROM mart_channels) AS active_channels,
       (SELECT {round_sql('COUNT(*) FILTER (WHERE published_count > 0) * 100.0 / COUNT(*)', 2)} FROM mart_channels) AS active_channel_ratio,
       (SELECT {round_sql('COUNT(*) FILTER (WHERE published_count = 0) * 100.0 / COUNT(*)', 2)} FROM mart_channels) AS dead_channel_pct,
       {_one('channel_name', 'mart_channels', _BEST_CHANNEL)} AS best_channel, {_one('publish_rate', 'mart_channels', _BEST_CHANNEL)} AS best_channel_rate,
       (SELECT {round_sql(f"COALESCE(MAX(published_count) FILTER (WHERE channel_name = '{SHARE_CHANNEL}') * 100.0 / NULLIF(CAST(SUM(published_count) AS DOUBLE), 0), 0.0)", 2)} FROM mart_channels) AS channel_share_pct,
       {_one('user_name', 'u', 'uploaded_count DESC, user_name')} AS top_volume_user, {_one('uploaded_count', 'u', 'uploaded_count DESC, user_name')} AS top_volume_uploads,
       {_one('user_name', 'e', 'eff DESC NULLS LAST, user_name')} AS best_efficiency_user, {_one('eff', 'e', 'eff DESC NULLS LAST, user_name')} AS best_efficiency_rate,
       (SELECT CAST(COUNT(*) FILTER (WHERE published_count = 0) AS BIGINT) FROM u) AS zero_value_users,
       {_one('month', 'mart_monthly', _BY_CREATED)} AS peak_workload_month, {_one('created_count', 'mart_monthly', _BY_CREATED)} AS peak_workload_clips,
       {round_sql(_one('created_count / NULLIF(CAST(uploaded_count AS DOUBLE), 0)', 'mart_monthly', _BY_CREATED), 2)} AS peak_slice_ratio,
       {_one('month', 'mart_monthly', _BY_PUBLISHED)} AS peak_published_month, {_one('published_count', 'mart_monthly', _BY_PUBLISHED)} AS peak_published_clips,
       (SELECT {round_sql('AVG(uploaded_count)', 2)} FROM mart_monthly) AS avg_monthly_uploaded,
       (SELECT {round_sql('AVG(created_count)', 2)} FROM mart_monthly) AS avg_monthly_created,
       (SELECT {round_sql('AVG(published_count)', 2)} FROM mart_monthly) AS avg_monthly_published,
       (SELECT {round_sql('COALESCE((COALESCE(b, 0) - a) * 100.0 / NULLIF(CAST(a AS DOUBLE), 0), 0.0)', 1)} FROM pf) AS period_surge_pct,
       (SELECT CAST(COALESCE(SUM(published_secs) FILTER (WHERE platform = '{PLATFORM_ONE}'), 0) AS BIGINT) FROM clips) AS platform_workload_secs,
       (SELECT {round_sql('COUNT(*) FILTER (WHERE team_name IS NULL) * 100.0 / COUNT(*)', 2)} FROM clips) AS unknown_team_pct
  FROM t"""
_SUMMARY_VIEWS = ("uploads", "clips", "mart_channels", "mart_users", "mart_languages", "mart_monthly")


@query("m21_summary_stats", oracle(SUMMARY_SQL, *_SUMMARY_VIEWS))
def m21(spark, sf):
    return summary_stats(spark, sf)


@query("m22_funnel", oracle(
    f"""SELECT total_uploaded AS uploaded, total_created AS created, total_published AS published,
       {_pct2_sql('total_created', 'total_uploaded')} AS upload_to_create_pct,
       {_pct2_sql('total_published', 'total_created')} AS create_to_publish_pct,
       CAST(total_created - total_published AS BIGINT) AS dropoff_create_to_publish,
       {round_sql('uploaded_secs / 60.0', 2)} AS uploaded_mins, {round_sql('created_secs / 60.0', 2)} AS created_mins,
       {round_sql('published_secs / 60.0', 2)} AS published_mins
  FROM t""", "uploads", extra=[("t", TOTALS_SQL)]))
def m22(spark, sf):
    t = totals(D(spark, sf))
    return t.select(
        F.col("total_uploaded").alias("uploaded"), F.col("total_created").alias("created"),
        F.col("total_published").alias("published"),
        _pct2("total_created", "total_uploaded").alias("upload_to_create_pct"),
        _pct2("total_published", "total_created").alias("create_to_publish_pct"),
        (F.col("total_created") - F.col("total_published")).cast("bigint").alias("dropoff_create_to_publish"),
        round_half_up(F.col("uploaded_secs") / F.lit(60.0), 2).alias("uploaded_mins"),
        round_half_up(F.col("created_secs") / F.lit(60.0), 2).alias("created_mins"),
        round_half_up(F.col("published_secs") / F.lit(60.0), 2).alias("published_mins"),
    )


# ---------------------------------------------------------------------------------
# M24 insight rules: one row per rule from the summary row
# ---------------------------------------------------------------------------------
# (id, category, severity SQL, title, title arguments, detail, detail arguments); the same text
# serves both engines, the thresholds are the reference's.
INSIGHTS = [
    ("funnel_dropoff", "Publishing Funnel", "CASE WHEN publish_rate < 5 THEN 'high' ELSE 'medium' END",
     "Only %.2f%% of created clips are published", "publish_rate", "%d clips were created but not published, %.2f%% of the compute", "total_created - total_published, waste_rate"),
    ("best_channel", "Channel Health", "'info'", "%s has the highest publish rate, %.2f%%", "best_channel, best_channel_rate", "%.2f%% of all channels publish", "active_channel_ratio"),
    ("dead_channels", "Channel Health", "CASE WHEN dead_channel_pct > 20 THEN 'high' ELSE 'medium' END",
     "%.2f%% of channels have published nothing", "dead_channel_pct", "%d of %d channels", "total_channels - active_channels, total_channels"),
    ("ai_multiplier", "AI Efficiency", "'info'", "%.2f clips are created per upload", "multiplication_ratio", "%.2f clips are created per published clip", "clips_per_publish"),
    ("language_gap", "Language", "'medium'", "Publish rate %.2f%% against %.2f%%", "language_rate_a, language_rate_b", "A factor of %.2f between the two languages", "language_multiplier"),
    ("data_quality_team", "Data Quality", "CASE WHEN unknown_team_pct > 50 THEN 'high' ELSE 'medium' END",
     "%.2f%% of videos name no team", "unknown_team_pct", "%d clips in all", "total_created"),
    ("user_highlights", "Users", "'info'", "%s uploads most", "top_volume_user", "%s publishes the largest share, %.2f%%", "best_efficiency_user, best_efficiency_rate"),
    ("zero_value_users", "Users", "'medium'", "%d users have published nothing", "zero_value_users", "%d clips are unpublished", "total_created - total_published"),
]


def _insights_sql() -> str:
    rows = [f"SELECT '{i}' AS id, '{c}' AS category, {sev} AS severity, printf('{t}', {ta}) AS title, printf('{d}', {da}) AS detail FROM s"
            + (" WHERE language_rate_a <> 0 AND language_rate_b <> 0" if i == "language_gap" else "") for i, c, sev, t, ta, d, da in INSIGHTS]
    return f"WITH s AS ({SUMMARY_SQL}) " + " UNION ALL ".join(rows)


@query("m24_insights_rules", oracle(_insights_sql(), *_SUMMARY_VIEWS))
def m24(spark, sf):
    rules = [f"named_struct('id', '{i}', 'category', '{c}', 'severity', {sev}, 'title', format_string('{t}', {ta}), 'detail', format_string('{d}', {da}))"
             for i, c, sev, t, ta, d, da in INSIGHTS]
    rows = summary_stats(spark, sf).select("language_rate_a", "language_rate_b", F.expr(f"inline(array({', '.join(rules)}))"))
    # The language rule needs both rates.
    both = F.coalesce((F.col("language_rate_a") != 0) & (F.col("language_rate_b") != 0), F.lit(False))
    return rows.where((F.col("id") != "language_gap") | both).select("id", "category", "severity", "title", "detail")


# ---------------------------------------------------------------------------------
# Dashboard derivations
# ---------------------------------------------------------------------------------
@query("m27_compute_efficiency", oracle(
    f"SELECT month, {round_sql('published_mins * 100.0 / NULLIF(created_mins, 0)', 2)} AS compute_efficiency FROM mart_monthly",
    "mart_monthly"))
def m27(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.select("month", round_half_up(safe_ratio_pct("published_mins", "created_mins"), 2).alias("compute_efficiency"))


@query("m28_channel_waste_top12", oracle(
    """SELECT channel_name, GREATEST(created_count - published_count, 0) AS waste FROM mart_channels
  ORDER BY waste DESC, channel_name LIMIT 12""", "mart_channels"))
def m28(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    w = F.greatest(F.col("created_count") - F.col("published_count"), F.lit(0)).cast("bigint")
    return m.select("channel_name", w.alias("waste")).orderBy(F.col("waste").desc(), "channel_name").limit(12)


@query("m29_user_compute_top10", oracle(
    f"""SELECT user_name, {round_sql('created_secs / 3600.0', 2)} AS created_hours FROM mart_users
  ORDER BY created_secs DESC, user_name LIMIT 10""", "mart_users"))
def m29(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.orderBy(F.col("created_secs").desc(), "user_name").limit(10).select(
        "user_name", secs_to_hours("created_secs").alias("created_hours"))


@query("m30_efficiency_scatter", oracle(
    f"""SELECT user_name, {round_sql('created_secs / 3600.0', 2)} AS created_hours, publish_rate FROM mart_users
  WHERE created_secs > 0""", "mart_users"))
def m30(spark, sf):
    m = marts_for(D(spark, sf), "users").where(F.col("created_secs") > 0)
    return m.select("user_name", secs_to_hours("created_secs").alias("created_hours"), "publish_rate")


@query("m31_category_breakdown", oracle(
    """SELECT 'language' AS category, language AS member, created_count, published_count, publish_rate FROM mart_languages
UNION ALL SELECT 'input_type', input_type, created_count, published_count, publish_rate FROM mart_input_types
UNION ALL SELECT 'output_type', output_type, created_count, published_count, publish_rate FROM mart_output_types""",
    "mart_languages", "mart_input_types", "mart_output_types"))
def m31(spark, sf):
    dom = D(spark, sf)
    parts = []
    for cat, name, key in (("language", "languages", "language"), ("input_type", "input_types", "input_type"),
                           ("output_type", "output_types", "output_type")):
        parts.append(marts_for(dom, name).select(
            F.lit(cat).alias("category"), F.col(key).alias("member"), "created_count", "published_count", "publish_rate"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("m32_duration_trend_hours", oracle(
    f"""SELECT month, {round_sql('uploaded_mins / 60.0', 2)} AS uploaded_hours, {round_sql('created_mins / 60.0', 2)} AS created_hours,
       {round_sql('published_mins / 60.0', 2)} AS published_hours FROM mart_monthly""", "mart_monthly"))
def m32(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.select("month", *[round_half_up(F.col(f"{s}_mins") / F.lit(60.0), 2).alias(f"{s}_hours")
                               for s in ("uploaded", "created", "published")])


@query("m33_stage_counts_detail", oracle(
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS uploaded, CAST(COUNT(created_ts) AS BIGINT) AS processed,
       CAST(COUNT(*) FILTER (WHERE is_published) AS BIGINT) AS published,
       CAST(SUM(created_secs) AS BIGINT) AS total_secs,
       CAST(SUM(created_secs) FILTER (WHERE created_ts IS NOT NULL) AS BIGINT) AS processed_secs,
       CAST(SUM(published_secs) AS BIGINT) AS published_secs,
       CASE WHEN COUNT(created_ts) > 0 THEN CAST(COUNT(*) FILTER (WHERE is_published) AS DOUBLE) / COUNT(created_ts) ELSE 0.0 END AS publish_rate
  FROM clips""", "clips"))
def m33(spark, sf):
    c = D(spark, sf).clips("created_ts", "is_published", "created_secs", "published_secs")
    g = c.agg(
        F.count(F.lit(1)).alias("uploaded"),
        F.count("created_ts").alias("processed"),
        F.count_if("is_published").alias("published"),
        F.sum("created_secs").cast("bigint").alias("total_secs"),
        F.sum(F.when(F.col("created_ts").isNotNull(), F.col("created_secs"))).cast("bigint").alias("processed_secs"),
        F.sum("published_secs").cast("bigint").alias("published_secs"),
    )
    return g.withColumn("publish_rate", F.when(F.col("processed") > 0, F.col("published") / F.col("processed")).otherwise(F.lit(0.0)))


@query("m34_kpi_platform_coverage", oracle(
    f"""SELECT CAST(COUNT(*) FILTER (WHERE is_published) AS BIGINT) AS published_rows,
       CAST(COUNT(*) FILTER (WHERE is_published AND platform IS NOT NULL) AS BIGINT) AS with_platform,
       {_pct2_sql('COUNT(*) FILTER (WHERE is_published AND platform IS NOT NULL)', 'COUNT(*) FILTER (WHERE is_published)')} AS platform_coverage
  FROM clips""", "clips"))
def m34(spark, sf):
    c = D(spark, sf).clips("is_published", "platform")
    g = c.agg(F.count_if("is_published").alias("published_rows"),
              F.count_if(F.col("is_published") & F.col("platform").isNotNull()).alias("with_platform"))
    return g.select("published_rows", "with_platform", _pct2("with_platform", "published_rows").alias("platform_coverage"))


@query("m35_kpi_team_coverage", oracle(
    f"""SELECT {round_sql("100.0 - CAST(COUNT(*) FILTER (WHERE team_name IS NULL) AS DOUBLE) * 100.0 / COUNT(*)", 2)} AS team_coverage
  FROM clips""", "clips"))
def m35(spark, sf):
    c = D(spark, sf).clips("team_name")
    g = c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("team_name").isNull()).alias("u"))
    return g.select(round_half_up(F.lit(100.0) - safe_ratio_pct("u", "n"), 2).alias("team_coverage"))


# ---------------------------------------------------------------------------------
# T01/T02 time grouping over events
# ---------------------------------------------------------------------------------
def _events(spark, sf):
    return D(spark, sf).t("events")


@query("t01_group_by_time", oracle(
    """SELECT 'day' AS granularity, strftime(date_trunc('day', ts), '%Y-%m-%d') AS bucket, CAST(COUNT(*) AS BIGINT) AS n
  FROM events WHERE ts IS NOT NULL GROUP BY 2
UNION ALL SELECT 'week', strftime(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d'), CAST(COUNT(*) AS BIGINT) FROM events WHERE ts IS NOT NULL GROUP BY 2
UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m'), CAST(COUNT(*) AS BIGINT) FROM events WHERE ts IS NOT NULL GROUP BY 2"""))
def t01(spark, sf):
    from tidemark.functions.expr import date_bucket

    e = _events(spark, sf).select("ts").where(F.col("ts").isNotNull())
    # One scan, three bucket columns, one aggregation over the exploded (granularity, bucket) pairs.
    b = e.select(F.inline(F.array(*[
        F.struct(F.lit("day").alias("granularity"), date_bucket("ts", "day").alias("bucket")),
        F.struct(F.lit("week").alias("granularity"), date_bucket("ts", "week", week_start="sunday").alias("bucket")),
        F.struct(F.lit("month").alias("granularity"), F.date_format("ts", "yyyy-MM").alias("bucket")),
    ])))
    return b.groupBy("granularity", "bucket").agg(F.count(F.lit(1)).alias("n"))


TRAILING_DAYS = 14


@query("t02_trailing_days_spine", oracle(
    f"""WITH mx AS (SELECT CAST(MAX(ts) AS DATE) AS d FROM events),
 spine AS (SELECT CAST(d - INTERVAL (i) DAY AS DATE) AS day FROM mx, range(0, {TRAILING_DAYS}) r(i)),
 c AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1)
SELECT strftime(spine.day, '%Y-%m-%d') AS day, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM spine LEFT JOIN c ON spine.day = c.day"""))
def t02(spark, sf):
    e = _events(spark, sf).select(F.to_date("ts").alias("day"))
    # The spine is bounded by TRAILING_DAYS rows; counts are aggregated only for the window.
    # One scan: counts per day (combined map-side); the last day is the largest of the counted days.
    counts = e.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    spine = counts.agg(F.max("day").alias("d")).select(F.explode(F.sequence(F.date_sub("d", TRAILING_DAYS - 1), F.col("d"))).alias("day"))
    return spine.join(counts, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
