"""Joins (survey §2.5, J01–J12). Only equi-joins occur.

Broadcast policy: no hints. A side is broadcast when the planner or AQE measures it under
``spark.sql.autoBroadcastJoinThreshold`` bytes; otherwise the join shuffles on its key
(sort-merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import with_scalars
from tidemark.plans.marts import marts_for, monthly_mart, publishing_long
from tidemark.registry import query
from tidemark.sources.domain import Domain, oracle

def D(spark, sf):
    return Domain(spark, sf)


def _monthly_counts(dom):
    return monthly_mart(dom).select("month", "uploaded_count", "created_count", "published_count")


def _monthly_durations(dom):
    # Durations from the clip side (a separate source, as the reference's duration export).
    c = dom.clips("month", "created_secs", "published_secs")
    return c.groupBy("month").agg(F.sum("created_secs").cast("bigint").alias("created_secs"),
                                  F.sum("published_secs").cast("bigint").alias("published_secs"))


_MDUR_SQL = """SELECT month, CAST(SUM(created_secs) AS BIGINT) AS created_secs, CAST(SUM(published_secs) AS BIGINT) AS published_secs
  FROM clips GROUP BY month"""


@query("j01_join_month_left", oracle(
    """SELECT m.month, m.uploaded_count, m.created_count, m.published_count, d.created_secs, d.published_secs
  FROM mart_monthly m LEFT JOIN d ON m.month = d.month""", "mart_monthly", "clips", extra=[("d", _MDUR_SQL)]))
def j01(spark, sf):
    dom = D(spark, sf)
    return _monthly_counts(dom).join(_monthly_durations(dom), "month", "left")


@query("j02_join_composite_left", oracle(
    """SELECT c.channel_name, c.platform, c.publish_count, d.published_secs
  FROM (SELECT channel_name, platform, publish_count FROM mart_publishing) c
  LEFT JOIN (SELECT channel_name, platform, CAST(SUM(published_secs) AS BIGINT) AS published_secs FROM clips
              WHERE platform IS NOT NULL GROUP BY 1, 2) d ON c.channel_name = d.channel_name AND c.platform = d.platform""",
    "mart_publishing", "clips"))
def j02(spark, sf):
    dom = D(spark, sf)
    counts = publishing_long(dom).select("channel_name", "platform", "publish_count")
    durs = dom.clips("channel_name", "platform", "published_secs").where(F.col("platform").isNotNull()).groupBy(
        "channel_name", "platform").agg(F.sum("published_secs").cast("bigint").alias("published_secs"))
    return counts.join(durs, ["channel_name", "platform"], "left")


@query("j05_join_month_inner", oracle(
    """SELECT m.month, m.created_count, d.created_secs,
       CAST(d.created_secs AS DOUBLE) / NULLIF(CAST(m.created_count AS DOUBLE), 0) / 60.0 AS avg_clip_mins
  FROM mart_monthly m JOIN d ON m.month = d.month""", "mart_monthly", "clips", extra=[("d", _MDUR_SQL)]))
def j05(spark, sf):
    dom = D(spark, sf)
    j = _monthly_counts(dom).join(_monthly_durations(dom), "month", "inner")
    return j.select("month", "created_count", "created_secs",
                    (F.col("created_secs").cast("double") / F.nullif(F.col("created_count").cast("double"), F.lit(0.0)) / F.lit(60.0)).alias("avg_clip_mins"))


@query("j06_join_month_left_sql", oracle(
    """SELECT m.month, m.uploaded_count, d.published_secs
  FROM mart_monthly m LEFT JOIN d ON m.month = d.month""", "mart_monthly", "clips", extra=[("d", _MDUR_SQL)]))
def j06(spark, sf):
    dom = D(spark, sf)
    return spark.sql(
        "SELECT m.month, m.uploaded_count, d.published_secs FROM {m} m LEFT JOIN {d} d ON m.month = d.month",
        m=_monthly_counts(dom), d=_monthly_durations(dom),
    )


EXISTING_BEFORE = "1999-01-01"
BATCH_FROM = "1998-07-01"


def anti_existing_ids(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose key is not yet in ``existing`` (left-anti, shuffled on key)."""
    return batch.join(existing.select(key), key, "left_anti")


@query("j07_anti_existing_ids", oracle(
    f"""SELECT video_id, created_ts FROM clips b WHERE created_ts >= TIMESTAMP '{BATCH_FROM}'
   AND NOT EXISTS (SELECT 1 FROM clips e WHERE e.created_ts < TIMESTAMP '{EXISTING_BEFORE}' AND e.video_id = b.video_id)""",
    "clips"))
def j07(spark, sf):
    c = D(spark, sf).clips("video_id", "created_ts")
    batch = c.where(F.col("created_ts") >= F.lit(BATCH_FROM).cast("timestamp"))
    existing = c.where(F.col("created_ts") < F.lit(EXISTING_BEFORE).cast("timestamp"))
    return anti_existing_ids(batch, existing, "video_id")


ORPHAN_PART_SIZE = 45


def fk_orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Rows whose non-null foreign key has no dimension row (null-safe NOT IN)."""
    return fact.where(F.col(fk).isNotNull()).join(dim.select(F.col(pk).alias(fk)), fk, "left_anti")


@query("j08_fk_orphans_anti", oracle(
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS orphans FROM lineitem
 WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= {ORPHAN_PART_SIZE})"""))
def j08(spark, sf):
    dom = D(spark, sf)
    # Orphans are injected by restricting the dimension (the driver's keys all resolve).
    dim = dom.t("part").where(F.col("p_size") <= ORPHAN_PART_SIZE)
    return fk_orphans(dom.t("lineitem").select("l_partkey"), "l_partkey", dim, "p_partkey").agg(F.count(F.lit(1)).alias("orphans"))


SEMI_USERS = [f"Customer#{i:09d}" for i in (100, 200, 300, 400, 500)]


@query("j09_semi_in_list", oracle(
    "SELECT user_name, created_count FROM mart_users WHERE user_name IN (" + ", ".join(f"'{u}'" for u in SEMI_USERS) + ")",
    "mart_users"))
def j09(spark, sf):
    m = marts_for(D(spark, sf), "users")
    # A literal list is bounded: semi-join against a broadcast list DataFrame.
    lst = spark.createDataFrame([(u,) for u in SEMI_USERS], "user_name string")
    return m.join(lst, "user_name", "left_semi").select("user_name", "created_count")


@query("j10_scalar_subquery_row", oracle(
    f"""WITH u AS (SELECT * FROM mart_users)
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM u) AS users,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM u WHERE published_count = 0) AS zero_publish,
       (SELECT CAST(MAX(created_count) AS BIGINT) FROM u) AS max_created,
       (SELECT CAST(SUM(published_count) AS BIGINT) FROM u) AS published""", "mart_users"))
def j10(spark, sf):
    m = marts_for(D(spark, sf), "users")
    a = m.agg(F.count(F.lit(1)).alias("users"))
    b = m.where(F.col("published_count") == 0).agg(F.count(F.lit(1)).alias("zero_publish"))
    c = m.agg(F.max("created_count").cast("bigint").alias("max_created"))
    d = m.agg(F.sum("published_count").cast("bigint").alias("published"))
    return with_scalars(a, b, c, d)


DRILL_CHANNEL = "NATION_7"


@query("j12_drilldown_bundle", oracle(
    f"""SELECT 'channel' AS section, channel_name AS member, created_count AS value FROM mart_channels WHERE channel_name = '{DRILL_CHANNEL}'
UNION ALL SELECT 'user', user_name, created_count FROM mart_channel_user WHERE channel_name = '{DRILL_CHANNEL}'
UNION ALL SELECT 'platform', platform, publish_count FROM mart_publishing WHERE channel_name = '{DRILL_CHANNEL}'""",
    "mart_channels", "mart_channel_user", "mart_publishing"))
def j12(spark, sf):
    dom = D(spark, sf)
    ch = marts_for(dom, "channels").where(F.col("channel_name") == DRILL_CHANNEL).select(
        F.lit("channel").alias("section"), F.col("channel_name").alias("member"), F.col("created_count").alias("value"))
    us = marts_for(dom, "channel_user").where(F.col("channel_name") == DRILL_CHANNEL).select(
        F.lit("user").alias("section"), F.col("user_name").alias("member"), F.col("created_count").alias("value"))
    pl = publishing_long(dom).where(F.col("channel_name") == DRILL_CHANNEL).select(
        F.lit("platform").alias("section"), F.col("platform").alias("member"), F.col("publish_count").alias("value"))
    return ch.unionByName(us).unionByName(pl)
