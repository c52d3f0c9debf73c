"""Sort, limit, top-k, paging and set-style operators (survey §2.8 O- and U-keys).

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each partition keeps its own
top n and only n·partitions rows reach the final merge, so top-k never sorts the whole
input. Paging uses a stable unique sort key; deep pages use keyset paging (``after``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.marts import marts_for, monthly_mart, publishing_long
from tidemark.registry import query
from tidemark.sources.domain import Domain, oracle


def D(spark, sf):
    return Domain(spark, sf)


def sort_dynamic(df: DataFrame, by: str | None, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """Sort by the caller's column only when it exists."""
    if not by or by not in df.columns:
        return df
    c = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(c, *([tie] if tie else []))


def paginate(df: DataFrame, order: list, page: int, page_size: int) -> tuple[DataFrame, int, int]:
    """One page of rows + total rows + page count (offset paging; stable order required)."""
    total = df.count()
    pages = (total + page_size - 1) // page_size
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows, total, pages


def keyset_page(df: DataFrame, key: str, after, page_size: int) -> DataFrame:
    """O09 for deep pages: rows after the last key of the previous page (no offset scan)."""
    d = df if after is None else df.where(F.col(key) > F.lit(after))
    return d.orderBy(key).limit(page_size)


@query("o01_sort_dynamic", oracle("SELECT user_name, publish_rate FROM mart_users", "mart_users"))
def o01(spark, sf):
    m = marts_for(D(spark, sf), "users").select("user_name", "publish_rate")
    return sort_dynamic(m, "publish_rate", ascending=False, tie="user_name")


@query("o02_sort_chronological", oracle("SELECT month, uploaded_count FROM mart_monthly", "mart_monthly"))
def o02(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.orderBy(F.to_date("month", "MMM, yyyy")).select("month", "uploaded_count")


@query("o03_sort_multi_mixed", oracle("SELECT channel_name, platform, publish_count FROM mart_publishing", "mart_publishing"))
def o03(spark, sf):
    p = publishing_long(D(spark, sf)).select("channel_name", "platform", "publish_count")
    return p.orderBy(F.col("channel_name").asc(), F.col("publish_count").desc(), "platform")


@query("o06_limit_top1", oracle(
    "SELECT month, uploaded_count FROM mart_monthly ORDER BY uploaded_count DESC, year, month_number LIMIT 1", "mart_monthly"))
def o06(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.orderBy(F.col("uploaded_count").desc(), "year", "month_number").limit(1).select("month", "uploaded_count")


TOP_N = 8


@query("o07_limit_topn", oracle(
    f"SELECT channel_name, published_count FROM mart_channels ORDER BY published_count DESC, channel_name LIMIT {TOP_N}",
    "mart_channels"))
def o07(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    return m.orderBy(F.col("published_count").desc(), "channel_name").limit(TOP_N).select("channel_name", "published_count")


HEAD = 50


@query("o08_head_limit", oracle(f"SELECT user_name, created_count FROM mart_users ORDER BY user_name LIMIT {HEAD}", "mart_users"))
def o08(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.orderBy("user_name").limit(HEAD).select("user_name", "created_count")


PAGE, PAGE_SIZE = 3, 50


@query("o09_paginate", oracle(
    f"""SELECT user_name, created_count, (SELECT CAST(COUNT(*) AS BIGINT) FROM mart_users) AS total_rows,
       (SELECT CAST((COUNT(*) + {PAGE_SIZE - 1}) // {PAGE_SIZE} AS BIGINT) FROM mart_users) AS total_pages
  FROM mart_users ORDER BY user_name LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}""", "mart_users"))
def o09(spark, sf):
    m = marts_for(D(spark, sf), "users").select("user_name", "created_count")
    rows, total, pages = paginate(m, ["user_name"], PAGE, PAGE_SIZE)
    return rows.select("user_name", "created_count", F.lit(total).cast("bigint").alias("total_rows"),
                       F.lit(pages).cast("bigint").alias("total_pages"))


@query("o10_latest_n", oracle(
    "SELECT video_id, created_ts FROM clips ORDER BY created_ts DESC, video_id DESC LIMIT 10", "clips"))
def o10(spark, sf):
    c = D(spark, sf).clips("video_id", "created_ts")
    return c.orderBy(F.col("created_ts").desc(), F.col("video_id").desc()).limit(10)


@query("u01_distinct_rows", oracle("SELECT DISTINCT input_type, team_name FROM uploads", "uploads"))
def u01(spark, sf):
    return D(spark, sf).uploads("input_type", "team_name").distinct()


@query("u02_dedup_by_key", oracle("SELECT DISTINCT video_id FROM clips", "clips"))
def u02(spark, sf):
    return D(spark, sf).clips("video_id").dropDuplicates(["video_id"])


@query("u03_dedup_batch_report", oracle(
    """SELECT CAST(COUNT(*) AS BIGINT) AS rows_in, CAST(COUNT(DISTINCT video_id) AS BIGINT) AS rows_out,
       CAST(COUNT(*) - COUNT(DISTINCT video_id) AS BIGINT) AS removed FROM clips""", "clips"))
def u03(spark, sf):
    c = D(spark, sf).clips("video_id")
    # Two-level count (group by key, then sum) instead of count(distinct): one shuffle on the key.
    per = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    g = per.agg(F.sum("n").cast("bigint").alias("rows_in"), F.count(F.lit(1)).alias("rows_out"))
    return g.select("rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).cast("bigint").alias("removed"))


@query("u04_distinct_on", oracle(
    """SELECT DISTINCT ON (video_id) video_id, headline, created_secs FROM clips ORDER BY video_id, created_secs DESC, headline""",
    "clips"))
def u04(spark, sf):
    from tidemark.operators.windows import top1_per_group

    c = D(spark, sf).clips("video_id", "headline", "created_secs")
    return top1_per_group(c, ["video_id"], [("created_secs", True), ("headline", False)])


def ordered_dedup(lists: list[DataFrame], value: str) -> DataFrame:
    """Concatenate ranked lists (each with a ``pos`` column), keep the first position per value."""
    tagged = None
    for i, df in enumerate(lists):
        t = df.select(F.col(value), F.struct(F.lit(i).alias("list"), F.col("pos").cast("bigint").alias("pos")).alias("gpos"))
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy(value).agg(F.min("gpos").alias("gpos")).select(value, "gpos.list", "gpos.pos").orderBy("list", "pos")


@query("u06_ordered_dedup", oracle(
    """WITH a AS (SELECT user_name, ROW_NUMBER() OVER (ORDER BY created_count DESC, user_name) AS pos FROM mart_users),
 b AS (SELECT user_name, ROW_NUMBER() OVER (ORDER BY published_count DESC, user_name) AS pos FROM mart_users),
 c AS (SELECT user_name, ROW_NUMBER() OVER (ORDER BY uploaded_count DESC, user_name) AS pos FROM mart_users),
 t AS (SELECT user_name, 0 AS list, pos FROM a WHERE pos <= 5 UNION ALL SELECT user_name, 1, pos FROM b WHERE pos <= 5
       UNION ALL SELECT user_name, 2, pos FROM c WHERE pos <= 5)
SELECT user_name, CAST(MIN(list) AS INTEGER) AS list, arg_min(pos, list) AS pos FROM t GROUP BY user_name""", "mart_users"))
def u06(spark, sf):
    m = marts_for(D(spark, sf), "users")
    lists = []
    for c in ("created_count", "published_count", "uploaded_count"):
        top = m.orderBy(F.col(c).desc(), "user_name").limit(5).select("user_name", c)
        # Positions 1..5: a window over the bounded (5-row) top-k, in the same order.
        lists.append(top.withColumn("pos", F.row_number().over(Window.orderBy(F.col(c).desc(), "user_name"))))
    return ordered_dedup(lists, "user_name")


REQUIRED = {"clips": ["video_id", "user_name", "input_type", "published_url", "uploaded_by"]}


def set_difference_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns missing from / present in a frame, with the rows that hold a value
    (one aggregate over the present ones)."""
    have = set(df.columns)
    held = df.agg(*[F.count(F.col(c)).alias(c) for c in required if c in have], F.count(F.lit(1)).alias("_all"))
    rows = [F.struct(F.lit(c).alias("name"), F.lit("present" if c in have else "missing").alias("state"),
                     (F.col(c) if c in have else F.lit(0)).cast("bigint").alias("rows_with_value")) for c in required]
    return held.select(F.inline(F.array(*rows)))


@query("u07_set_difference_columns", oracle(
    """SELECT 'video_id' AS name, 'present' AS state, COUNT(video_id) AS rows_with_value FROM clips
UNION ALL SELECT 'user_name', 'present', COUNT(user_name) FROM clips UNION ALL SELECT 'input_type', 'present', COUNT(input_type) FROM clips
UNION ALL SELECT 'published_url', 'present', COUNT(published_url) FROM clips UNION ALL SELECT 'uploaded_by', 'missing', 0""", "clips"))
def u07(spark, sf):
    c = D(spark, sf).clips()
    return set_difference_columns(c, REQUIRED["clips"])
