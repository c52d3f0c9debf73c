"""Aggregations (survey §2.6, A02–A25).

Scale notes
-----------
* A04 builds all five dimension-pair marts with ONE ``GROUPING SETS`` aggregation: one scan of
  the detail rows, one shuffle (partial aggregation map-side keyed by the grouping-set id),
  instead of five scans and five shuffles.
* Distinct counts (A13) use Spark's exact distinct aggregation (Expand + two-level
  aggregate), which shuffles on (column, value), so a hot value is one row per partition
  after the partial step, not one task holding every row.
* Collected lists (A22) only gather *distinct* values per key (bounded by the dimension's
  cardinality), never raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import horizontal_sum, publish_rate, round_half_up, round_sql, status_label, unpublished_gap
from tidemark.plans.marts import marts_for, monthly_mart, publishing_long
from tidemark.registry import query
from tidemark.sources.domain import WIDE_COLS, Domain, oracle, register_oracle_view


def D(spark, sf):
    return Domain(spark, sf)


# ---------------------------------------------------------------------------------
# Dimension pairs over the detail rows
# ---------------------------------------------------------------------------------
CROSS_DIMS = ["user_name", "input_type", "platform", "published_status"]
CROSS_PAIRS = [
    ("user_name", "input_type"),
    ("user_name", "platform"),
    ("user_name", "published_status"),
    ("input_type", "platform"),
    ("input_type", "published_status"),
]


def detail_for_cross(dom: Domain) -> DataFrame:
    c = dom.clips("user_name", "input_type", "platform", "is_published")
    return c.select("user_name", "input_type", "platform", status_label("is_published").alias("published_status"), "is_published")


def _pair_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "publish_rate": round_half_up(publish_rate("published_count", "created_count"), 2),
        "unpublished_gap": unpublished_gap("created_count", "published_count"),
    })


def group_two_dims(df: DataFrame, d1: str, d2: str) -> DataFrame:
    """Per (d1, d2): count, published, rate, gap; rows with a null key are dropped."""
    g = df.where(F.col(d1).isNotNull() & F.col(d2).isNotNull()).groupBy(d1, d2).agg(
        F.count(F.lit(1)).alias("created_count"),
        F.count_if("is_published").alias("published_count"),
    )
    return _pair_stats(g)


def cross_marts(dom: Domain, pairs=CROSS_PAIRS) -> DataFrame:
    """Every pair in one aggregation; long output ``pair, d1, d2, …``. A row counts once for each
    pair whose two values it has; a group holds its pair's two values and two counts, nothing else."""
    x = detail_for_cross(dom)
    both = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("d1"), F.col(b).alias("d2")) for i, (a, b) in enumerate(pairs)])
    rows = x.select("is_published", F.inline(both)).where(F.col("d1").isNotNull() & F.col("d2").isNotNull())
    g = rows.groupBy("pair", "d1", "d2").agg(
        F.count(F.lit(1)).alias("created_count"),
        F.count_if("is_published").alias("published_count"),
    )
    names = F.array(*[F.lit(f"{a}|{b}") for a, b in pairs])
    return _pair_stats(g.withColumn("pair", F.element_at(names, F.col("pair") + 1)))


_DETAIL_SQL = """SELECT user_name, input_type, platform, is_published,
       CASE WHEN is_published THEN 'Published' WHEN NOT is_published THEN 'Not Published' ELSE 'Unknown' END AS published_status
  FROM clips"""
register_oracle_view("detail_x", _DETAIL_SQL, ("clips",))


def _pair_sql(a, b, src="detail_x"):
    return f"""SELECT '{a}|{b}' AS pair, CAST({a} AS VARCHAR) AS d1, CAST({b} AS VARCHAR) AS d2, CAST(COUNT(*) AS BIGINT) AS created_count,
       CAST(COUNT(*) FILTER (WHERE is_published) AS BIGINT) AS published_count
  FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}"""


_STATS_SQL = f"""{round_sql("CAST(published_count AS DOUBLE) * 100.0 / NULLIF(CAST(created_count AS DOUBLE), 0)", 2)} AS publish_rate,
       CAST(created_count - published_count AS BIGINT) AS unpublished_gap"""

CROSS_SQL = f"SELECT *, {_STATS_SQL} FROM (" + " UNION ALL ".join(_pair_sql(a, b) for a, b in CROSS_PAIRS) + ") u"
register_oracle_view("cross_pairs", CROSS_SQL, ("detail_x",))


@query("a03_group_two_dims", oracle(
    f"""SELECT user_name, input_type, created_count, published_count, {_STATS_SQL} FROM (
  SELECT user_name, input_type, CAST(COUNT(*) AS BIGINT) AS created_count,
         CAST(COUNT(*) FILTER (WHERE is_published) AS BIGINT) AS published_count
    FROM clips WHERE user_name IS NOT NULL AND input_type IS NOT NULL GROUP BY user_name, input_type) g""", "clips"))
def a03(spark, sf):
    c = D(spark, sf).clips("user_name", "input_type", "is_published")
    return group_two_dims(c, "user_name", "input_type")


@query("a04_cross_marts_all", oracle("SELECT * FROM cross_pairs", "cross_pairs"))
def a04(spark, sf):
    return cross_marts(D(spark, sf))


# ---------------------------------------------------------------------------------
# Simple aggregates
# ---------------------------------------------------------------------------------
@query("a02_count_star", oracle("SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem"))
def a02(spark, sf):
    return D(spark, sf).t("lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("a05_group_user_uploads_top5", oracle(
    "SELECT user_name, CAST(COUNT(*) AS BIGINT) AS uploads FROM uploads GROUP BY user_name ORDER BY uploads DESC, user_name LIMIT 5",
    "uploads"))
def a05(spark, sf):
    u = D(spark, sf).uploads("user_name")
    return u.groupBy("user_name").agg(F.count(F.lit(1)).alias("uploads")).orderBy(F.col("uploads").desc(), "user_name").limit(5)


@query("a06_group_platform_published", oracle(
    "SELECT platform, CAST(COUNT(*) AS BIGINT) AS published FROM clips WHERE is_published AND platform IS NOT NULL GROUP BY platform",
    "clips"))
def a06(spark, sf):
    c = D(spark, sf).clips("platform", "is_published").where(F.col("is_published") & F.col("platform").isNotNull())
    return c.groupBy("platform").agg(F.count(F.lit(1)).alias("published")).orderBy(F.col("published").desc(), "platform")


@query("a07_group_user_count_and_published", oracle(
    """SELECT user_name, CAST(COUNT(*) AS BIGINT) AS clips, CAST(SUM(CAST(is_published AS INTEGER)) AS BIGINT) AS published
  FROM clips GROUP BY user_name""", "clips"))
def a07(spark, sf):
    c = D(spark, sf).clips("user_name", "is_published")
    return c.groupBy("user_name").agg(F.count(F.lit(1)).alias("clips"),
                                      F.sum(F.col("is_published").cast("int")).cast("bigint").alias("published"))


@query("a08_count_filter", oracle(
    """SELECT input_type, CAST(COUNT(*) FILTER (WHERE is_published) AS BIGINT) AS published,
       CAST(COUNT(*) FILTER (WHERE NOT is_published) AS BIGINT) AS unpublished FROM clips GROUP BY input_type""", "clips"))
def a08(spark, sf):
    c = D(spark, sf).clips("input_type", "is_published")
    return c.groupBy("input_type").agg(F.count_if("is_published").alias("published"),
                                       F.count_if(~F.col("is_published")).alias("unpublished"))


@query("a09_sum_case", oracle(
    """SELECT output_type, CAST(SUM(CASE WHEN is_published THEN 1 ELSE 0 END) AS BIGINT) AS published,
       CAST(SUM(CASE WHEN platform IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_platform FROM clips GROUP BY output_type""", "clips"))
def a09(spark, sf):
    c = D(spark, sf).clips("output_type", "is_published", "platform")
    return c.groupBy("output_type").agg(
        F.sum(F.when(F.col("is_published"), 1).otherwise(0)).cast("bigint").alias("published"),
        F.sum(F.when(F.col("platform").isNull(), 1).otherwise(0)).cast("bigint").alias("no_platform"),
    )


PIVOT_MONTHS = ["Jan, 1998", "Feb, 1998", "Mar, 1998"]


@query("a10_max_case_pivot", oracle(
    "SELECT " + ", ".join(
        f"MAX(CASE WHEN month = '{m}' THEN uploaded_count END) AS m{i + 1}" for i, m in enumerate(PIVOT_MONTHS)
    ) + " FROM mart_monthly", "mart_monthly"))
def a10(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.agg(*[F.max(F.when(F.col("month") == mo, F.col("uploaded_count"))).alias(f"m{i + 1}") for i, mo in enumerate(PIVOT_MONTHS)])


@query("a11_avg_round", oracle(
    f"SELECT {round_sql('AVG(created_count)', 2)} AS avg_created, {round_sql('AVG(published_count)', 2)} AS avg_published FROM mart_channels",
    "mart_channels"))
def a11(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    return m.agg(round_half_up(F.avg("created_count"), 2).alias("avg_created"),
                 round_half_up(F.avg("published_count"), 2).alias("avg_published"))


@query("a12_argmax_row", oracle(
    "SELECT user_name, uploaded_count FROM mart_users ORDER BY uploaded_count DESC, user_name LIMIT 1", "mart_users"))
def a12(spark, sf):
    m = marts_for(D(spark, sf), "users")
    g = m.agg(F.min(F.struct((-F.col("uploaded_count")).alias("v"), F.col("user_name"))).alias("b"))
    return g.select(F.col("b.user_name").alias("user_name"), (-F.col("b.v")).alias("uploaded_count"))


@query("a13_distinct_count", oracle(
    """SELECT CAST(COUNT(DISTINCT user_name) AS BIGINT) AS users, CAST(COUNT(DISTINCT channel_name) AS BIGINT) AS channels,
       CAST(COUNT(DISTINCT platform) AS BIGINT) AS platforms, CAST(COUNT(DISTINCT headline) AS BIGINT) AS headlines FROM clips""",
    "clips"))
def a13(spark, sf):
    c = D(spark, sf).clips("user_name", "channel_name", "platform", "headline")
    return c.agg(*[F.count_distinct(x).alias(a) for x, a in (("user_name", "users"), ("channel_name", "channels"),
                                                              ("platform", "platforms"), ("headline", "headlines"))])


CATALOGUE_DIMS = [("channel", "channel_name"), ("platform", "platform"), ("output_type", "output_type")]


@query("a14_distinct_values_sorted", oracle(
    " UNION ".join(f"SELECT DISTINCT '{lbl}' AS label, {c} AS value FROM clips WHERE {c} IS NOT NULL" for lbl, c in CATALOGUE_DIMS),
    "clips"))
def a14(spark, sf):
    c = D(spark, sf).clips(*[x for _, x in CATALOGUE_DIMS])
    pairs = c.select(F.inline(F.array(*[F.struct(F.lit(l).alias("label"), F.col(x).alias("value")) for l, x in CATALOGUE_DIMS])))
    return pairs.where(F.col("value").isNotNull()).distinct().orderBy("label", "value")


@query("a15_conditional_fraction", oracle(
    f"""SELECT {round_sql('AVG(CASE WHEN published_count > 0 THEN 1 ELSE 0 END) * 100', 2)} AS active_pct,
       {round_sql('AVG(CASE WHEN published_count = 0 THEN 1 ELSE 0 END) * 100', 2)} AS dead_pct,
       {round_sql('AVG(CASE WHEN user_name IS NULL THEN 1 ELSE 0 END) * 100', 2)} AS unknown_pct FROM mart_channel_user""",
    "mart_channel_user"))
def a15(spark, sf):
    m = marts_for(D(spark, sf), "channel_user")

    def frac(p):
        return round_half_up(F.avg(F.when(p, 1).otherwise(0)) * F.lit(100), 2)

    return m.agg(frac(F.col("published_count") > 0).alias("active_pct"), frac(F.col("published_count") == 0).alias("dead_pct"),
                 frac(F.col("user_name").isNull()).alias("unknown_pct"))


@query("a16_group_sum_platform", oracle(
    """SELECT platform, CAST(SUM(publish_count) AS BIGINT) AS total FROM mart_publishing GROUP BY platform HAVING SUM(publish_count) > 0""",
    "mart_publishing"))
def a16(spark, sf):
    p = publishing_long(D(spark, sf))
    g = p.groupBy("platform").agg(F.sum("publish_count").cast("bigint").alias("total"))
    return g.where(F.col("total") > 0).orderBy(F.col("total").desc(), "platform")


@query("a17_group_sum_dim1", oracle(
    """SELECT pair, d1, CAST(SUM(COALESCE(NULLIF(created_count, 0), NULLIF(published_count, 0), 0)) AS BIGINT) AS volume
  FROM cross_pairs GROUP BY pair, d1""", "cross_pairs"))
def a17(spark, sf):
    x = cross_marts(D(spark, sf))
    vol = F.coalesce(F.nullif("created_count", F.lit(0)), F.nullif("published_count", F.lit(0)), F.lit(0))
    return x.groupBy("pair", "d1").agg(F.sum(vol).cast("bigint").alias("volume"))


@query("a18_group_ratio_dim1", oracle(
    f"""SELECT d1, {round_sql('CAST(SUM(published_count) AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(created_count) AS DOUBLE), 0)', 2)} AS rate
  FROM cross_pairs WHERE pair = 'user_name|platform' GROUP BY d1
 HAVING SUM(published_count) > 0 ORDER BY rate DESC, d1 LIMIT 12""", "cross_pairs"))
def a18(spark, sf):
    x = cross_marts(D(spark, sf)).where(F.col("pair") == "user_name|platform")
    g = x.groupBy("d1").agg(F.sum("published_count").alias("p"), F.sum("created_count").alias("c")).where(F.col("p") > 0)
    return g.select("d1", round_half_up(publish_rate("p", "c"), 2).alias("rate")).orderBy(F.col("rate").desc(), "d1").limit(12)


@query("a20_horizontal_sum", oracle(
    "SELECT channel_name, CAST(COUNT(*) AS BIGINT) AS total_published FROM clips WHERE platform IS NOT NULL GROUP BY channel_name",
    "clips"))
def a20(spark, sf):
    from tidemark.operators.reshape import publishing_wide

    w = publishing_wide(D(spark, sf))
    return w.select("channel_name", horizontal_sum(WIDE_COLS).cast("bigint").alias("total_published"))


@query("a22_group_list", oracle(
    "SELECT channel_name, list_sort(list(DISTINCT platform)) AS platforms FROM clips WHERE platform IS NOT NULL GROUP BY channel_name",
    "clips"))
def a22(spark, sf):
    c = D(spark, sf).clips("channel_name", "platform").where(F.col("platform").isNotNull())
    # Distinct first (bounded per key by the platform count), then the list.
    d = c.distinct()
    return d.groupBy("channel_name").agg(F.array_sort(F.collect_list("platform")).alias("platforms"))


@query("a23_max_timestamp", oracle("SELECT MAX(created_ts) AS latest FROM clips", "clips"))
def a23(spark, sf):
    return D(spark, sf).clips("created_ts").agg(F.max("created_ts").alias("latest"))


@query("a24_population_std", oracle(
    f"SELECT {round_sql('AVG(uploaded_count)', 4)} AS mean, {round_sql('STDDEV_POP(uploaded_count)', 4)} AS std FROM mart_monthly",
    "mart_monthly"))
def a24(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.agg(round_half_up(F.avg("uploaded_count"), 4).alias("mean"), round_half_up(F.stddev_pop("uploaded_count"), 4).alias("std"))


@query("a25_duration_sums", oracle(
    f"""SELECT 'uploads' AS tbl, {round_sql('SUM(upload_secs) / 60.0', 2)} AS minutes FROM uploads
UNION ALL SELECT 'clips', {round_sql('SUM(created_secs) / 60.0', 2)} FROM clips
UNION ALL SELECT 'published', {round_sql('SUM(published_secs) / 60.0', 2)} FROM clips""", "uploads", "clips"))
def a25(spark, sf):
    dom = D(spark, sf)
    u = dom.uploads("upload_secs").agg(F.lit("uploads").alias("tbl"), round_half_up(F.sum("upload_secs") / F.lit(60.0), 2).alias("minutes"))
    c = dom.clips("created_secs", "published_secs").agg(
        round_half_up(F.sum("created_secs") / F.lit(60.0), 2).alias("c"), round_half_up(F.sum("published_secs") / F.lit(60.0), 2).alias("p"))
    c = c.select(F.inline(F.array(F.struct(F.lit("clips").alias("tbl"), F.col("c").alias("minutes")),
                                  F.struct(F.lit("published").alias("tbl"), F.col("p").alias("minutes")))))
    return u.unionByName(c)
