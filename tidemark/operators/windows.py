"""Window operators (survey §2.7, W01–W12).

Scale notes
-----------
* Per-group top-1 (W01–W03) windows are partitioned by the group key and run on the
  *aggregated* frame (one row per (group, member)), never on raw detail rows. The ordering
  carries an explicit unique tie-break so results are deterministic.
* Whole-frame windows (lag over months, σ over months) are only applied to frames that are
  already aggregated to one row per period (≤ a few hundred rows); shares of a total/max
  (W10–W12) join a one-row aggregate instead of a global window, so raw data never
  collapses into one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import growth_pct, round_half_up, round_sql, with_scalars
from tidemark.plans.marts import marts_for, monthly_mart
from tidemark.registry import query
from tidemark.sources.domain import Domain, oracle


def D(spark, sf):
    return Domain(spark, sf)


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int = 1, salt: list[str] | None = None,
                    buckets: int = 32) -> DataFrame:
    """Rows ranked 1..n per group by ``order`` (include a unique tie-break column).

    With ``salt`` the ranking runs in two exact stages: first inside (group, hash(salt) mod
    buckets), keeping n rows per bucket, then over the ≤ n·buckets survivors of each group — a
    hot group is spread over ``buckets`` tasks instead of one."""
    if salt:
        b = F.pmod(F.xxhash64(*[F.col(c) for c in salt]), F.lit(buckets))
        w1 = Window.partitionBy(*group, b).orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(w1)).where(F.col("_rn") <= n).drop("_rn")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top1_per_group(df: DataFrame, group: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """W01 as an aggregate: the first row per group by ``order`` = [(column, descending)], ties
    broken by the rest of the row. ``min(struct(keys…, row))`` is a partial + final aggregate,
    so a group holding a third of the rows is reduced map-side, never ranked in one task. An
    ascending key is its own column, so the row holds the other columns only.
    Descending keys must be numeric and non-null (they are negated)."""
    keys = []
    for i, (c, desc) in enumerate(order):
        if desc and dict(df.dtypes)[c] not in ("bigint", "int", "double", "float", "smallint", "tinyint"):
            raise ValueError(f"descending key {c} must be numeric")
        keys.append((-F.col(c) if desc else F.col(c)).alias(f"_k{i}"))
    at = {c: f"_b._k{i}" for i, (c, desc) in reversed(list(enumerate(order))) if not desc}
    rest = [c for c in df.columns if c not in group and c not in at]
    row = [F.struct(*[F.col(c) for c in rest]).alias("_row")] if rest else []
    best = df.groupBy(*group).agg(F.min(F.struct(*keys, *row)).alias("_b"))
    return best.select(*[F.col(c) if c in group else F.col(at.get(c, f"_b._row.{c}")).alias(c) for c in df.columns])


@query("w01_top1_per_group", oracle(
    """SELECT channel_name, user_name, created_count FROM (
  SELECT channel_name, user_name, created_count,
         ROW_NUMBER() OVER (PARTITION BY channel_name ORDER BY created_count DESC, user_name) AS rn
    FROM mart_channel_user) x WHERE rn = 1""", "mart_channel_user"))
def w01(spark, sf):
    m = marts_for(D(spark, sf), "channel_user").select("channel_name", "user_name", "created_count")
    return top1_per_group(m, ["channel_name"], [("created_count", True), ("user_name", False)])


@query("w02_top1_over_aggregate", oracle(
    """SELECT user_name, platform, n FROM (
  SELECT user_name, platform, COUNT(*) AS n,
         ROW_NUMBER() OVER (PARTITION BY user_name ORDER BY COUNT(*) DESC, platform) AS rn
    FROM clips WHERE platform IS NOT NULL GROUP BY user_name, platform) x WHERE rn = 1""", "clips"))
def w02(spark, sf):
    c = D(spark, sf).clips("user_name", "platform").where(F.col("platform").isNotNull())
    g = c.groupBy("user_name", "platform").agg(F.count(F.lit(1)).alias("n"))
    return top1_per_group(g, ["user_name"], [("n", True), ("platform", False)])


@query("w03_top1_after_unpivot", oracle(
    """SELECT channel_name, platform, publish_count FROM (
  SELECT channel_name, platform, publish_count,
         ROW_NUMBER() OVER (PARTITION BY channel_name ORDER BY publish_count DESC, platform) AS rn
    FROM mart_publishing) x WHERE rn = 1""", "mart_publishing"))
def w03(spark, sf):
    from tidemark.operators.reshape import melt_map, publishing_totals

    long = melt_map(publishing_totals(D(spark, sf)), "channel_name", "platform", "publish_count")
    # Lexicographic platform tie-break, same as the oracle.
    return top1_per_group(long, ["channel_name"], [("publish_count", True), ("platform", False)])


def _monthly(spark, sf):
    return monthly_mart(D(spark, sf))


def _chrono():
    return Window.orderBy("year", "month_number")


@query("w04_lag_growth", oracle(
    f"""SELECT month, created_count,
       {round_sql("(CAST(created_count AS DOUBLE) - CAST(LAG(created_count) OVER (ORDER BY year, month_number) AS DOUBLE)) * 100.0 / NULLIF(CAST(LAG(created_count) OVER (ORDER BY year, month_number) AS DOUBLE), 0)", 2)} AS growth_pct
  FROM mart_monthly""", "mart_monthly"))
def w04(spark, sf):
    m = _monthly(spark, sf)
    prev = F.lag("created_count").over(_chrono())
    return m.select("month", "created_count", round_half_up(growth_pct(F.col("created_count"), prev), 2).alias("growth_pct"))


@query("w05_previous_overlay", oracle(
    "SELECT month, published_count, LAG(published_count) OVER (ORDER BY year, month_number) AS prev_published FROM mart_monthly",
    "mart_monthly"))
def w05(spark, sf):
    m = _monthly(spark, sf)
    return m.select("month", "published_count", F.lag("published_count").over(_chrono()).alias("prev_published"))


@query("w06_latest_and_previous", oracle(
    """SELECT month, uploaded_count FROM mart_monthly ORDER BY year DESC, month_number DESC LIMIT 2""", "mart_monthly"))
def w06(spark, sf):
    m = _monthly(spark, sf)
    return m.orderBy(F.col("year").desc(), F.col("month_number").desc()).limit(2).select("month", "uploaded_count")


SIGMA = 2.0
MIN_PERIODS = 4


def sigma_anomaly(df: DataFrame, value: str, k: float = SIGMA, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Rows with |x − mean| > k·σ_pop, only when there are ≥ min_periods rows (aggregated input)."""
    stats = df.agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    j = with_scalars(df, stats)
    return j.where((F.col("_n") >= min_periods) & (F.abs(F.col(value) - F.col("_mu")) > F.lit(k) * F.col("_sd"))).drop("_mu", "_sd", "_n")


@query("w07_sigma_anomaly", oracle(
    f"""WITH s AS (SELECT AVG(published_count) AS mu, STDDEV_POP(published_count) AS sd, COUNT(*) AS n FROM mart_monthly)
SELECT month, published_count FROM mart_monthly, s WHERE n >= {MIN_PERIODS} AND abs(published_count - mu) > {SIGMA} * sd""",
    "mart_monthly"))
def w07(spark, sf):
    m = _monthly(spark, sf).select("month", "published_count")
    return sigma_anomaly(m, "published_count")


@query("w09_dedup_keep_first", oracle(
    """SELECT video_id, upload_id, created_secs, created_ts FROM (
  SELECT video_id, upload_id, created_secs, created_ts,
         ROW_NUMBER() OVER (PARTITION BY video_id ORDER BY created_ts, created_secs, upload_id) AS rn FROM clips) x WHERE rn = 1""",
    "clips"))
def w09(spark, sf):
    c = D(spark, sf).clips("video_id", "upload_id", "created_secs", "created_ts")
    return top1_per_group(c, ["video_id"], [("created_ts", False), ("created_secs", False), ("upload_id", False)])


@query("w10_share_of_max", oracle(
    f"""SELECT channel_name, published_count,
       {round_sql("CAST(published_count AS DOUBLE) / NULLIF(CAST(MAX(published_count) OVER () AS DOUBLE), 0)", 4)} AS share_of_max
  FROM mart_channels""", "mart_channels"))
def w10(spark, sf):
    m = marts_for(D(spark, sf), "channels").select("channel_name", "published_count")
    mx = m.agg(F.max("published_count").alias("_mx"))
    return with_scalars(m, mx).select("channel_name", "published_count",
                                  round_half_up(F.col("published_count").cast("double") / F.nullif(F.col("_mx").cast("double"), F.lit(0.0)), 4).alias("share_of_max"))


@query("w11_share_of_total", oracle(
    f"""SELECT platform, published,
       {round_sql("CAST(published AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(published) OVER () AS DOUBLE), 0)", 2)} AS share_pct
  FROM (SELECT platform, COUNT(*) AS published FROM clips WHERE platform IS NOT NULL GROUP BY platform) g""", "clips"))
def w11(spark, sf):
    c = D(spark, sf).clips("platform").where(F.col("platform").isNotNull())
    g = c.groupBy("platform").agg(F.count(F.lit(1)).alias("published"))
    tot = g.agg(F.sum("published").alias("_t"))
    return with_scalars(g, tot).select("platform", "published",
                                   round_half_up(F.col("published") * F.lit(100.0) / F.nullif(F.col("_t").cast("double"), F.lit(0.0)), 2).alias("share_pct"))


@query("w12_heat_intensity", oracle(
    f"""SELECT d1, d2, published_count,
       {round_sql("CAST(published_count AS DOUBLE) / GREATEST(CAST(MAX(published_count) OVER () AS DOUBLE), 1.0)", 4)} AS intensity
  FROM cross_pairs WHERE pair = 'input_type|platform'""", "cross_pairs"))
def w12(spark, sf):
    from tidemark.operators.aggregates import cross_marts

    x = cross_marts(D(spark, sf)).where(F.col("pair") == "input_type|platform").select("d1", "d2", "published_count")
    mx = x.agg(F.max("published_count").alias("_mx"))
    return with_scalars(x, mx).select("d1", "d2", "published_count",
                                  round_half_up(F.col("published_count") / F.greatest(F.col("_mx").cast("double"), F.lit(1.0)), 4).alias("intensity"))
