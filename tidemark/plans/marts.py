"""Aggregate marts (the per-dimension tables every analytics query reads).

A mart row: ``<keys>, uploaded/created/published count, *_secs, *_mins, publish_rate (2 dp),
multiplication_ratio (4 dp), unpublished_gap``.

Two physical shapes, chosen by where the keys live:

* upload-level keys (user, input type, language, team, month): aggregate the order-level
  ``uploads`` view, which already carries per-order clip totals → one shuffle on the key
  (partial aggregation map-side).
* clip-level keys (channel, output type, platform): an upload spans several channels, so
  uploaded_count is the number of *distinct* uploads per key. Computed as two exact
  aggregations: (key, upload) → key. The first is partially aggregated map-side and the
  shuffle is keyed on (key, upload), so a hot key is spread over many uploads; no
  ``count(distinct)`` on one hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import multiplication_ratio, publish_rate, round_half_up, round_sql, unpublished_gap
from tidemark.sources.domain import Domain, oracle, register_oracle_view

UPLOAD_KEYS = {"user_name", "input_type", "language", "team_name", "month"}
CLIP_KEYS = {"channel_name", "output_type", "platform"}

# mart name -> key columns
MARTS = {
    "users": ["user_name"],
    "channels": ["channel_name"],
    "input_types": ["input_type"],
    "output_types": ["output_type"],
    "languages": ["language"],
    "teams": ["team_name"],
    "channel_user": ["channel_name", "user_name"],
}

COUNT_COLS = ["uploaded_count", "created_count", "published_count"]
SECS_COLS = ["uploaded_secs", "created_secs", "published_secs"]
MINS_COLS = ["uploaded_mins", "created_mins", "published_mins"]
KPI_COLS = ["publish_rate", "multiplication_ratio", "unpublished_gap"]
MART_VALUE_COLS = COUNT_COLS + SECS_COLS + MINS_COLS + KPI_COLS


def add_kpis(df: DataFrame) -> DataFrame:
    """Minutes from seconds, publish_rate (2 dp), multiplication_ratio (4 dp), gap."""
    return df.withColumns(
        {
            "uploaded_mins": F.col("uploaded_secs") / F.lit(60.0),
            "created_mins": F.col("created_secs") / F.lit(60.0),
            "published_mins": F.col("published_secs") / F.lit(60.0),
            "publish_rate": round_half_up(publish_rate("published_count", "created_count"), 2),
            "multiplication_ratio": round_half_up(multiplication_ratio("created_count", "uploaded_count"), 4),
            "unpublished_gap": unpublished_gap("created_count", "published_count"),
        }
    )


def mart(dom: Domain, keys: list[str]) -> DataFrame:
    if set(keys) <= UPLOAD_KEYS:
        u = dom.uploads(*keys, "upload_secs", "created_count", "published_count", "created_secs", "published_secs")
        g = u.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("uploaded_count"),
            F.sum("created_count").cast("bigint").alias("created_count"),
            F.sum("published_count").cast("bigint").alias("published_count"),
            F.sum("upload_secs").cast("bigint").alias("uploaded_secs"),
            F.sum("created_secs").cast("bigint").alias("created_secs"),
            F.sum("published_secs").cast("bigint").alias("published_secs"),
        )
    else:
        c = dom.clips(*keys, "upload_id", "upload_secs", "is_published", "created_secs", "published_secs")
        per = c.groupBy(*keys, "upload_id").agg(
            F.max("upload_secs").alias("u_secs"),
            F.count(F.lit(1)).alias("c"),
            F.count_if("is_published").alias("p"),
            F.sum("created_secs").alias("cs"),
            F.sum("published_secs").alias("ps"),
        )
        g = per.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("uploaded_count"),
            F.sum("c").cast("bigint").alias("created_count"),
            F.sum("p").cast("bigint").alias("published_count"),
            F.sum("u_secs").cast("bigint").alias("uploaded_secs"),
            F.sum("cs").cast("bigint").alias("created_secs"),
            F.sum("ps").cast("bigint").alias("published_secs"),
        )
    return add_kpis(g).select(*keys, *MART_VALUE_COLS)


def kpi_sql(prefix: str = "") -> str:
    p = prefix
    return f"""{p}uploaded_secs / 60.0 AS uploaded_mins, {p}created_secs / 60.0 AS created_mins,
       {p}published_secs / 60.0 AS published_mins,
       {round_sql(f"CAST({p}published_count AS DOUBLE) * 100.0 / NULLIF(CAST({p}created_count AS DOUBLE), 0)", 2)} AS publish_rate,
       {round_sql(f"CAST({p}created_count AS DOUBLE) / NULLIF(CAST({p}uploaded_count AS DOUBLE), 0)", 4)} AS multiplication_ratio,
       CAST({p}created_count - {p}published_count AS BIGINT) AS unpublished_gap"""


def mart_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    if set(keys) <= UPLOAD_KEYS:
        inner = f"""SELECT {k}, CAST(COUNT(*) AS BIGINT) AS uploaded_count, CAST(SUM(created_count) AS BIGINT) AS created_count,
         CAST(SUM(published_count) AS BIGINT) AS published_count, CAST(SUM(upload_secs) AS BIGINT) AS uploaded_secs,
         CAST(SUM(created_secs) AS BIGINT) AS created_secs, CAST(SUM(published_secs) AS BIGINT) AS published_secs
    FROM uploads GROUP BY {k}"""
    else:
        inner = f"""SELECT {k}, CAST(COUNT(*) AS BIGINT) AS uploaded_count, CAST(SUM(c) AS BIGINT) AS created_count,
         CAST(SUM(p) AS BIGINT) AS published_count, CAST(SUM(u_secs) AS BIGINT) AS uploaded_secs,
         CAST(SUM(cs) AS BIGINT) AS created_secs, CAST(SUM(ps) AS BIGINT) AS published_secs
    FROM (SELECT {k}, upload_id, MAX(upload_secs) AS u_secs, COUNT(*) AS c, COUNT(*) FILTER (WHERE is_published) AS p,
                 SUM(created_secs) AS cs, SUM(published_secs) AS ps
            FROM clips GROUP BY {k}, upload_id) per
   GROUP BY {k}"""
    return f"""SELECT {k}, uploaded_count, created_count, published_count, uploaded_secs, created_secs, published_secs,
       {kpi_sql()}
  FROM ({inner}) g"""


for _name, _keys in MARTS.items():
    register_oracle_view(
        f"mart_{_name}", mart_sql(_keys), ("uploads",) if set(_keys) <= UPLOAD_KEYS else ("clips",)
    )


# ---------------------------------------------------------------------------------
# Monthly mart (M25): month label + number + year, chronological order
# ---------------------------------------------------------------------------------
def monthly_mart(dom: Domain) -> DataFrame:
    m = mart(dom, ["month"])
    d = F.to_date(F.col("month"), "MMM, yyyy")
    return m.withColumns({"month_number": F.month(d), "year": F.year(d)})


MONTHLY_SQL = f"""SELECT m.*, CAST(month(strptime(month, '%b, %Y')) AS INTEGER) AS month_number,
       CAST(year(strptime(month, '%b, %Y')) AS INTEGER) AS year
  FROM ({mart_sql(["month"])}) m"""
register_oracle_view("mart_monthly", MONTHLY_SQL, ("uploads",))


def marts_for(dom: Domain, name: str) -> DataFrame:
    if name == "monthly":
        return monthly_mart(dom)
    return mart(dom, MARTS[name])


# ---------------------------------------------------------------------------------
# Publishing marts: channel × platform long form (R05) and the wide export form
# ---------------------------------------------------------------------------------
def publishing_long(dom: Domain) -> DataFrame:
    c = dom.clips("channel_name", "platform", "published_secs").where(F.col("platform").isNotNull())
    g = c.groupBy("channel_name", "platform").agg(
        F.count(F.lit(1)).alias("publish_count"),
        F.sum("published_secs").cast("bigint").alias("published_secs"),
    )
    return g.select("channel_name", "platform", "publish_count", (F.col("published_secs") / F.lit(60.0)).alias("published_mins"))


PUBLISHING_SQL = """SELECT channel_name, platform, CAST(COUNT(*) AS BIGINT) AS publish_count,
       CAST(SUM(published_secs) AS BIGINT) / 60.0 AS published_mins
  FROM clips WHERE platform IS NOT NULL GROUP BY channel_name, platform"""
register_oracle_view("mart_publishing", PUBLISHING_SQL, ("clips",))
