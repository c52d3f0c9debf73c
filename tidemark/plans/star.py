"""Star schema: detail mart, dimensions with surrogate keys, fact table, repair and apportioning
(survey §2.10 E01–E06, M23; §2.5 J03/J04/J11; §2.7 W08; §2.2 K05).

Scale design
------------
* Surrogate ids (W08) are dense ranks of the natural key computed WITHOUT a single-partition
  window: the distinct keys are range-partitioned and sorted (distributed), each row gets
  ``monotonically_increasing_id`` (partition index in the high bits, position in the low
  bits), per-partition counts (one row per partition) give running offsets, and a broadcast
  join of that partition-count table (bounded by the partition count) turns positions into
  dense ids. The ranked frame is checkpointed (to the cluster's ``spark.checkpoint.dir``)
  so the two uses see the same ids even if tasks are retried.
* Fact ⟕ dimensions: small dimensions (input type, platform, team, date: bounded member
  counts) are broadcast; ``dim_user`` grows with the data, so its join is left to AQE
  (broadcast only when measured small, else sort-merge on the key, with skew splitting).
* Apportioning (E06) aggregates the fact per user first (one row per user), checks that
  frame's row count, and broadcasts it only under the bound; a hot user is then a map-side
  lookup, not one reducer holding a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import quarter_of_month, round_half_up, round_sql, with_scalars
from tidemark.operators.filters import qa_exact_mask
from tidemark.plans.marts import marts_for, monthly_mart
from tidemark.registry import query
from tidemark.sources.domain import QA_ACCOUNTS, Domain, oracle, register_oracle_view

UNKNOWN_INPUT = "unknown"
NOT_PUBLISHED = "Not Published"
UNKNOWN_TEAM = "Unknown"
_QA_SQL = ", ".join(f"'{a}'" for a in QA_ACCOUNTS)


def D(spark, sf):
    return Domain(spark, sf)


# ---------------------------------------------------------------------------------
# Detail mart (N16 / N09): defaults filled, one row per clip
# ---------------------------------------------------------------------------------
def detail_mart(dom: Domain) -> DataFrame:
    c = dom.clips("video_id", "headline", "user_name", "input_type", "platform", "team_name", "is_published",
                  "published_url", "month", "created_secs", "published_secs")
    return c.select(
        "video_id", "headline", F.col("user_name").alias("uploaded_by"),
        F.coalesce("input_type", F.lit(UNKNOWN_INPUT)).alias("input_type"),
        F.coalesce("platform", F.lit(NOT_PUBLISHED)).alias("published_platform"),
        F.coalesce("team_name", F.lit(UNKNOWN_TEAM)).alias("team_name"),
        "is_published", "published_url", "month", "created_secs", "published_secs",
    )


DETAIL_SQL = f"""SELECT video_id, headline, user_name AS uploaded_by, COALESCE(input_type, '{UNKNOWN_INPUT}') AS input_type,
       COALESCE(platform, '{NOT_PUBLISHED}') AS published_platform, COALESCE(team_name, '{UNKNOWN_TEAM}') AS team_name,
       is_published, published_url, month, created_secs, published_secs FROM clips"""
register_oracle_view("detail_mart", DETAIL_SQL, ("clips",))


# ---------------------------------------------------------------------------------
# Distributed dense surrogate ids
# ---------------------------------------------------------------------------------
def dense_ids(keys: DataFrame, order: list[str], id_col: str, checkpoint: bool = True) -> DataFrame:
    """Add ``id_col`` = 1-based dense rank of the (distinct) rows of ``keys`` ordered by ``order``
    (distributed: no single-partition window)."""
    d = keys.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        d = d.checkpoint(eager=True)
    d = d.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a tiny frame, the running sum is a window over it alone.
    offs = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = offs.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    out = d.join(offs, "_pid").withColumn(id_col, F.col("_off") + F.col("_pos") + 1)
    return out.drop("_mid", "_pid", "_pos", "_off")


DIM_SOURCES = {  # dim -> (detail column, dim value column, id column)
    "dim_user": ("uploaded_by", "user_name", "user_id"),
    "dim_input_type": ("input_type", "input_type_name", "input_type_id"),
    "dim_platform": ("published_platform", "platform_name", "platform_id"),
    "dim_team": ("team_name", "team_name", "team_id"),
}


def dim_values(detail: DataFrame) -> DataFrame:
    """Distinct (dim, value) members of every dimension from ONE scan and one shuffle of the
    detail rows; checkpointed (one row per member, far smaller than the detail)."""
    v = detail.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(src).alias("value"))
                                         for d, (src, _, _) in DIM_SOURCES.items()])))
    return v.distinct().checkpoint(eager=True)


def dim_date(dom: Domain) -> DataFrame:
    m = monthly_mart(dom).select("month", "year", "month_number").checkpoint(eager=True)
    d = dense_ids(m, ["year", "month_number"], "date_id")
    return d.select("date_id", "month", "year", "month_number", quarter_of_month("month_number").alias("quarter"))


DIM_SQL = {
    "dim_user": f"""SELECT CAST(DENSE_RANK() OVER (ORDER BY user_name NULLS FIRST) AS BIGINT) AS user_id, user_name,
       COALESCE(lower(trim(user_name)) IN ({_QA_SQL}), false) AS is_qa_account FROM (SELECT DISTINCT uploaded_by AS user_name FROM detail_mart) d""",
    "dim_input_type": """SELECT CAST(DENSE_RANK() OVER (ORDER BY input_type_name NULLS FIRST) AS BIGINT) AS input_type_id, input_type_name
  FROM (SELECT DISTINCT input_type AS input_type_name FROM detail_mart) d""",
    "dim_platform": """SELECT CAST(DENSE_RANK() OVER (ORDER BY platform_name NULLS FIRST) AS BIGINT) AS platform_id, platform_name
  FROM (SELECT DISTINCT published_platform AS platform_name FROM detail_mart) d""",
    "dim_team": """SELECT CAST(DENSE_RANK() OVER (ORDER BY team_name NULLS FIRST) AS BIGINT) AS team_id, team_name
  FROM (SELECT DISTINCT team_name FROM detail_mart) d""",
    "dim_date": """SELECT CAST(DENSE_RANK() OVER (ORDER BY year, month_number) AS BIGINT) AS date_id, month, year, month_number,
       CAST((month_number - 1) // 3 + 1 AS INTEGER) AS quarter FROM mart_monthly""",
}
for _k, _v in DIM_SQL.items():
    register_oracle_view(_k, _v, ("mart_monthly",) if _k == "dim_date" else ("detail_mart",))


class Star:
    """All star tables over one domain (lazy; dims are checkpointed when built)."""

    def __init__(self, dom: Domain):
        self.dom = dom
        self.detail = detail_mart(dom)
        self._dims = {}
        self._values = None

    def dim(self, name: str) -> DataFrame:
        if name not in self._dims:
            if name == "dim_date":
                self._dims[name] = dim_date(self.dom)
            else:
                if self._values is None:
                    self._values = dim_values(self.detail)
                _, col, id_col = DIM_SOURCES[name]
                vals = self._values.where(F.col("dim") == name).select(F.col("value").alias(col))
                d = dense_ids(vals, [col], id_col).select(id_col, col)
                if name == "dim_user":
                    d = d.withColumn("is_qa_account", qa_exact_mask("user_name"))
                self._dims[name] = d
        return self._dims[name]

    def fact(self, apportioned: bool = True, keys=None) -> DataFrame:
        """E04 + J03: per-clip fact, QA removed, surrogate keys attached by left joins.

        ``keys`` names the surrogate-key columns the caller reads (default: all five). Only
        their dimensions are built and joined: Catalyst cannot drop an unused left join by
        itself (it does not know the dimension keys are unique). Without ``apportioned`` the
        minute columns are 0.0 and the per-user totals are not computed at all."""
        keys = set(FACT_KEYS if keys is None else keys) | ({"user_id"} if apportioned else set())
        f = self.detail.where(~qa_exact_mask("uploaded_by"))
        pub = F.col("is_published").cast("int")
        f = f.select(
            "video_id", "headline", "uploaded_by", "input_type", "published_platform", "team_name", "month",
            "is_published", "published_url",
            F.lit(1).cast("bigint").alias("uploaded_count"), F.lit(1).cast("bigint").alias("created_count"),
            pub.cast("bigint").alias("published_count"),
            (pub * F.lit(100.0)).alias("publish_rate"), F.lit(1.0).alias("multiplication_ratio"),
            (F.lit(1) - pub).cast("bigint").alias("unpublished_gap"),
        )
        # AQE broadcasts a dimension when it measures it small; else a sort-merge on the name.
        for key in FACT_KEYS:
            if key not in keys:
                continue
            dim, on, name_col = FACT_KEY_DIMS[key]
            d = self.dim(dim).select(key, F.col(name_col).alias(on))
            f = f.join(d, on, "left")
        if apportioned:
            f = apportion(f, marts_for(self.dom, "users"))
        else:
            f = f.withColumns({"uploaded_mins": F.lit(0.0), "created_mins": F.lit(0.0), "published_mins": F.lit(0.0)})
        return f.select(*[c for c in FACT_COLS if c not in FACT_KEYS or c in keys])


# surrogate key -> (dimension, fact natural-key column, dimension name column)
FACT_KEY_DIMS = {
    "user_id": ("dim_user", "uploaded_by", "user_name"),
    "input_type_id": ("dim_input_type", "input_type", "input_type_name"),
    "platform_id": ("dim_platform", "published_platform", "platform_name"),
    "team_id": ("dim_team", "team_name", "team_name"),
    "date_id": ("dim_date", "month", "month"),
}
FACT_KEYS = list(FACT_KEY_DIMS)
FACT_COLS = ["video_id", "headline", "user_id", "input_type_id", "platform_id", "team_id", "date_id", "uploaded_count",
             "created_count", "published_count", "uploaded_mins", "created_mins", "published_mins", "is_published",
             "published_url", "publish_rate", "multiplication_ratio", "unpublished_gap"]


def apportion(fact: DataFrame, user_totals: DataFrame) -> DataFrame:
    """Per-user totals spread evenly over the user's rows (published minutes only over
    published rows), 4 dp; users without totals get 0."""
    per_user = fact.groupBy("user_id", "uploaded_by").agg(F.count(F.lit(1)).alias("_cnt"), F.sum(F.col("is_published").cast("int")).alias("_pub"))
    t = user_totals.select(F.col("user_name").alias("uploaded_by"), "uploaded_mins", "created_mins", "published_mins")
    shares = per_user.join(t, "uploaded_by", "left").select(
        "user_id",
        F.coalesce(round_half_up(F.col("uploaded_mins") / F.col("_cnt"), 4), F.lit(0.0)).alias("_u"),
        F.coalesce(round_half_up(F.col("created_mins") / F.col("_cnt"), 4), F.lit(0.0)).alias("_c"),
        F.coalesce(F.when(F.col("_pub") > 0, round_half_up(F.col("published_mins") / F.col("_pub"), 4)), F.lit(0.0)).alias("_p"),
    )
    j = fact.join(shares, "user_id", "left")
    return j.withColumns({
        "uploaded_mins": F.coalesce("_u", F.lit(0.0)),
        "created_mins": F.coalesce("_c", F.lit(0.0)),
        "published_mins": F.when(F.col("is_published"), F.coalesce("_p", F.lit(0.0))).otherwise(F.lit(0.0)),
    }).drop("_u", "_c", "_p")


FACT_SQL = f"""WITH f0 AS (
  SELECT d.*, u.user_id, i.input_type_id, p.platform_id, t.team_id, dd.date_id
    FROM detail_mart d
    LEFT JOIN dim_user u ON d.uploaded_by = u.user_name
    LEFT JOIN dim_input_type i ON d.input_type = i.input_type_name
    LEFT JOIN dim_platform p ON d.published_platform = p.platform_name
    LEFT JOIN dim_team t ON d.team_name = t.team_name
    LEFT JOIN dim_date dd ON d.month = dd.month
   WHERE NOT COALESCE(lower(trim(d.uploaded_by)) IN ({_QA_SQL}), false)),
 pu AS (SELECT user_id, uploaded_by, COUNT(*) AS cnt, SUM(CAST(is_published AS INTEGER)) AS pub FROM f0 GROUP BY 1, 2),
 sh AS (SELECT pu.user_id, COALESCE({round_sql('m.uploaded_mins / pu.cnt', 4)}, 0.0) AS su,
               COALESCE({round_sql('m.created_mins / pu.cnt', 4)}, 0.0) AS sc,
               COALESCE(CASE WHEN pu.pub > 0 THEN {round_sql('m.published_mins / pu.pub', 4)} END, 0.0) AS sp
          FROM pu LEFT JOIN mart_users m ON pu.uploaded_by = m.user_name)
SELECT f0.video_id, f0.headline, f0.user_id, f0.input_type_id, f0.platform_id, f0.team_id, f0.date_id,
       CAST(1 AS BIGINT) AS uploaded_count, CAST(1 AS BIGINT) AS created_count, CAST(f0.is_published AS BIGINT) AS published_count,
       COALESCE(sh.su, 0.0) AS uploaded_mins, COALESCE(sh.sc, 0.0) AS created_mins,
       CASE WHEN f0.is_published THEN COALESCE(sh.sp, 0.0) ELSE 0.0 END AS published_mins,
       f0.is_published, f0.published_url, CAST(CAST(f0.is_published AS INTEGER) AS DOUBLE) * 100.0 AS publish_rate, 1.0 AS multiplication_ratio,
       CAST(1 - CAST(f0.is_published AS INTEGER) AS BIGINT) AS unpublished_gap
  FROM f0 LEFT JOIN sh ON f0.user_id = sh.user_id"""
register_oracle_view("fact_video", FACT_SQL, ("detail_mart", "dim_user", "dim_input_type", "dim_platform", "dim_team", "dim_date", "mart_users"))


# ---------------------------------------------------------------------------------
# Keys
# ---------------------------------------------------------------------------------
@query("n16_video_list_clean", oracle("SELECT * FROM detail_mart", "detail_mart"))
def n16(spark, sf):
    return detail_mart(D(spark, sf))


@query("n09_fill_defaults", oracle(
    "SELECT input_type, published_platform, team_name, CAST(COUNT(*) AS BIGINT) AS n FROM detail_mart GROUP BY ALL", "detail_mart"))
def n09(spark, sf):
    return detail_mart(D(spark, sf)).groupBy("input_type", "published_platform", "team_name").agg(F.count(F.lit(1)).alias("n"))


@query("e01_dim_build", oracle(
    """SELECT 'input_type' AS dim, input_type_id AS id, input_type_name AS name FROM dim_input_type
UNION ALL SELECT 'platform', platform_id, platform_name FROM dim_platform
UNION ALL SELECT 'team', team_id, team_name FROM dim_team""", "dim_input_type", "dim_platform", "dim_team"))
def e01(spark, sf):
    s = Star(D(spark, sf))
    a = s.dim("dim_input_type").select(F.lit("input_type").alias("dim"), F.col("input_type_id").alias("id"), F.col("input_type_name").alias("name"))
    b = s.dim("dim_platform").select(F.lit("platform").alias("dim"), F.col("platform_id").alias("id"), F.col("platform_name").alias("name"))
    c = s.dim("dim_team").select(F.lit("team").alias("dim"), F.col("team_id").alias("id"), F.col("team_name").alias("name"))
    return a.unionByName(b).unionByName(c)


@query("e02_dim_user_qa_flag", oracle("SELECT * FROM dim_user", "dim_user"))
def e02(spark, sf):
    return Star(D(spark, sf)).dim("dim_user")


@query("w08_surrogate_key", oracle("SELECT user_id, user_name FROM dim_user", "dim_user"))
def w08(spark, sf):
    return Star(D(spark, sf)).dim("dim_user").select("user_id", "user_name")


@query("e03_dim_date_build", oracle("SELECT * FROM dim_date", "dim_date"))
def e03(spark, sf):
    return Star(D(spark, sf)).dim("dim_date")


@query("e04_fact_build", oracle(
    "SELECT video_id, user_id, input_type_id, platform_id, team_id, date_id, published_count, publish_rate, unpublished_gap FROM fact_video",
    "fact_video"))
def e04(spark, sf):
    return Star(D(spark, sf)).fact(apportioned=False).select(
        "video_id", "user_id", "input_type_id", "platform_id", "team_id", "date_id", "published_count", "publish_rate", "unpublished_gap")


@query("j03_join_fact_dims_left", oracle(
    "SELECT input_type_id, platform_id, team_id, CAST(COUNT(*) AS BIGINT) AS n FROM fact_video GROUP BY ALL", "fact_video"))
def j03(spark, sf):
    f = Star(D(spark, sf)).fact(apportioned=False, keys=["input_type_id", "platform_id", "team_id"])
    return f.groupBy("input_type_id", "platform_id", "team_id").agg(F.count(F.lit(1)).alias("n"))


@query("e06_apportion", oracle(
    """SELECT user_id, CAST(COUNT(*) AS BIGINT) AS n, MAX(uploaded_mins) AS uploaded_share, MAX(created_mins) AS created_share,
       MAX(published_mins) AS published_share, CAST(COUNT(*) FILTER (WHERE published_mins > 0) AS BIGINT) AS published_rows
  FROM fact_video GROUP BY user_id""", "fact_video"))
def e06(spark, sf):
    # Per-row shares are 4-dp values: report the share per user (sums of rounded doubles
    # depend on summation order and are not a stable result).
    f = Star(D(spark, sf)).fact(keys=["user_id"])
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("uploaded_mins").alias("uploaded_share"),
                                    F.max("created_mins").alias("created_share"), F.max("published_mins").alias("published_share"),
                                    F.count_if(F.col("published_mins") > 0).alias("published_rows"))


# Input types of priority '5-LOW' are blanked by expression to exercise the repair.
BLANK_INPUT = "5-LOW"


def unknown_member_repair(fact: DataFrame, dim: DataFrame, fk: str, id_col: str, name_col: str, unknown: str = UNKNOWN_INPUT):
    """Null FK → id of the 'unknown' member, adding that member (id = max + 1) if absent."""
    have = dim.where(F.lower(F.col(name_col)) == unknown).select(F.col(id_col).alias("_uid"))
    add = dim.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).alias("_uid"))
    # Exactly one row either way: the existing member's id or the new one.
    uid = have.unionByName(add.join(have, how="left_anti")).agg(F.min("_uid").alias("_uid"))
    new_member = uid.join(dim.select(F.col(id_col).alias("_uid")), "_uid", "left_anti").select(
        F.col("_uid").alias(id_col), F.lit(unknown).alias(name_col))
    dim2 = dim.unionByName(new_member)
    fixed = with_scalars(fact, uid).withColumn(fk, F.coalesce(F.col(fk), F.col("_uid"))).drop("_uid")
    return fixed, dim2


@query("e05_unknown_member_repair", oracle(
    f"""WITH d AS (SELECT CAST(DENSE_RANK() OVER (ORDER BY name) AS BIGINT) AS input_type_id, name AS input_type_name FROM (
              SELECT DISTINCT o_orderpriority AS name FROM orders WHERE o_orderpriority <> '{BLANK_INPUT}') x),
 u AS (SELECT CAST(MAX(input_type_id) + 1 AS BIGINT) AS uid FROM d)
SELECT input_type_id, input_type_name, (SELECT CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_orderpriority = '{BLANK_INPUT}') AS repaired FROM d
UNION ALL SELECT uid, '{UNKNOWN_INPUT}', (SELECT CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_orderpriority = '{BLANK_INPUT}') FROM u"""))
def e05(spark, sf):
    dom = D(spark, sf)
    o = dom.t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") != BLANK_INPUT, F.col("o_orderpriority")).alias("input_type"))
    dim = dense_ids(o.where(F.col("input_type").isNotNull()).select(F.col("input_type").alias("input_type_name")),
                    ["input_type_name"], "input_type_id")
    fact = o.join(dim, o.input_type == dim.input_type_name, "left").select("o_orderkey", "input_type_id")
    repaired = fact.where(F.col("input_type_id").isNull()).agg(F.count(F.lit(1)).alias("repaired"))
    _, dim2 = unknown_member_repair(fact, dim, "input_type_id", "input_type_id", "input_type_name")
    return with_scalars(dim2, repaired).select("input_type_id", "input_type_name", "repaired")


@query("j04_join_star_inner", oracle(
    """SELECT u.user_name, p.platform_name, CAST(COUNT(*) AS BIGINT) AS published
  FROM fact_video f JOIN dim_user u ON f.user_id = u.user_id JOIN dim_platform p ON f.platform_id = p.platform_id
 WHERE f.is_published GROUP BY 1, 2""", "fact_video", "dim_user", "dim_platform"))
def j04(spark, sf):
    s = Star(D(spark, sf))
    f = s.fact(apportioned=False, keys=["user_id", "platform_id"]).where(F.col("is_published"))
    return (f.join(s.dim("dim_user"), "user_id").join(s.dim("dim_platform"), "platform_id")
            .groupBy("user_name", "platform_name").agg(F.count(F.lit(1)).alias("published")))


@query("j11_lookup_by_subselect", oracle(
    "SELECT u.user_id, m.user_name, m.created_mins FROM mart_users m JOIN dim_user u ON m.user_name = u.user_name",
    "mart_users", "dim_user"))
def j11(spark, sf):
    s = Star(D(spark, sf))
    m = marts_for(s.dom, "users").select("user_name", "created_mins")
    return m.join(s.dim("dim_user").select("user_id", "user_name"), "user_name")


TOP_CREATORS = 5


def kpi_bundle(dom: Domain) -> DataFrame:
    """M23 as one row: totals, rates, minutes (whole seconds, divided once), the top creators by
    uploads and all platforms by publications ("name=count", largest first, ties by name).

    The counts come from one pass over the detail rows (QA accounts left out), grouped by user and
    by platform at once; the rankings are taken from those groups."""
    d = Star(dom).detail.where(~qa_exact_mask("uploaded_by"))
    g = d.groupingSets([["uploaded_by"], ["published_platform"]], "uploaded_by", "published_platform").agg(
        F.grouping("uploaded_by").alias("by_platform"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_published").cast("bigint")).alias("p"))
    g = g.checkpoint(eager=True)  # a row per user and per platform
    users, platforms = g.where("by_platform = 0"), g.where("by_platform = 1")
    totals = users.agg(F.sum("n").alias("total_uploads"), F.sum("p").alias("total_published"), F.count("uploaded_by").alias("users"))

    def listed(rows, name, count):
        pair = F.struct((-F.col(count)).alias("c"), F.col(name).alias("v"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["v"], F.lit("="), (-x["c"]).cast("string"))), ", ")

    top = users.where("uploaded_by is not null").orderBy(F.col("n").desc(), "uploaded_by").limit(TOP_CREATORS)
    secs = marts_for(dom, "users").where(~qa_exact_mask("user_name")).agg(*[F.sum(f"{x}_secs").alias(f"{x}_secs") for x in ("uploaded", "created", "published")])
    row = with_scalars(totals, top.agg(listed(top, "uploaded_by", "n").alias("top_creators")),
                       platforms.where("published_platform is not null").agg(listed(platforms, "published_platform", "p").alias("top_platforms")), secs)
    pct = F.col("total_published").cast("double") * F.lit(100.0) / F.nullif(F.col("total_uploads"), F.lit(0))
    minutes = [round_half_up(F.col(f"{x}_secs") / F.lit(60.0), 2).alias(f"{x}_mins") for x in ("uploaded", "created", "published")]
    return row.select("total_uploads", F.col("total_uploads").alias("total_created"), "total_published", round_half_up(pct, 2).alias("publish_rate"),
                      F.when(F.col("total_uploads") > 0, F.lit(1.0)).alias("multiplication_ratio"), *minutes, "users", "top_creators", "top_platforms")


# A detail row is one upload and one created clip, as in the fact table.
@query("m23_kpi_bundle", oracle(
    f"""WITH s AS (SELECT SUM(uploaded_secs) AS u, SUM(created_secs) AS c, SUM(published_secs) AS p FROM mart_users
   WHERE NOT COALESCE(lower(trim(user_name)) IN ({_QA_SQL}), false)),
 cr AS (SELECT u.user_name AS v, SUM(f.uploaded_count) AS n FROM fact_video f JOIN dim_user u ON f.user_id = u.user_id GROUP BY 1 ORDER BY n DESC, v LIMIT {TOP_CREATORS}),
 pl AS (SELECT d.platform_name AS v, SUM(f.published_count) AS n FROM fact_video f JOIN dim_platform d ON f.platform_id = d.platform_id GROUP BY 1)
SELECT CAST(COUNT(*) AS BIGINT) AS total_uploads, CAST(SUM(created_count) AS BIGINT) AS total_created, CAST(SUM(published_count) AS BIGINT) AS total_published,
       {round_sql('CAST(SUM(published_count) AS DOUBLE) * 100.0 / NULLIF(CAST(SUM(created_count) AS DOUBLE), 0)', 2)} AS publish_rate,
       {round_sql('CAST(SUM(created_count) AS DOUBLE) / NULLIF(CAST(SUM(uploaded_count) AS DOUBLE), 0)', 2)} AS multiplication_ratio,
       {round_sql('(SELECT u FROM s) / 60.0', 2)} AS uploaded_mins, {round_sql('(SELECT c FROM s) / 60.0', 2)} AS created_mins,
       {round_sql('(SELECT p FROM s) / 60.0', 2)} AS published_mins, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users,
       (SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM cr) AS top_creators, (SELECT string_agg(v || '=' || n, ', ' ORDER BY n DESC, v) FROM pl) AS top_platforms
  FROM fact_video""", "fact_video", "dim_user", "dim_platform", "mart_users"))
def m23(spark, sf):
    return kpi_bundle(D(spark, sf))


@query("k05_delete_and_reload", oracle(
    """SELECT 'dim_user' AS tbl, CAST(COUNT(*) AS BIGINT) AS n FROM dim_user UNION ALL SELECT 'dim_input_type', COUNT(*) FROM dim_input_type
UNION ALL SELECT 'dim_platform', COUNT(*) FROM dim_platform UNION ALL SELECT 'dim_team', COUNT(*) FROM dim_team
UNION ALL SELECT 'dim_date', COUNT(*) FROM dim_date UNION ALL SELECT 'fact_video', COUNT(*) FROM fact_video""",
    "dim_user", "dim_input_type", "dim_platform", "dim_team", "dim_date", "fact_video"))
def k05(spark, sf):
    from tidemark.session import scratch_dir
    from tidemark.sources.exports import replace_table

    s = Star(D(spark, sf))
    base = scratch_dir(spark, "star")
    out = None
    for name in ("dim_user", "dim_input_type", "dim_platform", "dim_team", "dim_date", "fact_video"):
        df = s.fact() if name == "fact_video" else s.dim(name)
        # The new rows are written apart, then the table's location is switched: no reader sees a gap.
        r = spark.table(replace_table(spark, df, f"star {name}", base)).agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = r if out is None else out.unionByName(r)
    return out
