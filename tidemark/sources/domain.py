"""Domain adapter: the upload → create → publish model expressed over the driver tables.

Mapping (one row of ``orders`` is an *upload*, one row of ``lineitem`` is a *created clip*):

  published flag      l_returnflag = 'R'
  published platform  p_brand of a published clip with p_size <= 47 (others: published without platform)
  published url       a link for published clips whose l_linestatus = 'F'
  user / uploader     c_name of the order's customer
  channel             n_name of the clip's supplier nation (channel × user is many-to-many)
  input type          o_orderpriority          output type   p_type
  language            r_name of the customer's region
  team                c_mktsegment, with 'HOUSEHOLD' standing for an unknown team (null)
  seconds             uploaded floor(o_totalprice/10), created l_quantity*61, published = created if published
  month label         'Mon, YYYY' of o_orderdate
  headline            p_name of the clip's part (repeats are real)

Durations are carried as integer seconds and only divided after summing, so every sum is
exact and order-independent (the DuckDB oracle gets bit-identical doubles).

Scale notes
-----------
* ``clips(*cols)`` joins only the dimension tables the caller's columns need: a query on
  (channel, is_published) reads lineitem + supplier + nation and never touches part, orders or
  customer. Spark cannot drop an unused inner join by itself (no FK/unique constraints), so
  the adapter does it.
* ``uploads(*cols)`` pre-aggregates lineitem per order *before* joining orders (partial
  aggregation map-side; the join input shrinks ~4×).
* nation/region are tiny and Catalyst broadcasts them on its own size estimate;
  customer/part/supplier/orders joins are left to Catalyst + AQE, which broadcasts a side
  only when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
  otherwise shuffles (sort-merge) on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table

# ---------------------------------------------------------------------------------
# Fixed values of the mapping
# ---------------------------------------------------------------------------------
PUBLISHED_FLAG = "R"
UNKNOWN_TEAM_SEGMENT = "HOUSEHOLD"
PLATFORM_MAX_SIZE = 47
URL_LINESTATUS = "F"
URL_PREFIX = "https://pub.example/v/"
MONTH_FMT_SPARK = "MMM, yyyy"
MONTH_FMT_DUCK = "%b, %Y"
# Platforms are the 25 part brands: Brand#1 … Brand#25 (built by rule).
PLATFORMS = [f"Brand#{i}" for i in range(1, 26)]
# Test (QA) accounts: eight exact names (rule 1), and a prefix rule (rule 2).
QA_ACCOUNTS = [f"customer#00000000{i}" for i in range(1, 9)]
QA_PREFIX = "Customer#00000000"
QA_EXTRA_NAMES = ["Customer#000000010", "Customer#000000011", "Customer#000000012"]


def platform_col_name(brand: str) -> str:
    """Wide-table column for a platform value: 'Brand#7' -> 'brand_7'."""
    return brand.lower().replace("#", "_")


PLATFORM_COLS = [platform_col_name(b) for b in PLATFORMS]
OTHER_PLATFORMS = "other_platforms"  # wide-table column of all platforms that have none of their own
WIDE_COLS = [*PLATFORM_COLS, OTHER_PLATFORMS]

# clip column -> tables it needs beyond lineitem
_CLIP_NEEDS = {
    "video_id": set(), "upload_id": set(), "line_no": set(), "is_published": set(),
    "created_secs": set(), "published_secs": set(), "created_ts": set(), "published_url": set(),
    "input_type": {"orders"}, "upload_ts": {"orders"}, "month": {"orders"}, "upload_secs": {"orders"},
    "user_name": {"orders", "customer"}, "team_name": {"orders", "customer"},
    "language": {"orders", "customer", "region"},
    "channel_name": {"supplier"},
    "output_type": {"part"}, "platform": {"part"}, "headline": {"part"},
}
CLIP_COLUMNS = list(_CLIP_NEEDS)

_UPLOAD_NEEDS = {
    "upload_id": set(), "input_type": set(), "upload_ts": set(), "month": set(), "upload_secs": set(),
    "user_name": {"customer"}, "team_name": {"customer"}, "language": {"customer", "region"},
    "created_count": {"lines"}, "published_count": {"lines"}, "created_secs": {"lines"},
    "published_secs": {"lines"},
}
UPLOAD_COLUMNS = list(_UPLOAD_NEEDS)


def _pub() -> Column:
    return F.col("l_returnflag") == F.lit(PUBLISHED_FLAG)


class Domain:
    """Lazy domain views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from tidemark.session import ensure_checkpoint_dir

        self.spark = spark
        self.sf_dir = sf_dir
        ensure_checkpoint_dir(spark)  # checkpoint() needs it; set only when the session has none

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- dimension lookups -------------------------------------------------------------
    def _customer(self) -> DataFrame:
        return self.t("customer").select(
            "c_custkey",
            F.col("c_name").alias("user_name"),
            F.nullif(F.col("c_mktsegment"), F.lit(UNKNOWN_TEAM_SEGMENT)).alias("team_name"),
            "c_nationkey",
        )

    def _orders(self, need: set) -> DataFrame:
        o = self.t("orders").select(
            F.col("o_orderkey").alias("upload_id"),
            "o_custkey",
            F.col("o_orderpriority").alias("input_type"),
            F.col("o_orderdate").alias("upload_ts"),
            F.date_format("o_orderdate", MONTH_FMT_SPARK).alias("month"),
            F.floor(F.col("o_totalprice") / F.lit(10.0)).cast("bigint").alias("upload_secs"),
        )
        if "customer" in need:
            c = self._customer()
            o = o.join(c, o.o_custkey == c.c_custkey)
        if "region" in need:
            n = self.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
            r = self.t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("language"))
            o = o.join(n, "c_nationkey").join(r, "n_regionkey")
        return o

    def _parts(self) -> DataFrame:
        return self.t("part").select(
            "p_partkey",
            F.col("p_type").alias("output_type"),
            F.col("p_name").alias("headline"),
            F.when(F.col("p_size") <= PLATFORM_MAX_SIZE, F.col("p_brand")).alias("_brand"),
        )

    # ---- clip (lineitem) level -----------------------------------------------------------
    def _lines(self, parts: bool) -> DataFrame:
        """Rows of lineitem, with those of their parts if asked for."""
        pub = _pub()
        l = self.t("lineitem").select(
            "l_partkey", "l_suppkey",
            F.col("l_orderkey").alias("upload_id"),
            F.col("l_linenumber").alias("line_no"),
            pub.alias("is_published"),
            (pub & (F.col("l_linestatus") == URL_LINESTATUS)).alias("_has_url"),
            F.floor(F.col("l_quantity") * F.lit(61.0)).cast("bigint").alias("created_secs"),
            F.col("l_shipdate").alias("created_ts"),
        )
        if parts:
            p = self._parts()
            l = l.join(p, l.l_partkey == p.p_partkey)
        return l

    def clips(self, *cols: str) -> DataFrame:
        cols = cols or tuple(CLIP_COLUMNS)
        need = set().union(*(_CLIP_NEEDS[c] for c in cols))
        l = self._lines("part" in need)
        if "supplier" in need:
            # One after the other: a join of the two is estimated at the product of their sizes,
            # and the details would be shuffled for it.
            s = self.t("supplier").select("s_suppkey", "s_nationkey")
            sn = self.t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("channel_name"))
            l = l.join(s, l.l_suppkey == s.s_suppkey).join(sn, "s_nationkey")
        if "orders" in need:
            # Last, and by the column that callers group by: rows then lie by upload_id, and a
            # grouping by (key, upload_id) needs no shuffle of its own.
            l = l.join(self._orders(need), "upload_id")
        # Made after the joins, so that these columns are never shuffled.
        video_id = F.col("upload_id") * 1000 + F.col("line_no")
        derived = {
            "video_id": video_id,
            "published_secs": F.when(F.col("is_published"), F.col("created_secs")).otherwise(F.lit(0)).cast("bigint"),
            "published_url": F.when(F.col("_has_url"), F.concat(F.lit(URL_PREFIX), video_id.cast("string"))),
            "platform": F.when(F.col("is_published"), F.col("_brand")) if "part" in need else None,
        }
        return l.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in cols])

    # ---- upload (order) level with clip totals -------------------------------------------
    def uploads(self, *cols: str) -> DataFrame:
        cols = cols or tuple(UPLOAD_COLUMNS)
        need = set().union(*(_UPLOAD_NEEDS[c] for c in cols))
        o = self._orders(need)
        if "lines" in need:
            l = self._lines(False)
            per_order = l.groupBy(F.col("upload_id").alias("l_orderkey")).agg(
                F.count(F.lit(1)).alias("_c"),
                F.count_if("is_published").alias("_p"),
                F.sum("created_secs").alias("_cs"),
                F.sum(F.when(F.col("is_published"), F.col("created_secs")).otherwise(F.lit(0))).alias("_ps"),
            )
            o = o.join(per_order, o.upload_id == per_order.l_orderkey, "left").select(
                "*",
                F.coalesce("_c", F.lit(0)).cast("bigint").alias("created_count"),
                F.coalesce("_p", F.lit(0)).cast("bigint").alias("published_count"),
                F.coalesce("_cs", F.lit(0)).cast("bigint").alias("created_secs"),
                F.coalesce("_ps", F.lit(0)).cast("bigint").alias("published_secs"),
            )
        return o.select(*cols)

    # ---- documents as detail rows with text ----------------------------------------------
    def docs(self) -> DataFrame:
        d = self.t("documents").select("doc_id", "text", "lang", "source", "n_chars")
        lb = self.t("labels").select(F.col("doc_id").alias("lb_doc_id"), "quality", "toxic")
        j = d.join(lb, d.doc_id == lb.lb_doc_id, "left")
        return j.select(
            "doc_id",
            F.col("text").alias("headline"),
            "lang",
            "source",
            "n_chars",
            (F.col("quality") == 1).alias("is_published"),
            "toxic",
        )


class StoredDomain(Domain):
    """A domain whose detail rows and uploads are each written once, when first asked for, with
    the ``clip_cols`` and ``upload_cols`` that a job of several steps reads.

    A join leaves out rows without a match and repeats those with several, so columns that take
    other joins give other rows. With ``same_joins``, what is stored answers only requests that
    take exactly its joins; others are built as ever."""

    def __init__(self, spark: SparkSession, sf_dir: str, clip_cols: list[str], upload_cols: list[str], same_joins: bool = False):
        from tidemark.session import scratch_dir

        super().__init__(spark, sf_dir)
        self.clip_cols, self.upload_cols, self.same_joins = list(clip_cols), list(upload_cols), same_joins
        self._at = {k: scratch_dir(spark, f"stored-{k}") for k in ("clips", "uploads")}
        self._written: set[str] = set()

    def _stored(self, kind: str, build, needs: dict, known: list[str], cols) -> DataFrame:
        def joins(names):
            return set().union(*(needs[c] for c in names))

        if not set(cols) <= set(known) or (self.same_joins and joins(cols) != joins(known)):
            return build(*cols)
        if kind not in self._written:
            build(*known).write.option("compression", "zstd").parquet(self._at[kind])
            self._written.add(kind)
        return self.spark.read.parquet(self._at[kind]).select(*cols)

    def clips(self, *cols: str) -> DataFrame:
        return self._stored("clips", super().clips, _CLIP_NEEDS, self.clip_cols, cols or tuple(CLIP_COLUMNS))

    def uploads(self, *cols: str) -> DataFrame:
        return self._stored("uploads", super().uploads, _UPLOAD_NEEDS, self.upload_cols, cols or tuple(UPLOAD_COLUMNS))


class LaidOutDomain(StoredDomain):
    """A stored domain for jobs whose steps join the details in several ways: details with their
    parts, and uploads with their users, are each shuffled once and stored in buckets of an
    upload, so that joins and groupings by upload need no shuffle.

    The parts are joined by a left join that numbers a detail's matches. Steps with parts read all
    matches; steps without read the first one or none, which is each row of lineitem once.
    Times of creation are not laid out; requests for them are built as ever."""

    def _bucketed(self, name: str, build) -> DataFrame:
        table = f"{name}_{self._at['clips'].rsplit('-', 1)[1]}"
        if name not in self._written:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            w = build().repartition("upload_id").write.bucketBy(n, "upload_id").option("compression", "zstd")
            w.option("path", f"{self._at['clips']}-{name}").saveAsTable(table)
            self._written.add(name)
        return self.spark.table(table)

    def _lines(self, parts: bool) -> DataFrame:
        l = self._bucketed("lines", self._with_parts)
        return l.where(F.col("part_match").isNotNull() if parts else F.coalesce(F.col("part_match"), F.lit(1)) == 1)

    def _with_parts(self) -> DataFrame:
        l = super()._lines(False)
        same_part = Window.partitionBy("p_partkey").orderBy("p_partkey")
        p = self._parts().where(F.col("p_partkey").isNotNull()).withColumn("part_match", F.row_number().over(same_part))
        return l.join(p, l.l_partkey == p.p_partkey, "left").drop("l_partkey", "p_partkey", "created_ts")

    def clips(self, *cols: str) -> DataFrame:
        if not cols or "created_ts" in cols:
            return Domain(self.spark, self.sf_dir).clips(*cols)
        return super().clips(*cols)

    def _orders(self, need: set) -> DataFrame:
        if "customer" not in need or "region" in need:
            return super()._orders(need)
        return self._bucketed("orders", lambda: Domain._orders(self, {"customer"}).drop("o_custkey", "c_custkey", "c_nationkey"))


# ----------------------------------------------------------------------------------
# DuckDB oracle views (same semantics, written independently as SQL)
# ----------------------------------------------------------------------------------
ORACLE_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "order_attrs": (
        f"""SELECT o.o_orderkey AS upload_id, c.c_name AS user_name, o.o_orderpriority AS input_type,
       r.r_name AS language, NULLIF(c.c_mktsegment, '{UNKNOWN_TEAM_SEGMENT}') AS team_name,
       o.o_orderdate AS upload_ts, strftime(o.o_orderdate, '{MONTH_FMT_DUCK}') AS month,
       CAST(floor(o.o_totalprice / 10.0) AS BIGINT) AS upload_secs
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
        (),
    ),
    "clips": (
        f"""SELECT l.l_orderkey * 1000 + l.l_linenumber AS video_id, l.l_orderkey AS upload_id, l.l_linenumber AS line_no,
       (l.l_returnflag = '{PUBLISHED_FLAG}') AS is_published,
       CAST(floor(l.l_quantity * 61.0) AS BIGINT) AS created_secs,
       CAST(CASE WHEN l.l_returnflag = '{PUBLISHED_FLAG}' THEN floor(l.l_quantity * 61.0) ELSE 0 END AS BIGINT) AS published_secs,
       l.l_shipdate AS created_ts,
       CASE WHEN l.l_returnflag = '{PUBLISHED_FLAG}' AND l.l_linestatus = '{URL_LINESTATUS}'
            THEN '{URL_PREFIX}' || CAST(l.l_orderkey * 1000 + l.l_linenumber AS VARCHAR) END AS published_url,
       oa.input_type, oa.upload_ts, oa.month, oa.upload_secs, oa.user_name, oa.team_name, oa.language,
       sn.n_name AS channel_name, p.p_type AS output_type,
       CASE WHEN l.l_returnflag = '{PUBLISHED_FLAG}' AND p.p_size <= {PLATFORM_MAX_SIZE} THEN p.p_brand END AS platform,
       p.p_name AS headline
  FROM lineitem l JOIN order_attrs oa ON l.l_orderkey = oa.upload_id
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey""",
        ("order_attrs",),
    ),
    "uploads": (
        f"""SELECT oa.*, CAST(COALESCE(po.c_cnt, 0) AS BIGINT) AS created_count,
       CAST(COALESCE(po.p_cnt, 0) AS BIGINT) AS published_count,
       CAST(COALESCE(po.c_secs, 0) AS BIGINT) AS created_secs, CAST(COALESCE(po.p_secs, 0) AS BIGINT) AS published_secs
  FROM order_attrs oa LEFT JOIN (
    SELECT l_orderkey, COUNT(*) AS c_cnt, COUNT(*) FILTER (WHERE l_returnflag = '{PUBLISHED_FLAG}') AS p_cnt,
           SUM(CAST(floor(l_quantity * 61.0) AS BIGINT)) AS c_secs,
           SUM(CASE WHEN l_returnflag = '{PUBLISHED_FLAG}' THEN CAST(floor(l_quantity * 61.0) AS BIGINT) ELSE 0 END) AS p_secs
      FROM lineitem GROUP BY l_orderkey) po ON oa.upload_id = po.l_orderkey""",
        ("order_attrs",),
    ),
    "docs": (
        """SELECT d.doc_id, d.text AS headline, d.lang, d.source, d.n_chars, (lb.quality = 1) AS is_published, lb.toxic
  FROM documents d LEFT JOIN labels lb ON d.doc_id = lb.doc_id""",
        (),
    ),
}


class OracleSQL:
    """Oracle text rendered on first use, so views registered by later-imported modules resolve."""

    def __init__(self, body: str, views: tuple, extra):
        self.body, self.views, self.extra = body, views, extra
        self._text = None

    def __str__(self) -> str:
        if self._text is None:
            self._text = render_oracle(self.body, *self.views, extra=self.extra)
        return self._text


def oracle(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> OracleSQL:
    return OracleSQL(body, views, extra)


def render_oracle(body: str, *views: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs for ``views`` (dependencies first) and ``extra`` CTEs."""
    order: list[str] = []

    def visit(v: str):
        if v in order:
            return
        for dep in ORACLE_VIEWS[v][1]:
            visit(dep)
        order.append(v)

    for v in views:
        visit(v)
    ctes = [f"{v} AS (\n{ORACLE_VIEWS[v][0]})" for v in order]
    ctes += [f"{n} AS (\n{s})" for n, s in (extra or [])]
    if not ctes:
        return body
    b = body.lstrip()
    head = "WITH RECURSIVE " if any("UNION ALL" in s and n in s for n, s in (extra or [])) else "WITH "
    if b[:5].upper() == "WITH ":
        return head + ",\n".join(ctes) + ",\n" + b[5:]
    return head + ",\n".join(ctes) + "\n" + body


def register_oracle_view(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    ORACLE_VIEWS[name] = (sql, deps)
