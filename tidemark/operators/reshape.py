"""Reshaping (survey §2.8 R-keys): pivot, melt/unpivot, capped pivots, long option lists.

Pivots take their members from the data: sums per (row, member) become one map a row
(``pivot_map``; as many entries as the row has members), without a list in the code, a pass for
the distinct members or a collect. Where a table needs fixed columns, ``spread`` names them and
adds up all other members in one more column, so nothing is lost. Capped pivots (R04) take the
top members of a bounded ranking first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.sources.domain import OTHER_PLATFORMS, PLATFORM_COLS, PLATFORMS, Domain, oracle

# The five region names of the driver data (languages of the mapping).
LANGUAGES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def lang_col(v: str) -> str:
    return v.lower().replace(" ", "_")


def D(spark, sf):
    return Domain(spark, sf)


# ---------------------------------------------------------------------------------
# Wide publishing tables (the channel-wise export shape) and melting them back
# ---------------------------------------------------------------------------------
def pivot_map(df: DataFrame, row: str, member: str, value: Column, name: str = "totals") -> DataFrame:
    """R03 for any members: (row, ``name`` map member → value). Null members are left out."""
    per = df.where(F.col(member).isNotNull()).groupBy(row, member).agg(value.cast("bigint").alias("_v"))
    return per.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(member, "_v"))).alias(name))


def spread(maps: DataFrame, row: str, columns: dict[str, str], other: str, name: str = "totals") -> DataFrame:
    """A map's named members as columns (0 where absent; ``columns``: member → column name), and
    the sum of all others in the column ``other``."""
    known = F.array(*[F.lit(m) for m in columns])
    rest = F.map_values(F.map_filter(name, lambda k, _: ~F.array_contains(known, k)))
    zero = F.lit(0).cast("bigint")
    return maps.select(row, *[F.coalesce(F.try_element_at(name, F.lit(m)), zero).alias(c) for m, c in columns.items()],
                       F.aggregate(rest, zero, lambda acc, x: acc + x).alias(other))


def publishing_totals(dom: Domain) -> DataFrame:
    """channel → its publish count on each platform, whatever the platforms."""
    return pivot_map(dom.clips("channel_name", "platform"), "channel_name", "platform", F.count(F.lit(1)))


def publishing_totals_secs(dom: Domain) -> DataFrame:
    return pivot_map(dom.clips("channel_name", "platform", "published_secs"), "channel_name", "platform", F.sum("published_secs"))


def publishing_wide(dom: Domain) -> DataFrame:
    """channel × platform columns of publish counts (0 when none), other platforms in one column."""
    return spread(publishing_totals(dom), "channel_name", dict(zip(PLATFORMS, PLATFORM_COLS)), OTHER_PLATFORMS)


def publishing_wide_secs(dom: Domain) -> DataFrame:
    columns = {p: c + "_secs" for p, c in zip(PLATFORMS, PLATFORM_COLS)}
    return spread(publishing_totals_secs(dom), "channel_name", columns, OTHER_PLATFORMS + "_secs")


def melt(df: DataFrame, ids: list[str], values: list[str], var: str, val: str) -> DataFrame:
    """Wide → long (``DataFrame.unpivot``; no shuffle, a per-row Expand)."""
    return df.unpivot(ids, values, var, val)


def melt_map(maps: DataFrame, row: str, var: str, val: str, at_least: list[str] = (), name: str = "totals") -> DataFrame:
    """R01 for any members: one row an entry; members of ``at_least`` that a row lacks come as 0."""
    entries = F.col(name)
    if at_least:
        zeros = F.map_from_arrays(F.array(*[F.lit(m) for m in at_least]), F.array(*[F.lit(0).cast("bigint") for _ in at_least]))
        entries = F.map_zip_with(zeros, entries, lambda _, a, b: F.coalesce(b, a))
    return maps.select(row, F.explode(entries).alias(var, val))


def melt_platforms(totals: DataFrame, totals_secs: DataFrame) -> DataFrame:
    """R05 shape: melt counts and durations, join on (channel, platform)."""
    long = melt_map(totals, "channel_name", "platform", "publish_count", PLATFORMS)
    secs = melt_map(totals_secs, "channel_name", "platform", "secs")
    j = long.join(secs, ["channel_name", "platform"], "left")
    return j.select("channel_name", "platform", "publish_count", (F.coalesce("secs", F.lit(0)) / F.lit(60.0)).alias("published_mins"))


_BRANDS_VALUES = ", ".join(f"('{p}')" for p in PLATFORMS)
_BRANDS_SQL = ", ".join(f"'{p}'" for p in PLATFORMS)

WIDE_SQL = "SELECT channel_name, " + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE platform = '{p}') AS BIGINT) AS {pc}" for p, pc in zip(PLATFORMS, PLATFORM_COLS)
) + f", CAST(COUNT(*) FILTER (WHERE platform NOT IN ({_BRANDS_SQL})) AS BIGINT) AS {OTHER_PLATFORMS} FROM clips WHERE platform IS NOT NULL GROUP BY channel_name"


@query("r01_melt", oracle(
    f"""SELECT c.channel_name, b.platform, CAST(COALESCE(m.publish_count, 0) AS BIGINT) AS publish_count,
       COALESCE(m.published_mins, 0.0) AS published_mins
  FROM (SELECT DISTINCT channel_name FROM mart_publishing) c CROSS JOIN (VALUES {_BRANDS_VALUES}) b(platform)
  LEFT JOIN mart_publishing m ON m.channel_name = c.channel_name AND m.platform = b.platform
UNION ALL SELECT channel_name, platform, CAST(publish_count AS BIGINT), published_mins FROM mart_publishing WHERE platform NOT IN ({_BRANDS_SQL})""", "mart_publishing"))
def r01(spark, sf):
    dom = D(spark, sf)
    return melt_platforms(publishing_totals(dom), publishing_totals_secs(dom))


@query("r02_unpivot_sql", oracle(
    f"""SELECT channel_name, CASE WHEN platform IN ({_BRANDS_SQL}) THEN platform ELSE 'Other' END AS platform, CAST(SUM(publish_count) AS BIGINT) AS publish_count
  FROM mart_publishing GROUP BY 1, 2""", "mart_publishing"))
def r02(spark, sf):
    """The wide table's columns; what its last column adds up comes as 'Other'."""
    names = dict(zip([*PLATFORM_COLS, OTHER_PLATFORMS], [*PLATFORMS, "Other"]))
    cols = ", ".join(f"{c} AS `{p}`" for c, p in names.items())
    return spark.sql(
        f"SELECT channel_name, platform, publish_count FROM {{wide}} UNPIVOT (publish_count FOR platform IN ({cols})) WHERE publish_count > 0",
        wide=publishing_wide(D(spark, sf)),
    )


@query("r03_pivot_sum", oracle(
    "SELECT input_type, " + ", ".join(
        f"CAST(COUNT(*) FILTER (WHERE is_published AND language = '{l}') AS BIGINT) AS {lang_col(l)}" for l in LANGUAGES
    ) + ", CAST(COUNT(*) FILTER (WHERE is_published AND language NOT IN (" + ", ".join(f"'{l}'" for l in LANGUAGES)
    + ")) AS BIGINT) AS other FROM clips GROUP BY input_type", "clips"))
def r03(spark, sf):
    c = D(spark, sf).clips("input_type", "language", "is_published")
    maps = pivot_map(c, "input_type", "language", F.count_if("is_published"))
    return spread(maps, "input_type", {l: lang_col(l) for l in LANGUAGES}, "other")


@query("r03_pivot_open", oracle(
    """SELECT input_type, array_to_string(list(language || '=' || n ORDER BY language), ' ') AS published FROM (
  SELECT input_type, language, COUNT(*) FILTER (WHERE is_published) AS n FROM clips WHERE language IS NOT NULL GROUP BY 1, 2) x GROUP BY input_type""", "clips"))
def r03_open(spark, sf):
    """The pivot as one map a row, its members whatever the data holds (here written out as text)."""
    c = D(spark, sf).clips("input_type", "language", "is_published")
    maps = pivot_map(c, "input_type", "language", F.count_if("is_published"))
    entries = F.transform(F.array_sort(F.map_entries("totals")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("input_type", F.array_join(entries, " ").alias("published"))


CAP_COLS, CAP_ROWS = 10, 15


def pivot_capped(long: DataFrame, row: str, col: str, val: str, n_cols: int = CAP_COLS, n_rows: int = CAP_ROWS) -> DataFrame:
    """Pivot ``val`` by row × col for the top ``n_cols`` column values; top ``n_rows`` rows by total.

    Columns are p01…pNN in rank order of the column value (ties by value name); the
    column-value ranking is a bounded top-N (at most ``n_cols`` values reach the driver).
    """
    tops = long.groupBy(col).agg(F.sum(val).alias("_t")).orderBy(F.col("_t").desc(), F.col(col)).limit(n_cols)
    top_vals = [r[0] for r in tops.collect()]
    names = [f"p{i + 1:02d}" for i in range(len(top_vals))]
    piv = long.where(F.col(col).isin(top_vals)).groupBy(row).pivot(col, top_vals).agg(F.sum(val))
    piv = piv.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(n) for v, n in zip(top_vals, names)])
    tot = F.lit(0)
    for n in names:
        tot = tot + F.col(n)
    piv = piv.withColumn("total", tot.cast("bigint"))
    return piv.orderBy(F.col("total").desc(), F.col(row)).limit(n_rows)


@query("r04_pivot_capped", oracle(
    f"""WITH l AS (SELECT user_name, platform, COUNT(*) AS v FROM clips WHERE platform IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT platform, ROW_NUMBER() OVER (ORDER BY SUM(v) DESC, platform) AS rk FROM l GROUP BY platform),
 p AS (SELECT l.user_name, """ + ", ".join(
        f"CAST(COALESCE(SUM(v) FILTER (WHERE rk = {i}), 0) AS BIGINT) AS p{i:02d}" for i in range(1, CAP_COLS + 1)
    ) + f""" FROM l JOIN t ON l.platform = t.platform WHERE rk <= {CAP_COLS} GROUP BY l.user_name)
SELECT *, CAST(""" + " + ".join(f"p{i:02d}" for i in range(1, CAP_COLS + 1)) + f""" AS BIGINT) AS total FROM p
 ORDER BY total DESC, user_name LIMIT {CAP_ROWS}""", "clips"))
def r04(spark, sf):
    c = D(spark, sf).clips("user_name", "platform").where(F.col("platform").isNotNull())
    long = c.groupBy("user_name", "platform").agg(F.count(F.lit(1)).alias("v"))
    return pivot_capped(long, "user_name", "platform", "v")


@query("r06_normalised_mart_rows", oracle(
    """SELECT d1 AS dim1, d2 AS dim2, created_count, published_count, publish_rate, unpublished_gap
  FROM cross_pairs WHERE pair = 'user_name|platform'""", "cross_pairs"))
def r06(spark, sf):
    from tidemark.operators.aggregates import cross_marts

    x = cross_marts(D(spark, sf)).where(F.col("pair") == "user_name|platform")
    return x.select(F.col("d1").alias("dim1"), F.col("d2").alias("dim2"), "created_count", "published_count",
                    "publish_rate", "unpublished_gap").orderBy(F.col("created_count").desc(), "dim1", "dim2")


OPTION_DIMS = ["input_type", "team_name", "language"]


def dimension_options(df: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct (dimension, value) pairs of several columns from one scan."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])))
    return pairs.where(F.col("value").isNotNull()).distinct()


@query("r08_dimension_options", oracle(
    " UNION ".join(f"SELECT DISTINCT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM uploads WHERE {d} IS NOT NULL"
                   for d in OPTION_DIMS), "uploads"))
def r08(spark, sf):
    return dimension_options(D(spark, sf).uploads(*OPTION_DIMS), OPTION_DIMS)
