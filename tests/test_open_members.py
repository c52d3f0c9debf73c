"""Members that no list names: platforms and languages of the data stay in every count."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL, TABLES
from test_oracle import _rows

QUERIES, ORACLE = E.queries(), E.oracle_sql()
KEYS = ["r01_melt", "r02_unpivot_sql", "r03_pivot_sum", "r03_pivot_open", "r04_pivot_capped", "r05_publishing_long", "w03_top1_after_unpivot", "a20_horizontal_sum",
        "f10_positive_any", "q12_dq_dead_rows", "n04_normalise_channel_col", "ex_channel_platform_breakdown", "ex_channel_published_hours",
        "ex_channel_all_published_totals", "ex_top_channel_by_published"]


@pytest.fixture(scope="module")
def unlisted(spark, tmp_path_factory):
    """The small tables, but a third of the parts has brands, and a region a name, that no list has."""
    base = str(tmp_path_factory.mktemp("unlisted"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        if t == "part":
            df = df.withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Label "), (F.col("p_partkey") % 4).cast("string"))).otherwise(F.col("p_brand")))
        if t == "region":
            df = df.withColumn("r_name", F.when(F.col("r_regionkey") == 1, "ATLANTIS").otherwise(F.col("r_name")))
        df.write.parquet(os.path.join(base, f"{t}.parquet"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet/*.parquet')")
    return base, con


@pytest.mark.parametrize("key", KEYS)
def test_keys_keep_unlisted_members(spark, unlisted, key):
    base, con = unlisted
    df = QUERIES[key](spark, base)
    cur = con.execute(ORACLE[key])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cur.description], cur.fetchall())


def test_every_published_clip_is_counted(spark, unlisted):
    base, con = unlisted
    n, secs, languages = con.execute(
        """SELECT COUNT(*) FILTER (WHERE p_size <= 47), SUM(CASE WHEN p_size <= 47 THEN CAST(floor(l_quantity * 61.0) AS BIGINT) ELSE 0 END), COUNT(*)
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""").fetchone()
    long = QUERIES["r01_melt"](spark, base)
    assert long.where("platform LIKE 'Label%' AND publish_count > 0").count() > 0
    got = long.agg(F.sum("publish_count"), F.sum(F.round(F.col("published_mins") * 60)).cast("bigint")).first()
    assert tuple(got) == (n, secs)
    assert QUERIES["a20_horizontal_sum"](spark, base).agg(F.sum("total_published")).first()[0] == n
    wide = QUERIES["r03_pivot_sum"](spark, base)
    counts = [c for c in wide.columns if c != "input_type"]
    assert wide.select(sum(F.col(c) for c in counts).alias("n")).agg(F.sum("n")).first()[0] == languages
    assert wide.agg(F.sum("other")).first()[0] > 0


def test_missing_columns_are_told_from_the_header(spark, tmp_path):
    from tidemark.operators.quality import missing_columns

    (tmp_path / "x.csv").write_text("Channels, Brand 1,Other\na,1,2\n")
    assert missing_columns(spark, str(tmp_path / "x.csv"), ["Brand 1", "Brand 2", "Other"]) == ["Brand 2"]
