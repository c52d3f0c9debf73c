"""Golden arithmetic on tiny synthetic exports with the reference file layout (FIXTURES.md §1).

The files are written by the test itself (synthetic values, same schemas and oddities)."""

import os

from pyspark.sql import functions as F

from tidemark.operators.quality import Block, Check, _rows_spark
from tidemark.sources.exports import clean_aggregate, read_export, sanitise_table_name

CHANNELS = """Channel,Uploaded Count,Created Count,Published Count,Uploaded Duration (hh:mm:ss),Created Duration (hh:mm:ss),Published Duration (hh:mm:ss)
A,100,400,10,227:24:21,30:00:00,1:00:00
B,0,1,0,0:05:07,0:01:00,0:00:00
C,50,150,0,10:00:00,5:7:99x,
"""


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    os.makedirs(p, exist_ok=True)
    with open(os.path.join(p, "part-0.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_clean_channels_kpis(spark, tmp_path):
    df = clean_aggregate(read_export(spark, _write(str(tmp_path), "channels.csv", CHANNELS)))
    got = {r["channel_name"]: r for r in df.collect()}
    a = got["A"]
    assert (a["publish_rate"], a["multiplication_ratio"], a["unpublished_gap"]) == (2.5, 4.0, 390)
    assert a["uploaded_mins"] == 227 * 60 + 24 + 0.35
    assert got["B"]["multiplication_ratio"] is None  # 0 uploads → undefined ratio
    assert got["C"]["created_mins"] == 0.0 and got["C"]["published_mins"] == 0.0  # malformed and blank


def test_active_dead_sum_to_100(spark, tmp_path):
    df = clean_aggregate(read_export(spark, _write(str(tmp_path), "ch2.csv", CHANNELS)))
    r = df.agg(F.avg(F.when(F.col("published_count") > 0, 1).otherwise(0)).alias("a"),
               F.avg(F.when(F.col("published_count") == 0, 1).otherwise(0)).alias("d")).first()
    assert abs((r["a"] + r["d"]) * 100 - 100) < 1e-9


def test_table_name_sanitising():
    assert sanitise_table_name("combined_data(2025-3-1-2026-2-28) by user.csv") == "combined_data_2025_3_1_2026_2_28_by_user"
    assert sanitise_table_name("channel-wise-publishing duration.csv") == "channel_wise_publishing_duration"


def test_check_rules(spark):
    one = spark.createDataFrame([(13, 13, 1, 0, 2)], "n long, m long, bad long, zero long, dup long")
    blk = Block("t", None, "", [Check("rowcount", "", "rowcount12", "m", "n"), Check("fmt", "f", "warn_if_any", "bad", "n"),
                                Check("ok", "f", "fail_if_any", "zero", "n"), Check("dups", "h", "warn_above", "dup", "n", 0.05)])
    got = {r["name"]: (r["status"], r["pct"]) for r in _rows_spark(one, blk).collect()}
    assert got == {"rowcount": ("WARN", 100.0), "fmt": ("WARN", 7.7), "ok": ("PASS", 0.0), "dups": ("WARN", 15.4)}
