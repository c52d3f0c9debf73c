"""Steps whose work must not outgrow their input."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tidemark.functions.similarity import block_ratio, candidate_pairs
from tidemark.operators import quality
from tidemark.sources import exports
from tidemark.sources.domain import Domain, StoredDomain

Q = E.queries()


def test_words_meet_only_values_that_may_reach_the_cutoff(spark):
    """Names of equal length and words of letters: every one of the pairs was compared before."""
    names = spark.range(3000).select(F.lit("User").alias("label"), F.format_string("customer#%09d", "id").alias("v"))
    words = spark.range(400).select(F.concat(F.lit("schleichend"), F.translate(F.format_string("%06d", "id"), "0123456789", "abghilmnos")).alias("token"))
    assert candidate_pairs(words, names, "token", "v", 0.7).count() == 0


def test_no_pair_that_reaches_the_cutoff_is_left_out(spark):
    values = ["abc", "Feb, 2026", "feb, 2026", "customer#000000123", "", "zuñiga", "aaaa", "a", "east-1", "éé", "asia", None]
    words = ["abd", "Feb, 2026", "customer000000132", "zuniga", "aaa", "b", "a", "east1", "éa", "é", "aisa", "febr2026"]
    a = spark.createDataFrame([(w,) for w in words], "token string")
    b = spark.createDataFrame([(v,) for v in values], "v string")
    for cutoff in (0.5, 0.7, 0.85):
        got = {(r["token"], r["v"]) for r in candidate_pairs(a, b, "token", "v", cutoff).collect()}
        want = {(w, v) for w in words for v in values if v and block_ratio([v], [w])[0] >= cutoff}
        assert want <= got


def test_details_by_upload_are_grouped_without_a_shuffle_of_their_own(spark):
    """The join with the uploads comes last, by the column that marts group by."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from tidemark.plans.marts import marts_for

        plan = marts_for(Domain(spark, SF_SMALL), "channels")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(channel_name" in plan  # the marts' own
        assert not [line for line in plan.splitlines() if "hashpartitioning(channel_name" in line and "upload_id" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_exports_join_the_details_once(spark, monkeypatch):
    made = []
    for kind in ("clips", "uploads"):
        real = getattr(Domain, kind)
        monkeypatch.setattr(Domain, kind, lambda self, *c, _real=real, _kind=kind: made.append(_kind) or _real(self, *c))
    base = exports.write_exports(spark, SF_SMALL)
    # channels, output types, channels and users, details, publishing (two exports); users, languages, the rest (three)
    assert sorted(made) == ["clips"] * 5 + ["uploads"] * 3
    assert sorted(os.listdir(base)) == sorted(exports.ALL_EXPORTS)
    assert all(f.endswith(".csv.gz") for f in os.listdir(os.path.join(base, "video_list.csv")) if f.startswith("part-"))
    listed = {r["filename"] for r in exports.list_files(spark, base).collect()}
    assert listed == set(exports.ALL_EXPORTS)
    assert {r["filename"] for r in exports.line_counts(spark, base).collect()} == set(exports.ALL_EXPORTS)


def test_four_formats_are_made_from_one_frame(spark, monkeypatch):
    made = []
    real = Domain.clips
    monkeypatch.setattr(Domain, "clips", lambda self, *c: made.append(c) or real(self, *c))
    reads = []
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: reads.append(p) or read(self, *p, **k))
    assert len(Q["s02_separators_told"](spark, SF_SMALL).collect()) == 4
    assert len(made) == 1 and any(p[0].endswith("rows") for p in reads)


def test_separator_is_told_in_one_pass(spark, tmp_path):
    """Heads come from the first lines of the file that starts first; the others only vote."""
    (tmp_path / "a.csv").write_text('k;v\n1;2\n"x;y,";3\n')
    (tmp_path / "b.csv").write_text("k;v\n" + "".join(f"{i},5;{i}\n" for i in range(9)))
    assert exports.sniff_separator(spark, str(tmp_path)) == ";"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "c.csv").write_text("")
    assert exports.sniff_separator(spark, str(tmp_path / "empty")) == ","


def test_known_ids_are_left_out_before_rows_are_sorted(spark, tmp_path):
    from tidemark.plans.ingest import incremental_ingest

    head = "Headline,Source,Published,Team Name,Type,Uploaded By,Video ID,Published Platform,Published URL\n"
    row = "{h},s,Yes,t,i,u,{v},p,l\n".format
    for name, rows in (("a", [("b", 1), ("a", 1), ("c", 2), ("z", "")]), ("b", [("0", 1), ("y", 3), ("x", 3), ("w", "n4")])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.csv").write_text(head + "".join(row(h=h, v=v) for h, v in rows))
    table = str(tmp_path / "table")
    assert [incremental_ingest(spark, str(tmp_path / n), table) for n in ("a", "b", "b")] == [2, 1, 0]
    assert sorted(map(tuple, spark.read.parquet(table).select("video_id", "headline").collect())) == [(1, "a"), (2, "c"), (3, "x")]


def test_foreign_keys_are_counted_a_key_at_a_time(spark):
    plan = quality._ref_frame(Domain(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_pair_marts_group_by_the_pair_only(spark):
    from tidemark.operators.aggregates import cross_marts

    plan = cross_marts(Domain(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "keys=[pair" in plan


def test_stored_rows_have_the_joins_of_their_request(spark, tmp_path):
    """A customer without nation counts as a user, a part that comes twice repeats its own columns only."""
    for t in ("lineitem", "orders", "supplier", "nation", "region"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))).write.parquet(str(tmp_path / "customer.parquet"))
    p = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    p.unionByName(p).write.parquet(str(tmp_path / "part.parquet"))
    plain, kept = Domain(spark, str(tmp_path)), StoredDomain(spark, str(tmp_path), exports.SHARED_CLIPS, exports.SHARED_UPLOADS, same_joins=True)
    for cols in (["channel_name", "upload_id"], ["channel_name", "platform"], ["user_name"], ["language"]):
        assert kept.clips(*cols).count() == plain.clips(*cols).count()
    for cols in (["user_name"], ["language"], ["month", "created_count"]):
        assert kept.uploads(*cols).count() == plain.uploads(*cols).count()


def odd_tables(spark, folder):
    """Parts that come twice or are missing, orders, suppliers and customers too; keys that are null."""
    for t in ("nation", "region"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", folder / f"{t}.parquet")
    for t, key in (("part", "p_partkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")):
        rows = spark.read.parquet(f"{SF_SMALL}/{t}.parquet").withColumn("k", F.col(key))
        some = rows.where("k % 5 > 0").withColumn(key, F.when(F.col("k") % 7 > 0, F.col("k")))
        some.unionByName(some.where("k % 3 = 0")).drop("k").write.parquet(str(folder / f"{t}.parquet"))
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    for key in ("l_partkey", "l_orderkey", "l_suppkey", "l_returnflag", "l_quantity"):
        rows = rows.withColumn(key, F.when(F.xxhash64(F.lit(key), *rows.columns) % 11 != 0, F.col(key)))
    rows.write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


def test_details_laid_out_by_upload_are_those_of_each_request(spark, tmp_path):
    from tidemark.sources.domain import LaidOutDomain

    sf = odd_tables(spark, tmp_path)
    plain, laid = Domain(spark, sf), LaidOutDomain(spark, sf, exports.SHARED_CLIPS, exports.SHARED_UPLOADS, same_joins=True)
    for cols in (["upload_id", "line_no", "created_secs"], ["channel_name", "upload_id"], ["output_type", "upload_secs"], ["channel_name", "user_name", "is_published"],
                 ["headline", "platform", "video_id", "published_url", "published_secs"], ["headline", "channel_name", "team_name", "input_type"], ["created_ts", "language"]):
        assert sorted(map(str, laid.clips(*cols).collect())) == sorted(map(str, plain.clips(*cols).collect()))
    for cols in (["user_name", "upload_secs", "created_count"], ["language", "published_secs"], ["month", "created_secs", "published_count"]):
        assert sorted(map(str, laid.uploads(*cols).collect())) == sorted(map(str, plain.uploads(*cols).collect()))
    for n in exports.ALL_EXPORTS:
        assert sorted(map(str, exports.export_frame(laid, n).collect())) == sorted(map(str, exports.export_frame(plain, n).collect())), n


def test_exports_shuffle_details_once(spark, tmp_path):
    """Steps on laid out details: no shuffle by upload, nor by supplier for the supplier's name."""
    from tidemark.plans.marts import marts_for
    from tidemark.sources.domain import LaidOutDomain

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        laid = LaidOutDomain(spark, SF_SMALL, exports.SHARED_CLIPS, exports.SHARED_UPLOADS, same_joins=True)
        for m in ("users", "channels", "output_types", "channel_user"):
            plan = marts_for(laid, m)._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(l_suppkey" not in plan
            assert plan.count("hashpartitioning(upload_id") <= (m in ("channels", "output_types"))  # of orders, where they are not stored
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_supplier_names_do_not_shuffle_details(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(20_000))
    try:
        plan = Domain(spark, SF_SMALL).clips("channel_name", "is_published")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_paths_are_decoded_once_a_file(spark, tmp_path):
    (tmp_path / "a b.csv").mkdir()
    (tmp_path / "a b.csv" / "part-0.csv").write_text("h\n1\n2\n")
    names = spark.createDataFrame([("a b.csv",)], "filename string")
    counts = names.join(exports.line_counts(spark, str(tmp_path)), "filename")
    assert [tuple(r) for r in counts.collect()] == [("a b.csv", 2)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "url_decode" in line.lower()]


def test_first_rows_are_carried_once(spark):
    from tidemark.operators.windows import top1_per_group

    d = spark.createDataFrame([(1, "b", None, 5), (1, "a", "y", 3), (1, "a", None, 4), (2, None, "z", 1)], "k int, a string, b string, n int")
    best = top1_per_group(d, ["k"], [("a", False), ("b", False)])
    assert sorted(map(tuple, best.collect())) == [(1, "a", None, 4), (2, None, "z", 1)]
    assert sorted(map(tuple, top1_per_group(d.drop("n"), ["k"], [("a", False), ("b", False)]).collect())) == [(1, "a", None), (2, None, "z")]
    assert "_row" not in top1_per_group(d.drop("n"), ["k"], [("a", False), ("b", False)])._jdf.queryExecution().optimizedPlan().toString()


def test_durations_as_text(spark):
    from tidemark.operators.filters import hms_text

    d = spark.createDataFrame([(0,), (59,), (3600,), (360_000_061,), (-1,), (None,)], "s long").select(hms_text("s").alias("t"))
    assert [r["t"] for r in d.collect()] == ["0:00:00", "0:00:59", "1:00:00", "100000:01:01", "-1:59:59", "null:null:null"]
