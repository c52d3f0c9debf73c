"""The audit of stored exports against counting by hand: issues, samples, scores."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.audit import FILES, Rule, above, audit, audit_export, duplicate, duration, k_smallest, merged, missing, negative, report

HEAD = ["Headline", "Source", "Published", "Team Name", "Type", "Uploaded By", "Video ID", "Published Platform", "Published URL"]


def write(tmp_path, name, head, rows):
    (tmp_path / name).write_text("\n".join(",".join(r) for r in [head, *rows]) + "\n")


def test_issues_of_a_detail_export(spark, tmp_path):
    rows = [[f"h{i}", "s", "Yes" if i % 2 else "No", "Unknown" if i % 10 == 0 else "t", "x", "u", str(i // 2 if i < 14 else i), "" if i % 4 == 1 else "p", "u"] for i in range(60)]
    write(tmp_path, "video_list.csv", HEAD, rows)
    issues, sizes = audit(spark, str(tmp_path), {"video_list.csv": FILES["video_list.csv"]})
    got = {(r["field"], r["severity"]): r for r in issues.collect()}
    ids = got["Video ID", "fail"]
    assert (ids["count"], ids["pct"], ids["title"]) == (7, 11.7, "'Video ID': 7 duplicate value(s)")
    assert ids["samples"] == "0, 1, 2, 3, 4" and ids["detail"].endswith("Sample: 0, 1, 2, 3, 4")
    assert got["Team Name", "fail"]["count"] == 6
    both = [r for r in issues.collect() if r["field"] == "Published Platform"]
    assert sorted(r["count"] for r in both) == [15, 15]  # missing at all, and on published rows
    assert {k for k in got} == {("Video ID", "fail"), ("Team Name", "fail"), ("Published Platform", "warn")}
    r = report(issues, sizes).first()
    assert (r["total_rows"], r["column_count"], r["issues"], r["fails"], r["warns"], r["score"], r["status"]) == (60, 9, 4, 2, 2, 100 - 30 - 16, "fail")


def test_issues_of_aggregate_exports(spark, tmp_path):
    months = [[f"m{i}", str(i), str(i + (0 if i else -1)), str(i)] for i in range(15)] + [["m3", "-2", "x", ""]]
    write(tmp_path, "monthly.csv", ["Month", "Total Uploaded", "Total Created", "Total Published"], months)
    write(tmp_path, "monthly_duration.csv", ["Month", "Total Uploaded Duration", "Total Created Duration"], [["a", "1:00:00", "5:7:99x"], ["b", "", "12:00"]])
    write(tmp_path, "languages.csv", ["Language", "Uploaded Count"], [[" America ", "1"], ["ASIA", "2"]])
    issues, sizes = audit(spark, str(tmp_path), {n: FILES[n] for n in ("monthly.csv", "monthly_duration.csv", "languages.csv")})
    got = {(r["file"], r["title"]): r for r in issues.collect()}
    rows = got["monthly.csv", "16 rows found, 12 expected"]
    assert (rows["severity"], rows["count"]) == ("fail", 4)
    assert got["monthly.csv", "'Month': 1 duplicate value(s)"]["samples"] == "m3"
    assert got["monthly.csv", "'Total Uploaded': 1 negative value(s)"]["severity"] == "fail"
    assert got["monthly.csv", "'Total Created': 1 negative value(s)"]["samples"] == "m0"
    assert got["monthly.csv", "'Total Published': 1 missing or unknown (6.3%)"]["pct"] == 6.3
    assert got["monthly.csv", "'Total Published' above 'Total Created' in 1 row(s)"]["samples"] == "m0"
    assert got["monthly_duration.csv", "'Total Created Duration': 2 malformed duration(s)"]["samples"] == "12:00, 5:7:99x"
    assert [t for f, t in got if f == "languages.csv"] == ["Language 'antarctica' not present"]
    status = {r["file"]: (r["score"], r["status"]) for r in report(issues, sizes).collect()}
    assert status == {"monthly.csv": (100 - 6 * 15, "fail"), "monthly_duration.csv": (92, "warn"), "languages.csv": (92, "warn")}


def test_schema_shares_and_other_severities(spark, tmp_path):
    head = ["Channels", "A", "B"]
    write(tmp_path, "p.csv", head, [[f"c{i}", "0", "" if i < 3 else "1"] for i in range(9)] + [["c9", "-1", "0"]])
    dead = Rule("dead", "totals", "info", "{n} of {total}", "{samples}", "Channels", share=0.3, fields=("A", "B"))
    rules = [dead, Rule("columns", "schema", "fail", "{n} missing", "{samples}", fields=("A", "X", "Y")), negative("A"), negative("X"), missing("Channels", "fail")]
    issues, sizes = audit(spark, str(tmp_path), {"p.csv": rules})
    got = {r["field"]: r for r in issues.collect()}
    assert (got["totals"]["title"], got["totals"]["detail"], got["totals"]["severity"]) == ("4 of 10", "c0, c1, c2", "info")
    assert (got["schema"]["count"], got["schema"]["detail"]) == (2, "X, Y") and got["A"]["count"] == 1 and set(got) == {"totals", "schema", "A"}
    r = report(issues, sizes).first()
    assert (r["score"], r["status"], r["issues"]) == (100 - 2 * 15 - 2, "fail", 3)
    none = audit(spark, str(tmp_path), {"p.csv": [Rule("dead", "totals", "warn", "", "", "Channels", share=0.5, fields=("A", "B"))]})
    assert none[0].count() == 0 and report(*none).first()["status"] == "pass"


def test_empty_export(spark, tmp_path):
    write(tmp_path, "users.csv", ["User", "Uploaded Count", "Created Count", "Published Count"], [])
    issues, sizes = audit(spark, str(tmp_path), {"users.csv": FILES["users.csv"]})
    assert issues.count() == 0
    r = report(issues, sizes).first()
    assert (r["total_rows"], r["score"], r["status"]) == (0, 100, "pass")


@pytest.mark.parametrize("seed", range(3))
def test_k_smallest_merges(spark, seed):
    """Whatever the partitions, counts are exact and samples are the k smallest different values."""
    rng = random.Random(seed)
    rows = [([(r, rng.choice("abcdefghij") + str(rng.randint(0, 50))) for r in range(3) if rng.random() < 0.4],) for _ in range(500)]
    df = spark.createDataFrame(rows, "found array<struct<rule:int,value:string>>").repartition(7)
    got = {r["rule"]: (r["n"], r["samples"]) for r in merged(df.mapInArrow(k_smallest(5), "rule int, n long, samples array<string>"), 5).collect()}
    want = {r: [v for (x,) in rows for s, v in x if s == r] for r in range(3)}
    assert got == {-1: (500, []), **{r: (len(v), sorted(set(v))[:5]) for r, v in want.items()}}


def test_one_pass_for_all_row_rules(spark, tmp_path):
    """The plan reads the file once for the row rules and once for each duplicate rule."""
    write(tmp_path, "a.csv", ["K", "A", "B"], [["x", "1", "2"]])
    rules = [missing("K", "fail"), negative("A"), negative("B"), above("A", "B"), duration("B"), duplicate("K", "warn")]
    plan = audit_export(spark, str(tmp_path / "a.csv"), rules)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2
    assert [(r["rule"], r["n"], r["samples"]) for r in plan.where(F.col("n") > 0).collect()] == [(4, 1, ["2"])]
