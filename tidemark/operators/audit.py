"""Audit of the stored exports: a list of issues with samples, and a score per file (Q21, Q22).

Each export is read as text, and all of its row rules are evaluated in ONE pass: a row yields the
rules it breaks, and a task adds up, per rule, the count and the ``k`` smallest different
values (a mergeable aggregate: tasks' rows are merged again by count and k smallest). So the
samples come from the pass that counts, and no list of violations is ever collected. Rules on
duplicates run the same aggregate over the keys that occur more than once.

An issue's title and detail are templates filled with its count, share and samples. The score of
a file is 100 less 15 a failure, 8 a warning and 2 any other issue, at least 0.
"""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import HMS_PATTERN, NULLISH, is_nullish, round_half_up, round_sql
from tidemark.operators.filters import HMS_TEXT_SQL
from tidemark.operators.quality import EXPECTED_LANGUAGES
from tidemark.registry import query
from tidemark.sources.domain import WIDE_COLS, oracle
from tidemark.sources.exports import PLATFORM_TITLES, read_export, write_exports

WEIGHTS = {"fail": 15, "warn": 8}
OTHER_WEIGHT = 2
MONTHS_EXPECTED = 12
_NULLISH_SQL = ", ".join(f"'{v}'" for v in NULLISH)


@dataclass(frozen=True)
class Rule:
    """One check of an export. ``kind``: missing, negative, above (field above ``other``), duration,
    without (flagged rows whose field is missing), dead (no field of a list is positive),
    duplicate (keys that repeat), absent (no row has the value ``other``), rows (expected number)
    or columns (names missing from the header, none of the rows)."""

    kind: str
    field: str
    severity: str
    title: str
    detail: str
    other: str = ""
    k: int = 3
    share: float = 0.0  # an issue only above this share of the rows
    fields: tuple = ()


def missing(field, severity, detail="{n} of {total} rows have no value or an unknown one."):
    return Rule("missing", field, severity, f"'{field}': {{n}} missing or unknown ({{pct}}%)", detail)


def negative(field):
    return Rule("negative", field, "fail", f"'{field}': {{n}} negative value(s)", "Counts cannot be below zero. Sample: {samples}")


def above(field, other):
    return Rule("above", field, "fail", f"'{field}' above '{other}' in {{n}} row(s)", "More is published than was created, which cannot be. Sample: {samples}", other)


def duration(field):
    return Rule("duration", field, "warn", f"'{field}': {{n}} malformed duration(s)", "Expected hh:mm:ss; other values are left out. Sample: {samples}")


def duplicate(field, severity, fields=(), k=3, share=0.0):
    return Rule("duplicate", field, severity, f"'{field}': {{n}} duplicate value(s)", "Values that occur more than once. Sample: {samples}", k=k, share=share,
                fields=fields or (field,))


COUNTS = ["Uploaded Count", "Created Count", "Published Count"]
DURATIONS = [f"{s} Duration (hh:mm:ss)" for s in ("Uploaded", "Created", "Published")]
_COUNT_RULES = [*map(negative, COUNTS), above("Published Count", "Created Count")]
FILES: dict[str, list[Rule]] = {
    "monthly.csv": [
        Rule("rows", "Month", "warn", "{total} rows found, 12 expected", "{n} row(s) more or fewer than the months of a year."),
        duplicate("Month", "fail"),
        *(r for c in ("Total Uploaded", "Total Created", "Total Published") for r in (missing(c, "fail"), negative(c))),
        above("Total Published", "Total Created")],
    "monthly_duration.csv": [duration(f"Total {s} Duration") for s in ("Uploaded", "Created", "Published")],
    "channels.csv": [missing("Channel", "fail"), *(missing(c, "warn") for c in COUNTS), duplicate("Channel", "warn"), *_COUNT_RULES, *map(duration, DURATIONS)],
    "channel user (combined).csv": [duplicate("Channel+User", "fail", ("Channel", "User")), *_COUNT_RULES],
    "users.csv": [missing("User", "fail"), duplicate("User", "warn"), *_COUNT_RULES],
    "input_types.csv": [missing("Input Type", "warn", "{n} row(s) have no input type and will be labelled unknown."), *_COUNT_RULES],
    "output_types.csv": [*map(negative, COUNTS)],
    "languages.csv": [*(Rule("absent", "Language", "warn", f"Language '{v.lower()}' not present", "An expected language is missing; its analytics stay empty.", v.lower())
                        for v in EXPECTED_LANGUAGES), *map(negative, COUNTS)],
    "publishing.csv": [
        missing("Channels", "fail"), Rule("columns", "schema", "fail", "{n} platform column(s) missing", "Missing: {samples}", fields=tuple(PLATFORM_TITLES), k=3),
        *map(negative, PLATFORM_TITLES),
        Rule("dead", "platform totals", "warn", "{n} of {total} channels publish nowhere", "More than 30% of the channels have no publication at all. Sample: {samples}",
             "Channels", share=0.3, fields=tuple(PLATFORM_TITLES))],
    "publishing_duration.csv": [
        Rule("columns", "schema", "fail", "{n} duration column(s) missing", "Missing: {samples}", fields=tuple(f"{t} Duration" for t in PLATFORM_TITLES), k=3),
        *(duration(f"{t} Duration") for t in PLATFORM_TITLES)],
    "video_list.csv": [
        *(missing(c, "fail") for c in ("Video ID", "Uploaded By", "Team Name")),
        *(missing(c, "warn") for c in ("Headline", "Type", "Published Platform", "Published URL")),
        duplicate("Video ID", "fail", k=5), duplicate("Headline", "warn", share=0.05),
        *(Rule("without", f, "warn", f"{{n}} published rows without '{f}' ({{pct}}%)", "Published rows without it are left out of its analytics. Sample: {samples}", "Published")
          for f in ("Published Platform", "Published URL"))],
}


# ---------------------------------------------------------------------------------
# The pass over an export
# ---------------------------------------------------------------------------------
def _number(c: str) -> Column:
    return F.col(f"`{c}`").try_cast("double")


def _broken(rule: Rule, columns: list[str]) -> tuple[Column, Column] | None:
    """(whether a row breaks the rule, the value it shows); None if the export lacks a column."""
    label = F.col(f"`{columns[0]}`")
    need = [rule.field] if rule.kind not in ("dead", "absent") else list(rule.fields) or [rule.field]
    if rule.kind in ("above", "without"):
        need.append(rule.other)
    if any(c not in columns for c in need):
        return None
    own = F.col(f"`{rule.field}`") if rule.field in columns else None
    if rule.kind == "missing":
        return is_nullish(F.trim(own)), label
    if rule.kind == "negative":
        return _number(rule.field) < 0, label
    if rule.kind == "above":
        zero = F.lit(0.0)
        return F.coalesce(_number(rule.field), zero) > F.coalesce(_number(rule.other), zero), label
    if rule.kind == "duration":
        return (F.trim(own) != "") & ~F.trim(own).rlike(HMS_PATTERN), own
    if rule.kind == "without":
        return (F.lower(F.trim(F.col(f"`{rule.other}`"))) == "yes") & is_nullish(F.trim(own)), label
    if rule.kind == "dead":
        return F.greatest(*[F.coalesce(_number(c), F.lit(0.0)) for c in rule.fields]) <= 0, F.col(f"`{rule.other}`")
    if rule.kind == "absent":
        return F.lower(F.trim(own)) == rule.other, own
    return None


TALLY = "rule int, n long, samples array<string>"


def k_smallest(k: int):
    """Per task and rule: the count and the ``k`` smallest different values; rule -1 counts rows."""

    def run(batches):
        n, low = Counter(), {}
        for b in batches:
            n[-1] += b.num_rows
            flat = b.column(0).flatten()
            rules, values = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
            for r in np.unique(rules).tolist():
                own = values.filter(pa.array(rules == r))
                n[r] += len(own)
                own = pc.unique(own.drop_null())
                own = own.take(pc.sort_indices(own)[:k]).to_pylist()
                low[r] = sorted({*low.get(r, []), *own})[:k]
        keys = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[r] for r in keys], pa.int64()),
                                          pa.array([low.get(r, []) for r in keys], pa.list_(pa.string()))], names=["rule", "n", "samples"])

    return run


def tally(df: DataFrame, broken: dict[int, tuple[Column, Column]], k: int) -> DataFrame:
    """Counts and samples of all rules in one pass over ``df``."""
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("rule"), F.when(F.coalesce(bad, F.lit(False)), True).alias("bad"), v.cast("string").alias("value"))
                               for i, (bad, v) in broken.items()]), lambda x: x["bad"].isNotNull())
    rows = df.select(F.transform(found, lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"))).alias("found"))
    return rows.mapInArrow(k_smallest(k), TALLY)


def merged(parts: DataFrame, k: int) -> DataFrame:
    lists = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, k)
    return parts.groupBy("rule").agg(F.sum("n").alias("n"), lists.alias("samples"))


def audit_export(spark, path: str, rules: list[Rule]) -> DataFrame:
    """(rule, n, total, samples) of one export, rules numbered as listed."""
    df = read_export(spark, path)
    df = df.toDF(*[c.strip() for c in df.columns])
    k = max((r.k for r in rules), default=3)
    broken = {i: b for i, r in enumerate(rules) if (b := _broken(r, df.columns)) is not None}
    parts = tally(df, broken or {-2: (F.lit(False), F.lit(""))}, k)
    for i, r in enumerate(rules):
        if r.kind == "duplicate" and all(c in df.columns for c in r.fields):
            key = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) for c in r.fields]
            some = key[0] != "" if len(key) == 1 else F.lit(True)
            if r.share:
                some = some & ~is_nullish(key[0])
            twice = df.where(some).groupBy(F.concat_ws(" | ", *key).alias("v")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            parts = parts.unionByName(tally(twice, {i: (F.lit(True), F.col("v"))}, k).where("rule >= 0"))
        if r.kind == "columns":
            lacking = [c for c in r.fields if c not in df.columns]
            parts = parts.unionByName(spark.createDataFrame([(i, len(lacking), lacking)], TALLY))
    numbered = spark.createDataFrame([(i,) for i in range(-1, len(rules))], "rule int")
    rows = numbered.join(merged(parts, k), "rule", "left")
    # A window over the rules' own rows (a few dozen): every rule with the number of rows read.
    total = F.max(F.when(F.col("rule") == -1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("total", F.coalesce(total, F.lit(0)).cast("long")).where("rule >= 0").select(
        "rule", F.coalesce("n", F.lit(0)).alias("n"), "total", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def _issues(found: DataFrame) -> DataFrame:
    """Rows that are issues, from rule rows with their rule's columns."""
    count = F.when(F.col("kind") == "rows", F.abs(F.col("total") - MONTHS_EXPECTED)).when(F.col("kind") == "absent", (F.col("n") == 0).cast("long")).otherwise(F.col("n"))
    d = found.withColumn("count", count.cast("long")).where((F.col("count") > 0) & (F.col("count") > F.col("share") * F.col("total")))
    severity = F.when((F.col("kind") == "rows") & (F.col("count") > 2), "fail").otherwise(F.col("severity"))
    pct = F.when(F.col("total") > 0, round_half_up(F.col("count") * 100.0 / F.col("total"), 1)).otherwise(0.0)
    shown = F.when(F.col("kind").isin("rows", "absent", "missing"), F.lit("")).otherwise(F.array_join(F.slice("samples", 1, F.col("k")), ", "))
    d = d.withColumns({"severity": severity, "pct": pct, "samples": shown})

    def fill(template):
        out = F.col(template)
        for name, value in (("{n}", F.col("count").cast("string")), ("{total}", F.col("total").cast("string")),
                            ("{pct}", F.format_string("%.1f", "pct")), ("{samples}", F.col("samples"))):
            out = F.replace(out, F.lit(name), value)
        return out

    return d.select("file", "severity", "field", fill("title").alias("title"), fill("detail").alias("detail"), "count", "pct", "samples")


def audit(spark, base: str, files: dict[str, list[Rule]] = FILES) -> tuple[DataFrame, DataFrame]:
    """(issues, files): Q22's list of issues with samples, and the size of every audited export."""
    found, about, heads = None, [], []
    for name, rules in files.items():
        path = os.path.join(base, name)
        heads.append((name, len(read_export(spark, path).columns)))
        about += [(i, name, r.kind, r.severity, r.field, r.title, r.detail, r.share, r.k) for i, r in enumerate(rules)]
        one = audit_export(spark, path, rules).withColumn("file", F.lit(name))
        found = one if found is None else found.unionByName(one)
    found = found.checkpoint(eager=True)  # one job over all exports; a row a rule
    kinds = spark.createDataFrame(about, "rule int, file string, kind string, severity string, field string, title string, detail string, share double, k int")
    sizes = spark.createDataFrame(heads, "file string, column_count int").join(found.groupBy("file").agg(F.max("total").alias("total_rows")), "file", "left")
    return _issues(found.join(kinds, ["file", "rule"])), sizes.select("file", F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "column_count")


def report(issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """Q21: per file its size, issues by severity, score and status."""
    counts = {s: F.count_if(F.col("severity") == s) for s in ("fail", "warn")}
    g = issues.groupBy("file").agg(F.count(F.lit(1)).alias("issues"), *[c.alias(f"{s}s") for s, c in counts.items()])
    j = sizes.join(g, "file", "left").fillna(0, subset=["issues", "fails", "warns"])
    off = sum((F.col(f"{s}s") * w for s, w in WEIGHTS.items()), F.lit(0)) + (F.col("issues") - F.col("fails") - F.col("warns")) * OTHER_WEIGHT
    status = F.when(F.col("fails") > 0, "fail").when(F.col("issues") > 0, "warn").otherwise("pass")
    return j.select("file", "total_rows", "column_count", "issues", "fails", "warns", F.greatest(F.lit(0), 100 - off).cast("int").alias("score"), status.alias("status"))


# ---------------------------------------------------------------------------------
# The same in SQL over the marts and the detail rows
# ---------------------------------------------------------------------------------
def _columns_sql(name: str) -> tuple[str, dict[str, str]]:
    """(source, export header → text expression)."""
    def text(c):
        return f"CAST({c} AS VARCHAR)"

    block = {h: text(f"{s}_count") for h, s in zip(COUNTS, ("uploaded", "created", "published"))}
    block |= {h: HMS_TEXT_SQL.format(s=f"{s}_secs") for h, s in zip(DURATIONS, ("uploaded", "created", "published"))}
    if name == "monthly.csv":
        return "mart_monthly", {"Month": "month", "Total Uploaded": text("uploaded_count"), "Total Created": text("created_count"), "Total Published": text("published_count")}
    if name == "monthly_duration.csv":
        return "mart_monthly", {"Month": "month", **{f"Total {s} Duration": HMS_TEXT_SQL.format(s=f"{s.lower()}_secs") for s in ("Uploaded", "Created", "Published")}}
    if name == "channel user (combined).csv":
        return "mart_channel_user", {"Channel": "channel_name", "User": "user_name", **block}
    if name == "publishing.csv":
        return "pub_wide", {"Channels": "channel_name", **{t: text(c) for t, c in zip(PLATFORM_TITLES, WIDE_COLS)}}
    if name == "publishing_duration.csv":
        return "pub_wide_secs", {"Channels": "channel_name", **{f"{t} Duration": HMS_TEXT_SQL.format(s=f"{c}_secs") for t, c in zip(PLATFORM_TITLES, WIDE_COLS)}}
    if name == "video_list.csv":
        return "detail_export", {"Headline": "headline", "Source": "source", "Published": "published", "Team Name": "team_name", "Type": "input_type",
                                 "Uploaded By": "uploaded_by", "Video ID": "video_id", "Published Platform": "published_platform", "Published URL": "published_url"}
    mart, header, key = {"channels.csv": ("mart_channels", "Channel", "channel_name"), "users.csv": ("mart_users", "User", "user_name"),
                         "input_types.csv": ("mart_input_types", "Input Type", "COALESCE(input_type, 'Unknown')"),
                         "output_types.csv": ("mart_output_types", "Output Type", "output_type"), "languages.csv": ("mart_languages", "Language", "language")}[name]
    return mart, {header: key, **block}


def _rule_sql(rule: Rule, source: str, cols: dict[str, str]) -> str:
    """SELECT n, samples (a list) of one rule."""
    def nullish(c):
        return f"({c} IS NULL OR trim({c}) IN ({_NULLISH_SQL}))"

    label, own = next(iter(cols.values())), cols.get(rule.field, "NULL")
    if rule.kind == "rows":
        return f"SELECT COUNT(*) AS n, [] AS samples FROM {source}"
    if rule.kind == "columns":
        return "SELECT 0 AS n, [] AS samples"
    if rule.kind == "duplicate":
        keys = [f"COALESCE(trim({cols[c]}), '')" for c in rule.fields]
        some = f"{keys[0]} <> ''" if len(keys) == 1 else "true"
        if rule.share:
            some += f" AND NOT {nullish(keys[0])}"
        inner = f"SELECT concat_ws(' | ', {', '.join(keys)}) AS v FROM {source} WHERE {some} GROUP BY 1 HAVING COUNT(*) > 1"
    else:
        bad, value = {
            "missing": lambda: (nullish(own), label),
            "negative": lambda: (f"TRY_CAST({own} AS DOUBLE) < 0", label),
            "above": lambda: (f"COALESCE(TRY_CAST({own} AS DOUBLE), 0) > COALESCE(TRY_CAST({cols[rule.other]} AS DOUBLE), 0)", label),
            "duration": lambda: (f"trim({own}) <> '' AND NOT regexp_full_match(trim({own}), '{HMS_PATTERN[1:-1]}')", own),
            "without": lambda: (f"lower(trim({cols[rule.other]})) = 'yes' AND {nullish(own)}", label),
            "dead": lambda: (f"greatest({', '.join(f'TRY_CAST({cols[c]} AS DOUBLE)' for c in rule.fields)}) <= 0", cols[rule.other] if rule.other in cols else label),
            "absent": lambda: (f"lower(trim({own})) = '{rule.other}'", own),
        }[rule.kind]()
        inner = f"SELECT {value} AS v FROM {source} WHERE {bad}"
    return f"SELECT COUNT(*) AS n, COALESCE(list_sort(list(DISTINCT trim(v)) FILTER (WHERE v IS NOT NULL))[1:{rule.k}], []) AS samples FROM ({inner}) x"


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _found_sql() -> str:
    parts = []
    for name, rules in FILES.items():
        source, cols = _columns_sql(name)
        for r in rules:
            parts.append(f"SELECT {_q(name)} AS file, {_q(r.kind)} AS kind, {_q(r.severity)} AS severity, {_q(r.field)} AS field, {_q(r.title)} AS title, "
                         f"{_q(r.detail)} AS detail, {r.share} AS share, t.n, t.samples::VARCHAR[] AS samples, (SELECT COUNT(*) FROM {source}) AS total FROM ({_rule_sql(r, source, cols)}) t")
    return "\nUNION ALL ".join(parts)


_FILL = "replace(replace(replace(replace({t}, '{{n}}', CAST(c AS VARCHAR)), '{{total}}', CAST(total AS VARCHAR)), '{{pct}}', printf('%.1f', pct)), '{{samples}}', shown)"
_ISSUES_SQL = f"""SELECT file, CASE WHEN kind = 'rows' AND c > 2 THEN 'fail' ELSE severity END AS severity, field, {_FILL.format(t='title')} AS title,
       {_FILL.format(t='detail')} AS detail, c AS count, pct, shown AS samples
  FROM (SELECT *, CASE WHEN total > 0 THEN {round_sql('c * 100.0 / total', 1)} ELSE 0.0 END AS pct,
               CASE WHEN kind IN ('rows', 'absent', 'missing') THEN '' ELSE array_to_string(samples, ', ') END AS shown
          FROM (SELECT *, CAST(CASE kind WHEN 'rows' THEN abs(total - {MONTHS_EXPECTED}) WHEN 'absent' THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE n END AS BIGINT) AS c FROM found) a
         WHERE c > 0 AND c > share * total) b"""
_VIEWS = ["clips", "mart_monthly", "mart_channel_user", "pub_wide", "pub_wide_secs", "detail_export", "mart_channels", "mart_users", "mart_input_types",
          "mart_output_types", "mart_languages"]
_SIZES_SQL = " UNION ALL ".join(f"SELECT {_q(n)} AS file, COUNT(*) AS total_rows, {len(_columns_sql(n)[1])} AS column_count FROM {_columns_sql(n)[0]}" for n in FILES)


@query("q22_dq_issue_list", oracle("SELECT * FROM issues", *_VIEWS, extra=[("found", _found_sql()), ("issues", _ISSUES_SQL)]))
def q22_issues(spark, sf):
    return audit(spark, write_exports(spark, sf, list(FILES)))[0]


@query("q21_dq_issue_report", oracle(
    f"""WITH g AS (SELECT file, COUNT(*) AS issues, COUNT(*) FILTER (WHERE severity = 'fail') AS fails, COUNT(*) FILTER (WHERE severity = 'warn') AS warns FROM issues GROUP BY file),
 s AS ({_SIZES_SQL})
SELECT s.file, s.total_rows, s.column_count, COALESCE(issues, 0) AS issues, COALESCE(fails, 0) AS fails, COALESCE(warns, 0) AS warns,
       CAST(GREATEST(0, 100 - 15 * COALESCE(fails, 0) - 8 * COALESCE(warns, 0) - {OTHER_WEIGHT} * COALESCE(issues - fails - warns, 0)) AS INTEGER) AS score,
       CASE WHEN COALESCE(fails, 0) > 0 THEN 'fail' WHEN COALESCE(issues, 0) > 0 THEN 'warn' ELSE 'pass' END AS status
  FROM s LEFT JOIN g ON g.file = s.file""", *_VIEWS, extra=[("found", _found_sql()), ("issues", _ISSUES_SQL)]))
def q21_report(spark, sf):
    return report(*audit(spark, write_exports(spark, sf, list(FILES))))
