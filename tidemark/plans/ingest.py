"""Ingestion jobs: full replace, incremental append, change detection, routing, backfill,
the validate-then-transform gate and incremental cross-mart builds (survey §2.10 E07–E13).

Driver-side control flow is limited to loops over a bounded list (export files, marts);
every data step is a Spark job. File fingerprints are computed by executors
(``binaryFile`` + ``sha2``), the ledger is a parquet table upserted by key (latest wins),
and "skip unless forced" decisions come from joins against that ledger.
"""

from __future__ import annotations

import os

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.registry import query
from tidemark.session import scratch_dir
from tidemark.sources.domain import Domain, OracleSQL, oracle
from tidemark.sources.exports import (
    ALL_EXPORTS,
    EXPORT_VIEWS,
    STRATEGIES,
    BLANK_ID_LINE,
    clean_details,
    duration_cols_raw_secs,
    file_fingerprints,
    keep_first,
    line_counts,
    normalise_channel_col,
    read_export_split,
    replace_table,
    sanitise_table_name,
    strip_strings,
    upsert_ledger,
    write_csv,
    write_exports,
    export_frame,
)


def D(spark, sf):
    return Domain(spark, sf)


# ---------------------------------------------------------------------------------
# Strategies
# ---------------------------------------------------------------------------------
def full_replace_ingest(spark, path: str, filename: str, table_base: str, sep: str | None = None) -> tuple[str, int]:
    """Read (separator told from the file, all strings, malformed lines left out) → strip → 'Channels'→'Channel' → duration _raw/_secs → replace table."""
    df = duration_cols_raw_secs(normalise_channel_col(strip_strings(read_export_split(spark, path, sep)[0])))
    name = replace_table(spark, df, filename, table_base)
    return name, spark.table(name).count()


def incremental_ingest(spark, path: str, table_path: str) -> int:
    """Clean (N17) → rows with unseen ids (left-anti) → DISTINCT ON id → append with ingested_at.
    Returns the number of net new rows."""
    from tidemark.session import path_exists

    rows = clean_details(read_export_split(spark, path)[0])
    before = 0
    if path_exists(spark, table_path):  # not the first load
        stored = spark.read.parquet(table_path).select("video_id")
        before = stored.count()
        rows = rows.join(stored, "video_id", "left_anti")
    else:
        rows = rows.repartition("video_id")
    # The rows lie by id now, so that keep-first needs no shuffle; known ids are not sorted at all.
    keep_first(rows).withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(table_path)
    return spark.read.parquet(table_path).count() - before


def route(filename: str) -> str:
    """E10 (driver side, one file): strategy name, or an error for unknown files."""
    return STRATEGIES.get(filename, "error: unknown file")


def route_files(spark, files: DataFrame) -> DataFrame:
    """E10 as a join: file list ⟕ strategy config (bounded: one row per configured file)."""
    cfg = spark.createDataFrame(list(STRATEGIES.items()), "filename string, strategy string")
    j = files.select("filename").distinct().join(F.broadcast(cfg), "filename", "left")
    return j.select("filename", F.coalesce("strategy", F.lit("error: unknown file")).alias("route"))


def change_detect(spark, fingerprints: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """New (no ledger row), changed (hash differs) or unchanged."""
    if ledger is None:
        return fingerprints.select("filename", "hash", F.lit("new").alias("change"))
    j = fingerprints.join(ledger.select("filename", F.col("last_hash")), "filename", "left")
    return j.select("filename", "hash", F.when(F.col("last_hash").isNull(), "new")
                    .when(F.col("last_hash") != F.col("hash"), "changed").otherwise("unchanged").alias("change"))


def backfill(spark, base: str, ledger_path: str, table_base: str, force: bool = False) -> DataFrame:
    """Process every known export, skip unchanged ones unless forced, record status per file.
    A file that fails is recorded as ``failed`` without a hash (so the next run takes it up
    again) and the others go on. A run writes its own ledger rows; nothing is rewritten."""
    fps = file_fingerprints(spark, base).checkpoint(eager=True)  # a row a file, read twice below
    ledger = read_ledger(spark, ledger_path)
    changes = change_detect(spark, fps, ledger).join(route_files(spark, fps), "filename")
    todo = changes.collect()  # one row per export file (bounded by the file count)
    rows = []
    for r in todo:
        if r["route"].startswith("error"):
            rows.append((r["filename"], r["hash"], 0, "error"))
            continue
        if r["change"] == "unchanged" and not force:
            rows.append((r["filename"], r["hash"], None, "skipped"))
            continue
        path = os.path.join(base, r["filename"])
        try:
            if r["route"] == "incremental":
                n = incremental_ingest(spark, path, os.path.join(table_base, "video_list"))
            else:
                _, n = full_replace_ingest(spark, path, r["filename"], table_base)
        except PySparkException:
            rows.append((r["filename"], None, None, "failed"))
            continue
        rows.append((r["filename"], r["hash"], n, "ok"))
    seq = _next_seq(spark, ledger)
    run = spark.createDataFrame(rows, "filename string, last_hash string, row_count bigint, status string")
    run = run.withColumn("last_processed", F.current_timestamp()).withColumn("seq", F.lit(seq))
    if ledger is not None:
        # skipped files keep their previous row count
        prev = ledger.select("filename", F.col("row_count").alias("_prev"))
        run = run.join(prev, "filename", "left").withColumn("row_count", F.coalesce("row_count", "_prev")).drop("_prev")
    run = run.select("filename", "last_hash", "last_processed", "row_count", "status", "seq")
    run.write.mode("overwrite").parquet(os.path.join(ledger_path, f"run={seq}"))
    return read_ledger(spark, ledger_path)


def read_ledger(spark, ledger_path: str) -> DataFrame | None:
    """The latest row of every file over all runs; None before the first run."""
    from tidemark.session import path_exists

    if not path_exists(spark, ledger_path):
        return None
    return upsert_ledger(None, spark.read.parquet(ledger_path).drop("run"), "filename", "seq")


def _next_seq(spark, ledger) -> int:
    if ledger is None:
        return 1
    return int(ledger.agg(F.max("seq")).first()[0]) + 1


# ---------------------------------------------------------------------------------
# Keys
# ---------------------------------------------------------------------------------
@query("e07_full_replace_ingest", oracle(
    """SELECT channel_name AS Channel, printf('%d:%02d:%02d', CAST(floor(brand_1_secs / 3600) AS BIGINT),
       CAST(floor((brand_1_secs % 3600) / 60) AS BIGINT), brand_1_secs % 60) AS raw, brand_1_secs AS secs FROM pub_wide_secs""", "pub_wide_secs"))
def e07(spark, sf):
    fn = "publishing_duration.csv"
    base = write_exports(spark, sf, [fn])
    name, _ = full_replace_ingest(spark, os.path.join(base, fn), fn, scratch_dir(spark, "tables"))
    t = spark.table(name)
    return t.select("Channel", F.col("`Brand 1 Duration_raw`").alias("raw"), F.col("`Brand 1 Duration_secs`").alias("secs"))


@query("e08_incremental_ingest", oracle(
    f"""SELECT 1 AS run, CAST(COUNT(DISTINCT video_id) AS BIGINT) AS new_rows FROM clips WHERE line_no <> {BLANK_ID_LINE} AND created_ts < TIMESTAMP '1999-01-01'
UNION ALL SELECT 2, CAST(COUNT(DISTINCT video_id) AS BIGINT) FROM clips WHERE line_no <> {BLANK_ID_LINE} AND video_id NOT IN (
    SELECT video_id FROM clips WHERE line_no <> {BLANK_ID_LINE} AND created_ts < TIMESTAMP '1999-01-01')
UNION ALL SELECT 3, 0""", "clips"))
def e08(spark, sf):
    dom = D(spark, sf)
    base = scratch_dir(spark, "incremental")
    export_frame(dom, "video_list.csv").write.option("compression", "zstd").parquet(os.path.join(base, "rows"))
    full = spark.read.parquet(os.path.join(base, "rows"))  # joined once for both batches
    early_ids = dom.clips("video_id", "created_ts").where(F.col("created_ts") < F.lit("1999-01-01").cast("timestamp")).select(
        F.col("video_id").cast("string").alias("Video ID")).distinct()
    write_csv(full.join(early_ids, "Video ID", "left_semi"), os.path.join(base, "batch1"))
    write_csv(full, os.path.join(base, "batch2"))
    table = os.path.join(base, "video_list")
    n1 = incremental_ingest(spark, os.path.join(base, "batch1"), table)
    n2 = incremental_ingest(spark, os.path.join(base, "batch2"), table)
    n3 = incremental_ingest(spark, os.path.join(base, "batch2"), table)  # a re-run inserts nothing
    return spark.createDataFrame([(1, n1), (2, n2), (3, n3)], "run int, new_rows bigint")


@query("e09_change_detect", oracle(
    """SELECT * FROM (VALUES ('users.csv', 'unchanged'), ('languages.csv', 'unchanged')) v(filename, change)
UNION ALL SELECT 'monthly.csv', CASE WHEN COUNT(*) FILTER (WHERE month = 'Jan, 1995') > 0 THEN 'changed' ELSE 'unchanged' END FROM mart_monthly""", "mart_monthly"))
def e09(spark, sf):
    dom = D(spark, sf)
    base = write_exports(spark, sf, ["users.csv", "monthly.csv", "languages.csv"])
    first = change_detect(spark, file_fingerprints(spark, base), None)
    ledger = first.select("filename", F.col("hash").alias("last_hash")).checkpoint(eager=True)
    # monthly.csv is rewritten with one month fewer → its fingerprint changes.
    m = export_frame(dom, "monthly.csv")
    m.where(F.col("Month") != "Jan, 1995").write.mode("overwrite").option("header", True).csv(os.path.join(base, "monthly.csv"))
    return change_detect(spark, file_fingerprints(spark, base), ledger).select("filename", "change")


@query("e10_route_by_strategy", oracle(
    " UNION ALL ".join(f"SELECT '{n}' AS filename, '{STRATEGIES.get(n, 'error: unknown file')}' AS route, COUNT(*) AS data_lines FROM {EXPORT_VIEWS[n]}"
                       for n in ALL_EXPORTS), *sorted(set(EXPORT_VIEWS.values()) - {"region"})))
def e10(spark, sf):
    base = write_exports(spark, sf)
    routed = route_files(spark, file_fingerprints(spark, base))
    return routed.join(line_counts(spark, base), "filename").select("filename", "route", "data_lines")


def _backfill_sql() -> str:
    """After the second run: every known file skipped, with the rows that the first one loaded."""
    rows = {n: f"SELECT COUNT(*) FROM {EXPORT_VIEWS[n]}" for n in ALL_EXPORTS if n in STRATEGIES}
    rows["video_list.csv"] = f"SELECT COUNT(DISTINCT video_id) FROM clips WHERE line_no <> {BLANK_ID_LINE}"
    return " UNION ALL ".join(
        f"SELECT '{n}' AS filename, CAST(({rows[n]}) AS BIGINT) AS row_count, 'skipped' AS status" if n in rows else f"SELECT '{n}', CAST(0 AS BIGINT), 'error'"
        for n in ALL_EXPORTS)


@query("e11_backfill", oracle(_backfill_sql(), "clips", *sorted(set(EXPORT_VIEWS.values()) - {"region"})))
def e11(spark, sf):
    base = write_exports(spark, sf)
    ledger_path = os.path.join(scratch_dir(spark, "ledger"), "file_registry")
    tables = scratch_dir(spark, "tables")
    backfill(spark, base, ledger_path, tables)
    second = backfill(spark, base, ledger_path, tables)  # nothing changed: every known file is skipped
    return second.select("filename", "row_count", "status")


def pipeline_gate(spark, sf, force: bool = False) -> DataFrame:
    """Ingest → validate → stop on FAIL unless forced → transform. Returns the stage log."""
    from tidemark.operators.quality import FAIL, stored_checks
    from tidemark.plans.marts import marts_for

    log = []
    base = write_exports(spark, sf, ["users.csv"])
    _, n = full_replace_ingest(spark, os.path.join(base, "users.csv"), "users.csv", scratch_dir(spark, "tables"))
    log.append(("ingest", "ok", n))
    checks = stored_checks(spark, sf)
    fails = checks.where(F.col("status") == FAIL).count()
    log.append(("validate", "FAIL" if fails else "PASS", fails))
    if fails and not force:
        log.append(("transform", "skipped", 0))
    else:
        out = scratch_dir(spark, "marts")
        marts_for(D(spark, sf), "users").write.mode("overwrite").parquet(out)
        log.append(("transform", "ok", spark.read.parquet(out).count()))
    return spark.createDataFrame(log, "stage string, status string, count bigint")


def _gate_sql() -> OracleSQL:
    from tidemark.operators.quality import BLOCKS, _views, run_all_sql

    return oracle(
        """WITH n AS (SELECT (SELECT COUNT(*) FROM mart_users) AS users, (SELECT COUNT(*) FROM checks WHERE status = 'FAIL') AS fails),
 f AS (SELECT unnest([false, true]) AS forced)
SELECT 'ingest' AS stage, 'ok' AS status, CAST(users AS BIGINT) AS count, forced FROM n, f
UNION ALL SELECT 'validate', CASE WHEN fails > 0 THEN 'FAIL' ELSE 'PASS' END, fails, forced FROM n, f
UNION ALL SELECT 'transform', CASE WHEN fails > 0 AND NOT forced THEN 'skipped' ELSE 'ok' END, CASE WHEN fails > 0 AND NOT forced THEN 0 ELSE users END, forced FROM n, f""",
        *dict.fromkeys(["mart_users", *_views(BLOCKS)]), extra=[("checks", run_all_sql())])


@query("e12_pipeline_gate", _gate_sql())
def e12(spark, sf):
    a = pipeline_gate(spark, sf, force=False).withColumn("forced", F.lit(False))
    b = pipeline_gate(spark, sf, force=True).withColumn("forced", F.lit(True))
    return a.unionByName(b)


def cross_mart_incremental(spark, sf, base: str, force: bool = False) -> DataFrame:
    """Build only the missing pair marts (one GROUPING SETS pass for all of them)."""
    from tidemark.operators.aggregates import CROSS_PAIRS, cross_marts

    names = [f"{a}__{b}" for a, b in CROSS_PAIRS]
    from tidemark.session import list_dir

    existing = set() if force else {p.split("=", 1)[1] for p in list_dir(spark, base) if p.startswith("mart=")}
    missing = [(a, b) for (a, b), n in zip(CROSS_PAIRS, names) if n not in existing]
    if missing:
        x = cross_marts(D(spark, sf), missing).withColumn("mart", F.regexp_replace("pair", r"\|", "__"))
        x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mart").parquet(base)
    built = {f"{a}__{b}" for a, b in missing}
    return spark.createDataFrame([(n, "built" if n in built else "skipped") for n in names], "mart string, status string")


def _cross_sql() -> str:
    from tidemark.operators.aggregates import CROSS_PAIRS

    names = ", ".join(f"('{a}__{b}')" for a, b in CROSS_PAIRS)
    return f"SELECT mart, CASE run WHEN 2 THEN 'skipped' ELSE 'built' END AS status, run FROM (VALUES {names}) m(mart) CROSS JOIN (SELECT unnest([1, 2, 3]) AS run) r"


@query("e13_cross_mart_incremental", _cross_sql())
def e13(spark, sf):
    base = scratch_dir(spark, "cross_marts")
    a = cross_mart_incremental(spark, sf, base).withColumn("run", F.lit(1))
    b = cross_mart_incremental(spark, sf, base).withColumn("run", F.lit(2))
    c = cross_mart_incremental(spark, sf, base, force=True).withColumn("run", F.lit(3))
    return a.unionByName(b).unionByName(c)


__all__ = ["full_replace_ingest", "incremental_ingest", "route", "route_files", "change_detect", "backfill", "pipeline_gate",
           "cross_mart_incremental", "sanitise_table_name"]
