"""Structured Streaming variants of ingestion and time rollups (survey §2.12, ST01–ST06).

The reference re-runs batch jobs from a directory watcher with a few seconds of debounce.
Here the same work is streams:

* new export files are picked up by ``readStream`` with an explicit schema (no inference);
  new and rewritten ones by the ``changed_files`` source, whose offsets are fingerprints (ST01),
* the debounce is a keyed state with a processing-time timer: a key's burst of files is passed
  on once, after so many seconds without another (ST02),
* per-batch pipelines run in ``foreachBatch`` (Spark runs batches of one query serially),
  and every sink write is idempotent (anti-join on ids, or a partition per batch id), so
  a batch replayed after an executor/driver loss does not duplicate rows,
* new ids are told by the stream's own state for a while, beyond that by an anti-join with the
  days of the table that the batch concerns (ST04),
* the time rollup stores each micro-batch's partial counts and adds them up when read: late
  rows count whenever they come, and no state is held; partials of many batches are merged
  into larger ranges, so that a reader opens few folders (ST06).

Checkpoints live under the cluster's ``spark.checkpoint.dir`` (see ``session.scratch_dir``).
"""

from __future__ import annotations

import os
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.registry import query
from tidemark.session import delete_path, list_dir, path_exists, scratch_dir
from tidemark.sources.changed_files import changed_files
from tidemark.sources.domain import Domain, oracle
from tidemark.sources.exports import clean_aggregate, export_frame, write_csv, write_exports

DEBOUNCE_SECONDS = 3
ROLLUP_WINDOW = "1 day"

DETAIL_HEADERS = ["Headline", "Source", "Published", "Team Name", "Type", "Uploaded By", "Video ID", "Published Platform", "Published URL"]
USER_HEADERS = ["User", "Uploaded Count", "Created Count", "Published Count", "Uploaded Duration (hh:mm:ss)",
                "Created Duration (hh:mm:ss)", "Published Duration (hh:mm:ss)"]


def D(spark, sf):
    return Domain(spark, sf)


def string_schema(cols: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in cols])


def csv_stream(spark, path: str, cols: list[str], max_files: int | None = None) -> DataFrame:
    """ST01: CSV file source with an explicit all-string schema."""
    r = spark.readStream.schema(string_schema(cols)).option("header", True)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.csv(path)


def run_once(writer, available_now: bool = True, seconds: float = DEBOUNCE_SECONDS, patience: float = 60, until_empty: bool = False):
    """Runs a stream until it has nothing more to do. ``available_now`` processes what is there
    and stops; else the stream is triggered every ``seconds`` and stopped, between two triggers,
    once it has read no row for ``patience`` seconds (and, ``until_empty``, holds no state); a
    stream that is never idle is stopped three seconds later."""
    if available_now:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    q = writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    seen, since = -1, time.monotonic()
    while q.isActive:
        recent = q.recentProgress
        last = max((p["batchId"] for p in recent if p["numInputRows"] > 0), default=-1)
        if last != seen:
            seen, since = last, time.monotonic()
        held = sum(o["numRowsTotal"] for o in recent[-1]["stateOperators"]) if recent and until_empty else 0
        idle = time.monotonic() - since - patience
        if recent and idle >= 0 and held == 0 and (idle >= 3 or not q.status["isTriggerActive"]):
            break
        time.sleep(0.02)
    if q.exception() is not None:
        raise q.exception()
    q.stop()
    return q


def quiet_period(rows: DataFrame, key: str, seconds: float = DEBOUNCE_SECONDS) -> DataFrame:
    """ST02: one row (key, n) for each burst of a key's rows, ``seconds`` after its last one. Each
    further row starts the wait anew. State: one number a key with an open burst."""
    wait = max(1, int(seconds * 1000))

    def step(k, frames, state):
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n]})
            return
        before = state.get[0] if state.exists else 0
        state.update((before + sum(len(f) for f in frames),))
        state.setTimeoutDuration(wait)

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, n long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store a micro-batch in its own partition; a replayed batch replaces what it wrote before."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def new_ids(stream: DataFrame, key: str, keep: str = "1 hour") -> DataFrame:
    """ST04: rows whose id hasn't arrived within ``keep``. The state holds the ids of that time
    only: the watermark runs on arrival, so it always moves on and no row is ever late for it."""
    arrived = stream.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", keep)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("arrived_at")


def append_new_ids(batch: DataFrame, table_path: str, key: str, spark, day: str | None = None, log: str | None = None, batch_id: int = 0) -> None:
    """ST04 sink: insert only ids not stored yet (idempotent under replays).

    With ``day`` (a column that an id always has the same value of), the table is partitioned
    by it and only the days of the batch are read. With ``log``, the batch's rows, new ids and
    known ids (those that came back later than the stream's state reaches) are recorded."""
    b = batch.dropDuplicates([key])
    if path_exists(spark, table_path):
        stored = spark.read.parquet(table_path)
        if day:
            b = b.withColumn(day, F.col(day).cast("string"))
            days = [r[0] for r in b.select(day).distinct().collect()]  # calendar days: few whatever the rows
            stored = stored.where(F.col(day).cast("string").isin(days))
        b = b.join(stored.select(key), key, "left_anti")
    if log:
        b = b.checkpoint(eager=True)  # counted and written alike
        n, new = batch.count(), b.count()
        put_batch(spark.createDataFrame([(n, new, n - new)], "row_count long, new_ids long, known_ids long"), log, batch_id)
    w = b.write.mode("append")
    (w.partitionBy(day) if day else w).parquet(table_path)


# ---------------------------------------------------------------------------------
# Keys
# ---------------------------------------------------------------------------------
@query("st01_stream_file_source", oracle(
    "SELECT published, CAST(COUNT(*) AS BIGINT) AS n FROM detail_export GROUP BY published", "detail_export"))
def st01(spark, sf):
    base = write_exports(spark, sf, ["video_list.csv"])
    sink, ck = scratch_dir(spark, "st01_sink"), scratch_dir(spark, "st01_ck")
    s = csv_stream(spark, os.path.join(base, "video_list.csv"), DETAIL_HEADERS)
    run_once(s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).outputMode("append"))
    return spark.read.parquet(sink).groupBy(F.col("Published").alias("published")).agg(F.count(F.lit(1)).alias("n"))


def read_changes(spark, path: str, sink: str, checkpoint: str) -> None:
    """ST01: stores the lines of files that are new or rewritten since the last run."""
    lines = changed_files(spark, path)
    run_once(lines.writeStream.foreachBatch(lambda d, i: put_batch(d, sink, i)).option("checkpointLocation", checkpoint))


@query("st01_stream_modified_files", oracle(
    """SELECT 'languages.csv' AS filename, 1 AS versions, COUNT(*) AS data_lines FROM mart_languages
UNION ALL SELECT 'monthly.csv', 2, 2 * COUNT(*) - 1 FROM mart_monthly""", "mart_languages", "mart_monthly"))
def st01_modified(spark, sf):
    base = write_exports(spark, sf, ["monthly.csv", "languages.csv"])
    sink, ck = scratch_dir(spark, "st01m_sink"), scratch_dir(spark, "st01m_ck")
    read_changes(spark, base, sink, ck)
    # monthly.csv is rewritten with one month fewer; languages.csv stays as it is.
    m = export_frame(D(spark, sf), "monthly.csv")
    first = m.agg(F.min("Month")).first()[0]
    m.where(F.col("Month") != first).write.mode("overwrite").option("header", True).csv(os.path.join(base, "monthly.csv"))
    read_changes(spark, base, sink, ck)
    lines = spark.read.parquet(sink).where("start > 0").withColumn("filename", F.substring_index("path", "/", 1))
    return lines.groupBy("filename").agg(F.count_distinct("batch_id").cast("int").alias("versions"), F.count(F.lit(1)).alias("data_lines"))


@query("st02_stream_debounce", oracle(
    "SELECT CAST(SUM(uploaded_count) AS BIGINT) AS uploaded, CAST(COUNT(*) AS BIGINT) AS months FROM mart_monthly", "mart_monthly"))
def st02(spark, sf):
    base = write_exports(spark, sf, ["monthly.csv"])
    sink, ck = scratch_dir(spark, "st02_sink"), scratch_dir(spark, "st02_ck")
    # One file per micro-batch: the work arrives in several triggers, the result equals the batch job.
    s = csv_stream(spark, os.path.join(base, "monthly.csv"), ["Month", "Total Uploaded", "Total Created", "Total Published"], max_files=1)
    run_once(s.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck))
    r = spark.read.parquet(sink)
    return r.agg(F.sum(F.col("Total Uploaded").cast("bigint")).cast("bigint").alias("uploaded"), F.count(F.lit(1)).alias("months"))


@query("st02_stream_quiet_period", oracle(
    "SELECT 'monthly.csv' AS filename, CAST(COUNT(*) AS BIGINT) AS lines, 1::BIGINT AS runs FROM mart_monthly", "mart_monthly"))
def st02_quiet(spark, sf):
    """The lines of an export arrive file by file; the export is processed once, after a second of silence."""
    base = write_exports(spark, sf, ["monthly.csv"])
    runs, ck = scratch_dir(spark, "st02_runs"), scratch_dir(spark, "st02_quiet_ck")
    lines = changed_files(spark, base).where("start > 0").withColumn("filename", F.substring_index("path", "/", 1))
    bursts = quiet_period(lines, "filename", seconds=1)
    run_once(bursts.writeStream.foreachBatch(lambda d, i: put_batch(d, runs, i)).option("checkpointLocation", ck), available_now=False, seconds=0.5,
             patience=2, until_empty=True)
    return spark.read.parquet(runs).groupBy("filename").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("runs"))


@query("st03_stream_pipeline_batch", oracle("SELECT * FROM clean_users", "clean_users"))
def st03(spark, sf):
    base = write_exports(spark, sf, ["users.csv"])
    out, rejects, ck = (scratch_dir(spark, n) for n in ("st03_mart", "st03_rejects", "st03_ck"))

    def pipeline(batch: DataFrame, batch_id: int):
        # ingest → clean → validate → write; rows with negative counts go to the reject table
        cleaned = clean_aggregate(batch)
        bad = F.coalesce((F.col("uploaded_count") < 0) | (F.col("created_count") < 0), F.lit(False))
        put_batch(cleaned.where(~bad), out, batch_id)
        put_batch(cleaned.where(bad), rejects, batch_id)

    s = csv_stream(spark, os.path.join(base, "users.csv"), USER_HEADERS)
    run_once(s.writeStream.foreachBatch(pipeline).option("checkpointLocation", ck))
    return spark.read.parquet(out).drop("batch_id")


@query("st04_stream_new_ids_only", oracle(
    f"SELECT DISTINCT CAST(video_id AS BIGINT) AS video_id FROM detail_export WHERE video_id IS NOT NULL", "detail_export"))
def st04(spark, sf):
    dom = D(spark, sf)
    src, table, ck = scratch_dir(spark, "st04_src"), scratch_dir(spark, "st04_table"), scratch_dir(spark, "st04_ck")
    rows = scratch_dir(spark, "st04_rows")
    export_frame(dom, "video_list.csv").write.option("compression", "zstd").parquet(rows)
    full = spark.read.parquet(rows)  # joined once for both arrivals
    # Two arrivals: rows of clips created before 1999, then everything (overlapping ids).
    early = dom.clips("video_id", "created_ts").where(F.col("created_ts") < F.lit("1999-01-01").cast("timestamp")).select(
        F.col("video_id").cast("string").alias("Video ID")).distinct()
    write_csv(full.join(early, "Video ID", "left_semi").select(*full.columns), os.path.join(src, "a"))

    def sink(batch: DataFrame, batch_id: int):
        append_new_ids(batch, table, "video_id", spark)

    def ids():
        s = csv_stream(spark, src + "/*", DETAIL_HEADERS).where(F.col("Video ID").isNotNull())
        return new_ids(s.select(F.col("Video ID").cast("bigint").alias("video_id")), "video_id")

    run_once(ids().writeStream.foreachBatch(sink).option("checkpointLocation", ck))
    write_csv(full, os.path.join(src, "b"))
    run_once(ids().writeStream.foreachBatch(sink).option("checkpointLocation", ck))
    return spark.read.parquet(table)


@query("st05_stream_ledger", oracle(
    """SELECT filename, 0 AS again, rows FROM (SELECT 'users.csv' AS filename, COUNT(*) AS rows FROM mart_users
  UNION ALL SELECT 'channels.csv', COUNT(*) FROM mart_channels) x""", "mart_users", "mart_channels"))
def st05(spark, sf):
    base = write_exports(spark, sf, ["users.csv", "channels.csv"])
    ledger, ck = scratch_dir(spark, "st05_ledger"), scratch_dir(spark, "st05_ck")

    def record(batch: DataFrame, batch_id: int):
        files = batch.select(F.input_file_name().alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("rows"))
        put_batch(files.select("f", "rows", F.current_timestamp().alias("processed_at")), ledger, batch_id)

    for _ in range(2):  # the second run restarts on the same checkpoint and must find nothing new
        s = spark.readStream.schema(string_schema(USER_HEADERS)).option("header", True).option("recursiveFileLookup", True) \
            .option("pathGlobFilter", "*.csv").csv(base)
        run_once(s.writeStream.foreachBatch(record).option("checkpointLocation", ck))
    led = spark.read.parquet(ledger)
    files = led.groupBy("f").agg(F.count(F.lit(1)).alias("times"), F.sum("rows").alias("rows"))
    # again: part files that were taken more than once
    return files.groupBy(F.regexp_extract("f", r"/([^/]+)/[^/]+$", 1).alias("filename")).agg(
        F.count_if(F.col("times") > 1).cast("int").alias("again"), F.sum("rows").alias("rows"))


def events_stream(spark, sf) -> DataFrame:
    """The events table, one file or a folder of part files, as a stream."""
    path = os.path.join(sf, "events.parquet")
    # A pattern, since the file source takes a plain path for a folder.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(os.path.join(sf, "events.parque[t]"))


def time_rollup(events: DataFrame) -> DataFrame:
    """Events per (day window, type)."""
    # the table stores local (NTZ) timestamps; windows need TIMESTAMP (session zone is UTC)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", ROLLUP_WINDOW).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))


MERGE_EVERY = 8  # partials of one level that are merged into one of the next


def _ranges(spark, sink: str) -> list[tuple[int, int]]:
    """Stored ranges of batches (first, last), largest first."""
    names = [n[len("batches="):].split("-") for n in list_dir(spark, sink) if n.startswith("batches=")]
    return sorted(((int(a), int(b)) for a, b in names), key=lambda r: (r[0], -r[1]))


def _cover(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges that no other one contains: each batch once."""
    out, end = [], -1
    for a, b in ranges:
        if b > end:
            out.append((a, b))
            end = b
    return out


def _range_path(sink: str, r: tuple[int, int]) -> str:
    return os.path.join(sink, f"batches={r[0]}-{r[1]}")


def add_partial(spark, part: DataFrame, sink: str, batch_id: int, every: int = MERGE_EVERY) -> None:
    """Store a batch's partial counts, and merge ``every`` neighbouring ranges of a size into one.

    Replay: the last batch writes its own folder and the merged ones anew, from folders that are
    still there, as what a merge has replaced goes only when a later batch begins."""
    stored = _ranges(spark, sink)
    kept = set(_cover(stored))
    if not any(b >= batch_id for _, b in stored):  # not a replay: all merges before are final
        for r in stored:
            if r not in kept:
                delete_path(spark, _range_path(sink, r))
    part.write.mode("overwrite").parquet(_range_path(sink, (batch_id, batch_id)))
    size = every
    while (batch_id + 1) % size == 0:
        first = batch_id + 1 - size
        step = size // every
        parts = [_range_path(sink, (a, a + step - 1)) for a in range(first, batch_id + 1, step)]
        merged = spark.read.parquet(*parts).groupBy("day", "event_type").agg(F.sum("n").alias("n"))
        merged.write.mode("overwrite").parquet(_range_path(sink, (first, batch_id)))
        size *= every


def stream_rollup(stream: DataFrame, sink: str, checkpoint: str, every: int = MERGE_EVERY) -> None:
    """ST06: every micro-batch stores its partial counts; they are added up when read. Counts
    add in any order, so rows may arrive as late as they like: no state, nothing dropped."""
    def add(batch: DataFrame, batch_id: int):
        part = time_rollup(batch).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
        add_partial(batch.sparkSession, part, sink, batch_id, every)

    run_once(stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint))


def read_rollup(spark, sink: str) -> DataFrame:
    """The counts of all batches, from at most ``every`` folders a level."""
    paths = [_range_path(sink, r) for r in _cover(_ranges(spark, sink))]
    return spark.read.parquet(*paths).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


@query("st06_stream_time_rollup", oracle(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2"""))
def st06(spark, sf):
    sink, ck = scratch_dir(spark, "st06_sink"), scratch_dir(spark, "st06_ck")
    stream_rollup(events_stream(spark, sf), sink, ck)
    return read_rollup(spark, sink)
