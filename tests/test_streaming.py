"""Streaming: batch equality, idempotent re-runs, checkpoint restarts."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL

Q = E.queries()


def test_stream_rollup_equals_batch(spark):
    s = Q["st06_stream_time_rollup"](spark, SF_SMALL)
    b = Q["t01_group_by_time"](spark, SF_SMALL).where(F.col("granularity") == "day")
    got = {(r["day"], r["event_type"]): r["n"] for r in s.collect()}
    assert sum(got.values()) == sum(r["n"] for r in b.collect())


def test_restart_on_same_checkpoint_runs_nothing(spark):
    # every part file recorded exactly once although the query ran twice
    assert {r["filename"]: r["again"] for r in Q["st05_stream_ledger"](spark, SF_SMALL).collect()} == {"users.csv": 0, "channels.csv": 0}


def test_incremental_rerun_inserts_nothing(spark):
    rows = {r["run"]: r["new_rows"] for r in Q["e08_incremental_ingest"](spark, SF_SMALL).collect()}
    assert rows[3] == 0 and rows[1] > 0


def test_backfill_second_run_skips(spark):
    statuses = {r["status"] for r in Q["e11_backfill"](spark, SF_SMALL).collect()}
    assert statuses <= {"skipped", "error"}


def test_change_detect_flags_only_rewritten_file(spark):
    got = {r["filename"]: r["change"] for r in Q["e09_change_detect"](spark, SF_SMALL).collect()}
    assert got == {"users.csv": "unchanged", "monthly.csv": "changed", "languages.csv": "unchanged"}


def test_gate_stops_on_fail_unless_forced(spark):
    rows = {(r["forced"], r["stage"]): r["status"] for r in Q["e12_pipeline_gate"](spark, SF_SMALL).collect()}
    assert rows[(False, "transform")] == "skipped" and rows[(True, "transform")] == "ok"


def test_rollup_of_late_arrivals_in_a_folder_table(spark, tmp_path):
    """The later half arrives first, then the earlier half; the table is a folder of part files."""
    from tidemark.streaming.files import events_stream, read_rollup, stream_rollup

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    path, sink, ck = str(tmp_path / "events.parquet"), str(tmp_path / "sink"), str(tmp_path / "ck")
    for half in (F.col("event_id") > middle, F.col("event_id") <= middle):
        events.where(half).repartition(3).write.mode("append").parquet(path)
        stream_rollup(events_stream(spark, str(tmp_path)), sink, ck)
    got = {(r["day"], r["event_type"]): r["n"] for r in read_rollup(spark, sink).collect()}
    want = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").count().collect()
    assert got == {(r["day"], r["event_type"]): r["count"] for r in want}


def test_replayed_batch_is_stored_once(spark, tmp_path):
    from tidemark.streaming.files import put_batch

    for _ in range(2):
        put_batch(spark.range(5), str(tmp_path / "t"), 0)
    put_batch(spark.range(5), str(tmp_path / "t"), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_insert_counts_only_new_keys(spark, tmp_path):
    from tidemark.sources.exports import insert_new_rows

    path = str(tmp_path / "t")
    assert insert_new_rows(spark, spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), path, "k") == 2
    assert insert_new_rows(spark, spark.createDataFrame([(2,), (3,), (3,)], "k int"), path, "k") == 1


def test_malformed_lines_are_set_apart(spark, tmp_path):
    from tidemark.sources.exports import read_export_split

    (tmp_path / "x.csv").write_text("Month,Total\nMay 2024,5\nJun 2024\nJul 2024,7,9\nAug 2024,8\n")
    good, bad = read_export_split(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in good.collect()] == [("May 2024", "5"), ("Aug 2024", "8")] and good.columns == ["Month", "Total"]
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["Jul 2024,7,9", "Jun 2024"]


def test_replace_table_switches_and_changes_schema(spark, tmp_path):
    from tidemark.sources.exports import replace_table

    for df in (spark.range(3), spark.range(5), spark.range(2).selectExpr("id", "id AS other")):
        name = replace_table(spark, df, "swap me.csv", str(tmp_path))
        assert spark.table(name).count() == df.count() and spark.table(name).columns == df.columns


def test_backfill_goes_on_after_a_bad_file(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    from tidemark.plans import ingest
    from tidemark.sources.exports import write_exports

    base = write_exports(spark, SF_SMALL, ["users.csv", "languages.csv"])
    real = ingest.full_replace_ingest

    def failing(spark, path, filename, table_base, sep=","):
        if filename == "users.csv":
            raise PySparkException("unreadable")
        return real(spark, path, filename, table_base, sep)

    monkeypatch.setattr(ingest, "full_replace_ingest", failing)
    ledger = str(tmp_path / "ledger")
    first = {r["filename"]: r["status"] for r in ingest.backfill(spark, base, ledger, str(tmp_path / "t")).collect()}
    assert first == {"users.csv": "failed", "languages.csv": "ok"}
    monkeypatch.setattr(ingest, "full_replace_ingest", real)
    second = {r["filename"]: r["status"] for r in ingest.backfill(spark, base, ledger, str(tmp_path / "t")).collect()}
    assert second == {"users.csv": "ok", "languages.csv": "skipped"}


def _put(folder, name, text):
    """A file that appears whole."""
    hidden = folder / f".{name}"
    hidden.write_bytes(text if isinstance(text, bytes) else text.encode())
    hidden.rename(folder / name)


def test_two_bursts_give_two_runs(spark, tmp_path):
    """A burst is passed on once, after a second of silence, whatever the number of its files."""
    import time

    from tidemark.streaming.files import quiet_period

    src, runs = tmp_path / "src", []
    src.mkdir()
    lines = spark.readStream.schema("value string").text(str(src)).withColumn("folder", F.lit("src"))
    w = quiet_period(lines, "folder", seconds=1).writeStream.foreachBatch(lambda d, i: runs.extend(tuple(r) for r in d.collect()))
    q = w.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    try:
        for burst in range(2):
            for i in range(3):
                _put(src, f"{burst}{i}.txt", "a\nb\n")
            until = time.monotonic() + 60
            while len(runs) <= burst and time.monotonic() < until:
                time.sleep(0.1)
        time.sleep(2)
        assert q.exception() is None
    finally:
        q.stop()
    assert sum(n for _, n in runs) == 12
    assert len(runs) == 2


def test_triggered_run_returns(spark, tmp_path):
    from tidemark.streaming.files import run_once

    (tmp_path / "src").mkdir()
    _put(tmp_path / "src", "a.txt", "x\ny\n")
    seen = []
    s = spark.readStream.schema("value string").text(str(tmp_path / "src"))
    w = s.writeStream.foreachBatch(lambda d, i: seen.append(d.count())).option("checkpointLocation", str(tmp_path / "ck"))
    q = run_once(w, available_now=False, seconds=0.2, patience=1)
    assert not q.isActive and sum(seen) == 2


def test_rewritten_files_come_again_and_untouched_ones_do_not(spark, tmp_path):
    from tidemark.sources.changed_files import changed_files
    from tidemark.streaming.files import run_once

    src = tmp_path / "src"
    src.mkdir()
    _put(src, "a.csv", b"\xef\xbb\xbfk,v\r\n1,x\r\n2,\xc3\xa9")
    _put(src, "b c.csv", "k,v\n" + "".join(f"{i},{'y' * (i % 40)}\n" for i in range(200)))
    _put(src, "empty.csv", "")
    _put(src, "other.txt", "no\n")

    def changes():
        got = []
        s = changed_files(spark, str(src), range_bytes=64)  # many ranges a file
        run_once(s.writeStream.foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")))
        return {p: [r["value"] for r in sorted(got, key=lambda r: r["start"]) if r["path"] == p] for p in {r["path"] for r in got}}

    assert changes() == {"a.csv": ["k,v", "1,x", "2,é"], "b c.csv": (src / "b c.csv").read_text().split("\n")[:-1]}
    assert changes() == {}
    _put(src, "a.csv", "k,v\n3,z\n")
    _put(src, "new.csv", "k\n\n9\n")
    assert changes() == {"a.csv": ["k,v", "3,z"], "new.csv": ["k", "", "9"]}
    (src / "b c.csv").unlink()
    assert changes() == {}


def test_state_of_new_ids_stays_flat(spark, tmp_path):
    """Each batch repeats old ids; the state holds the last seconds' ids, the table every id once."""
    import time

    from tidemark.streaming.files import append_new_ids, new_ids, run_once

    src, table, log = tmp_path / "src", str(tmp_path / "table"), str(tmp_path / "log")
    src.mkdir()
    held = []
    for batch in range(8):
        # fifty new ids, all ids of the batch before, and five that come every time
        rows = [f"{i},{i // 100}" for i in [*range(max(0, batch - 1) * 50, batch * 50 + 50), *range(5)]]
        _put(src, f"{batch}.csv", "\n".join(rows))
        s = new_ids(spark.readStream.schema("id long, day string").csv(str(src)), "id", keep="1 second")

        def sink(d, i):
            append_new_ids(d, table, "id", spark, day="day", log=log, batch_id=i)

        q = run_once(s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")))
        held.append(max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]))
        time.sleep(1.2)
    stored = [r["id"] for r in spark.read.parquet(table).select("id").collect()]
    assert sorted(stored) == list(range(400))
    assert max(held) <= 320 and held[-1] <= held[3] + 10  # a few batches' ids, not all 400
    total = spark.read.parquet(log).agg(F.sum("row_count"), F.sum("new_ids"), F.sum("known_ids")).first()
    assert total[1] == 400 and total[0] == total[1] + total[2] and total[2] > 0


def test_rollup_partials_are_merged(spark, tmp_path, monkeypatch):
    from tidemark.session import list_dir
    from tidemark.streaming import files

    sink = str(tmp_path / "sink")
    for i in range(23):
        part = spark.createDataFrame([(f"d{i % 3}", "e", i + 1), ("all", "e", 1)], "day string, event_type string, n long")
        for _ in range(2 if i in (8, 9, 22) else 1):  # replayed after the merges
            files.add_partial(spark, part, sink, i, every=3)
        assert {r["day"]: r["n"] for r in files.read_rollup(spark, sink).collect()}["all"] == i + 1
        assert len(files._cover(files._ranges(spark, sink))) <= 2 * 3
    got = {r["day"]: r["n"] for r in files.read_rollup(spark, sink).collect()}
    assert got == {"all": 23, **{f"d{k}": sum(i + 1 for i in range(23) if i % 3 == k) for k in range(3)}}
    assert len(list_dir(spark, sink)) <= 12  # what a merge replaced is gone


def test_separators_are_told(spark, tmp_path):
    from tidemark.sources.exports import SEPARATORS, read_export_split, sniff_separator

    for i, sep in enumerate(SEPARATORS):
        path = tmp_path / f"{i}.csv"
        head, body = ["Name, given" if sep != "," else "Name", "Time", "Value"], [["a", "1:02:03", "1,5"], ["b; c", "0:00:01", "2,5"], ["d|e", "x", "3,5"]]
        quoted = [[f'"{f}"' if any(s in f for s in SEPARATORS) and (sep in f) else f for f in r] for r in [head, *body]]
        path.write_bytes(b"\xef\xbb\xbf" + "\r\n".join(sep.join(r) for r in quoted).encode() + b"\r\n")
        assert sniff_separator(spark, str(path)) == sep
        good, bad = read_export_split(spark, str(path))
        assert good.columns == head and [list(r) for r in good.collect()] == body and bad.collect() == []
    (tmp_path / "one.csv").write_text("Month\nMay\n")
    (tmp_path / "none.csv").write_text("")
    assert sniff_separator(spark, str(tmp_path / "one.csv")) == "," and sniff_separator(spark, str(tmp_path / "none.csv")) == ","


def test_ingest_reads_any_separator(spark, tmp_path):
    from tidemark.plans.ingest import full_replace_ingest, incremental_ingest

    heads = ["Headline", "Source", "Published", "Team Name", "Type", "Uploaded By", "Video ID", "Published Platform", "Published URL"]
    for i, sep in enumerate([",", ";", "\t"]):
        path = tmp_path / f"agg{i}.csv"
        path.write_bytes(b"\xef\xbb\xbf" + sep.join(["Channels", "Uploaded Duration"]).encode() + b"\n" + sep.join(["A ", "1:00:01"]).encode() + b"\n")
        name, n = full_replace_ingest(spark, str(path), f"agg{i}.csv", str(tmp_path / "tables"))
        assert n == 1 and tuple(spark.table(name).first()) == ("A", "1:00:01", 3601)
        path = tmp_path / f"list{i}.csv"
        rows = [[f"head {k}", "s", "Yes", "t", "u", "v", str(k), "p", "http://x"] for k in (1, 2, 2)]
        path.write_bytes(b"\xef\xbb\xbf" + "\n".join(sep.join(r) for r in [heads, *rows]).encode() + b"\n")
        assert incremental_ingest(spark, str(path), str(tmp_path / f"detail{i}")) == 2


def tree_hash(data, size, fan):
    import hashlib

    level = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


def test_hash_tree_of_files_of_any_size(spark, tmp_path):
    from tidemark.sources.exports import list_files, part_hashes

    folder = tmp_path / "x y%20.csv"
    folder.mkdir()
    contents = {f"{n}.csv": bytes((i * 7) % 251 for i in range(n)) for n in (0, 1, 9, 10, 11, 95, 260)}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    got = part_hashes(spark, list_files(spark, str(tmp_path)), range_bytes=10, fan=3).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["hash"] for r in got} == {name: tree_hash(data, 10, 3) for name, data in contents.items() if data}
    assert {r["filename"] for r in got} == {"x y%20.csv"}


def test_hash_tree_of_a_sparse_file_of_3_gb(spark, tmp_path):
    """No task reads more than one range of it."""
    import hashlib

    from tidemark.sources.exports import HASH_RANGE, list_files, part_hashes

    (tmp_path / "big").mkdir()
    size = 3 << 30
    with open(tmp_path / "big" / "a.csv", "wb") as f:
        f.truncate(size)
        f.seek(size - 1)
        f.write(b"x")
    zeros = hashlib.sha256(bytes(HASH_RANGE)).hexdigest()
    last = hashlib.sha256(bytes(HASH_RANGE - 1) + b"x").hexdigest()
    want = hashlib.sha256("".join([zeros] * (size // HASH_RANGE - 1) + [last]).encode()).hexdigest()
    assert part_hashes(spark, list_files(spark, str(tmp_path))).first()["hash"] == want
