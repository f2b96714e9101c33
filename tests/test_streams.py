"""Streams over several files, one per batch, give what the batch operators give."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from trialscope.fixtures import view
from trialscope.operators import logs, sessions
from trialscope.streaming import io, jobs
from trialscope.streaming.io import append, late_rows, stream_table, upsert

QUERIES = queries()


@pytest.fixture(scope="module")
def split_dir(spark, sf_dir, tmp_path_factory):
    """The events table cut by time into four files."""
    root = tmp_path_factory.mktemp("tables")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = events.count()
    for part in range(4):
        target = root / f"part{part}"
        events.filter((F.col("event_id") * 4 / size).cast("int") == part).coalesce(1).write.parquet(str(target))
    (root / "events.parquet").mkdir()
    for part in range(4):
        (file,) = (root / f"part{part}").glob("*.parquet")
        copied = shutil.copy(file, root / "events.parquet" / f"{part}.parquet")
        os.utime(copied, (1_700_000_000 + part, 1_700_000_000 + part))
    return str(root)


def live(spark, folder, name):
    return view(spark, folder, name, {"events": stream_table(spark, folder, "events", files_per_trigger=1)})


def as_set(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_counters_over_batches(spark, split_dir, sf_dir):
    got = upsert(jobs.session_counters(live(spark, split_dir, "tool_lines")), "t-counters", "session")
    events = logs.handled_events(logs.dispatch_tools(view(spark, sf_dir, "tool_lines")))
    want = events.groupBy("file").agg(F.count_if(F.col("kind").isin("crash_found", "crash_start")).alias("n"))
    assert as_set(got, "session", "unique_crashes") == as_set(want, "file", "n")


def test_resource_state_over_batches(spark, split_dir, sf_dir):
    got = jobs.resource_state(append(jobs.resource_samples(live(spark, split_dir, "metrics")), "t-resources"))
    metrics = view(spark, sf_dir, "metrics")
    want = sessions.smoothed_cpu(metrics).join(sessions.peaks(metrics), "session_id")
    rounded = [F.round("average_cpu", 9).alias("c"), F.round("smoothed", 9).alias("c")]
    assert as_set(got, "session_id", rounded[0], "peak_cpu", "peak_memory_mb") == as_set(
        want, "session_id", rounded[1], "peak_cpu", "peak_memory_mb"
    )


def test_minute_snapshots_over_batches(spark, split_dir, sf_dir):
    def with_session(df):
        return df.withColumn("session_id", F.col("user_id").cast("string"))

    stream = with_session(stream_table(spark, split_dir, "events", files_per_trigger=1))
    got = upsert(jobs.minute_snapshots(stream), "t-minutes", "session_id", "minute")
    want = jobs.minute_snapshots(with_session(view(spark, sf_dir, "events")))
    assert as_set(got, "session_id", "minute", "drivers", "crashes") == as_set(want, "session_id", "minute", "drivers", "crashes")


def counter(times):
    """The counter rule, request by request."""
    reset, count, limited, resets = float("-inf"), 0, 0, 0
    for t in times:
        if t - reset > jobs.RATE_MICROS:
            reset, count, resets = t, 0, resets + 1
        if count >= jobs.RATE_LIMIT:
            limited += 1
        count += 1
    return count, limited, resets


@pytest.mark.parametrize("faster", [1, 2000, 20000, 2000000])
def test_rate_counter_over_segments(spark, split_dir, faster):
    """A clock of any speed: many restarts in a segment, or many segments in one minute."""
    requests = append(jobs.rate_requests(live(spark, split_dir, "provider_health")), "t-rates")
    fast = requests.withColumn("at", (F.col("at") / faster).cast("bigint"))
    got = {r["provider"]: (r["in_window"], r["limited"], r["resets"]) for r in jobs.rate_counters(fast).collect()}
    rows = fast.collect()
    assert got == {p: counter(sorted(r["at"] for r in rows if r["provider"] == p)) for p in {r["provider"] for r in rows}}


def test_file_changes_over_batches(spark, tmp_path):
    """Snapshots that arrive in pieces are compared whole."""
    folder = tmp_path / "snap.parquet"
    folder.mkdir()
    pieces = [[(1, "z", 1)], [(2, "a", 1)], [(3, "a", 2), (2, "b", 1)]]
    for i, rows in enumerate(pieces):
        spark.createDataFrame(rows, "snapshot int, path string, mtime int").coalesce(1).write.parquet(str(tmp_path / f"s{i}"))
        (file,) = (tmp_path / f"s{i}").glob("*.parquet")
        copied = shutil.copy(file, folder / f"{i}.parquet")
        os.utime(copied, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = stream_table(spark, str(tmp_path), "snap", files_per_trigger=1)
    got = jobs.file_changes(append(jobs.snapshot_rows(stream), "t-changes"))
    assert as_set(got, "path", "change") == {("a", "created"), ("b", "created"), ("z", "deleted"), ("a", "modified"), ("b", "deleted")}


@pytest.fixture(scope="module")
def shuffled_dir(spark, sf_dir, tmp_path_factory):
    """All tables, with events and part as 130 files of rows in no order: three batches."""
    root = tmp_path_factory.mktemp("shuffled")
    for file in os.listdir(sf_dir):
        if file not in ("events.parquet", "part.parquet"):
            (root / file).symlink_to(os.path.join(sf_dir, file))
    for name in ("events", "part"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(130, F.xxhash64(table.columns[0])).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


CUT = sorted(name for name in QUERIES if name.startswith("st") and not name.startswith("st14"))


@pytest.mark.parametrize("name", CUT)
def test_result_does_not_hang_on_files_and_batches(spark, sf_dir, shuffled_dir, name):
    one, many = (sorted(map(tuple, QUERIES[name](spark, d).collect()), key=repr) for d in (sf_dir, shuffled_dir))
    assert many == one


def test_a_job_goes_on_where_it_stopped(spark, split_dir, tmp_path):
    """Stopped after the first files, started again with the same folders: the same rows."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    where = {"target": str(tmp_path / "out"), "checkpoint": str(tmp_path / "progress")}
    files = sorted(os.listdir(f"{split_dir}/events.parquet"))

    def run():
        events = stream_table(spark, str(tmp_path), "events", files_per_trigger=1)
        events = events.withColumn("session_id", F.col("user_id").cast("string"))
        return jobs.session_lifecycle(events, "t-life", **where)

    for part in (files[:2], files[2:]):
        for file in part:
            shutil.copy(f"{split_dir}/events.parquet/{file}", folder / file)
        got = run()
    whole = stream_table(spark, split_dir, "events").withColumn("session_id", F.col("user_id").cast("string"))
    want = jobs.session_lifecycle(whole, "t-life")
    columns = ["session_id", "started", "ended", "events", "status"]
    assert as_set(got, *columns) == as_set(want, *columns)
    assert late_rows(spark, where["target"]) == 0


def small_files(spark, folder, rows, schema):
    """A file per list of rows, in that order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder.mkdir()
    for i, part in enumerate(rows):
        pq.write_table(pa.table({name: [r[k] for r in part] for k, name in enumerate(schema)}), folder / f"{i:04}.parquet")
        os.utime(folder / f"{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def counted(stream):
    return stream.groupBy("key").agg(F.count("*").alias("n"), F.max("value").alias("highest"))


def test_old_versions_go(spark, tmp_path, monkeypatch):
    """Many batches: what is kept follows a fixed number of them, a fold that fails loses nothing, an earlier result stays readable."""
    monkeypatch.setattr(io, "COMPACT_EVERY", 4)
    rows = [[(j % 5 if j % 2 else i, i * 10 + j) for j in range(4)] for i in range(26)]
    small_files(spark, tmp_path / "rows.parquet", rows, ["key", "value"])
    out = str(tmp_path / "out")
    where = {"target": out, "checkpoint": str(tmp_path / "progress")}
    real, calls = io.Versions.compact, []

    def failing(self, upto):
        calls.append(upto)
        if len(calls) == 3:
            # The new base is there in part, as when a task is lost while it is written.
            self.spark.range(3).withColumn("key", F.col("id")).write.mode("overwrite").parquet(f"{self.path}/base/batch={upto}")
            raise RuntimeError("lost")
        real(self, upto)

    monkeypatch.setattr(io.Versions, "compact", failing)

    def run():
        return upsert(counted(stream_table(spark, str(tmp_path), "rows", files_per_trigger=1)), "t-versions", "key", **where)

    with pytest.raises(Exception, match="lost"):
        run()
    got = run()
    flat = [r for part in rows for r in part]
    want = {(k, sum(r[0] == k for r in flat), max(r[1] for r in flat if r[0] == k)) for k, _ in flat}
    assert as_set(got, "key", "n", "highest") == want
    assert len(calls) == 7  # the third one was repeated
    assert len(os.listdir(f"{out}/base")) == 2
    assert len([f for f in os.listdir(f"{out}/changes") if f.startswith("batch=")]) <= 2 * 4 + 2


def test_half_a_snapshot_deletes_nothing(spark):
    rows = [(1, "a", 1), (1, "b", 1), (2, "a", 2), (3, "a", 2), (3, "b", 1), (3, "b", 1), (5, "a", 2)]
    rows = spark.createDataFrame(rows, "snapshot int, path string, mtime int")
    manifest = "snapshot int, files long"

    def changes(*listed):
        return as_set(jobs.file_changes(rows, spark.createDataFrame(listed, manifest)), "snapshot", "path", "change")

    # The second is not whole: neither its changes nor those of the third are known. The fourth is empty.
    assert changes((1, 2), (2, 2), (3, 2), (4, 0), (5, 1)) == {(4, "a", "deleted"), (4, "b", "deleted"), (5, "a", "created")}
    assert changes((1, 2), (2, 1), (3, 2)) == {(2, "a", "modified"), (2, "b", "deleted"), (3, "b", "created")}
    assert changes((1, 2), (5, 1)) == set()
    assert jobs.file_changes(rows.limit(0), spark.createDataFrame([], manifest)).count() == 0


def test_rows_behind_a_delay_are_counted(spark, split_dir, tmp_path):
    files = sorted(os.listdir(f"{split_dir}/events.parquet"), reverse=True)  # newest first
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i, file in enumerate(files):
        copied = shutil.copy(f"{split_dir}/events.parquet/{file}", folder / f"{i}.parquet")
        os.utime(copied, (1_700_000_000 + i, 1_700_000_000 + i))
    events = stream_table(spark, str(tmp_path), "events", files_per_trigger=1).withColumn("session_id", F.col("user_id").cast("string"))
    upsert(jobs.minute_snapshots(events, "10 minutes"), "t-late", "session_id", "minute", target=str(tmp_path / "out"))
    assert late_rows(spark, str(tmp_path / "out")) > 0


def test_growing_files_are_read_on(spark, tmp_path, monkeypatch):
    """Files that grow by parts of lines, stay, or are replaced, cut into chunks of any size: the lines are those of the files."""
    import random

    from trialscope.sources import growing

    logs_dir, state, draw = tmp_path / "logs", str(tmp_path / "state"), random.Random(2)
    logs_dir.mkdir()
    assert growing.grown_lines(spark, state).count() == 0
    assert growing.read_growth(spark, str(tmp_path / "none"), str(tmp_path / "other")).count() == 0
    for step in range(6):
        monkeypatch.setattr(growing, "CHUNK", draw.choice([5, 40, 1 << 26]))
        for i in range(5):
            act = draw.choice(["append", "append", "append", "none", "new"]) if step else "new"
            body = "".join(draw.choice(["a", "line é", "\n", "", "\n\n", "bb\r\n", "c\n"]) for _ in range(draw.randint(0, 12))) or "x"
            if act != "none":
                with open(logs_dir / f"f{i}.log", "a" if act == "append" else "w", newline="") as f:
                    f.write(body)
        growing.read_growth(spark, str(logs_dir), state)
        want = {p.name: [line.rstrip("\r") for line in p.read_bytes().decode().removesuffix("\n").split("\n")] for p in logs_dir.iterdir()}
        got = {name: [] for name in want}
        for r in sorted(growing.grown_lines(spark, state).collect(), key=lambda r: (r.file, r.line_number)):
            got[os.path.basename(r.file)].append(r.raw_line)
            assert r.line_number == len(got[os.path.basename(r.file)])
        assert got == want
    before = {r.file: r.offset for r in growing.ledger(spark, state).collect()}
    assert growing.read_growth(spark, str(logs_dir), state).count() == 0
    with open(logs_dir / "f0.log", "a") as f:
        f.write("more\n")
    growing.read_growth(spark, str(logs_dir), state)
    read = {r.file: r.bytes_read for r in growing.ledger(spark, state).collect()}
    (file,) = [f for f in read if f.endswith("f0.log")]
    assert read == {f: (logs_dir / "f0.log").stat().st_size - before[f] if f == file else 0 for f in read}


def test_a_pass_that_failed_is_repeated(spark, tmp_path, monkeypatch):
    from trialscope.sources import growing

    (tmp_path / "logs").mkdir()
    log, state = tmp_path / "logs" / "a.log", str(tmp_path / "state")
    log.write_text("one\ntwo\n")
    growing.read_growth(spark, str(tmp_path / "logs"), state)
    log.write_text("one\ntwo\nthree\n")
    real = growing.tails
    calls = []

    def failing(files):
        calls.append(1)
        if len(calls) == 2:  # the lines are written, the ledger is not
            raise RuntimeError("lost")
        return real(files)

    monkeypatch.setattr(growing, "tails", failing)
    with pytest.raises(RuntimeError):
        growing.read_growth(spark, str(tmp_path / "logs"), state)
    assert sorted(r.raw_line for r in growing.grown_lines(spark, state).collect()) == ["one", "two"]
    log.write_text("one\ntwo\nthree\nfour\n")
    growing.read_growth(spark, str(tmp_path / "logs"), state)
    got = [r.raw_line for r in growing.grown_lines(spark, state).orderBy("line_number").collect()]
    assert got == ["one", "two", "three", "four"]
