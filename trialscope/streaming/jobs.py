"""The live operations as Structured Streaming jobs.

Each function takes a streaming DataFrame and gives a streaming DataFrame, or folds the table that one
has written; the batch operators are reused unchanged. No result hangs on how the input is cut into
files and batches: aggregations without a ``delay`` keep one state row per key and drop nothing, and
order-dependent folds (smoothing, restarts, activity runs) are made over appended rows in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import code, findings, interactions, logs, sessions
from ..sources.growing import grown_lines, read_growth
from .io import versioned


def event_time(stream: DataFrame, delay: str | None = None, column: str = "ts") -> DataFrame:
    """``column`` as a timestamp. With ``delay`` state older than that is given up and rows behind it are
    late (``io.late_rows`` counts them); without, as for a backfill, nothing is ever late."""
    timed = stream.withColumn(column, F.col(column).cast("timestamp"))
    return timed.withWatermark(column, delay) if delay else timed


# -- logs ------------------------------------------------------------------------


def log_events(lines: DataFrame) -> DataFrame:
    """Log lines to events; stateless, so every line is parsed once and kept."""
    return logs.parse_lines(lines)


def growing_log_events(spark: SparkSession, path: str, state: str, glob: str = "*.log") -> DataFrame:
    """Events of log files that are still written to: one pass over what they have grown by since the last pass with ``state``.

    Call it again and again, with the pause one likes: each pass lists the folder and reads only bytes behind those that the ledger knows, and
    the result is the events of all lines so far (a crash trace or a rate may go over passes), as if the files were read at once.
    """
    read_growth(spark, path, state, glob)
    return logs.parse_lines(grown_lines(spark, state))


def session_counters(lines: DataFrame) -> DataFrame:
    """Crashes, compile errors and best coverage per session, kept up to date."""
    events = logs.handled_events(logs.dispatch_tools(lines))
    return events.groupBy(F.col("file").alias("session")).agg(
        F.count_if(F.col("kind").isin("crash_found", "crash_start")).alias("unique_crashes"),
        F.count_if(F.col("kind") == "compilation_error").alias("failed_compilations"),
        F.count_if(F.col("kind") == "finding").alias("findings"),
        F.max(F.when(F.col("kind") == "coverage_data", F.col("percent"))).alias("best_coverage"),
    )


def crash_lines(lines: DataFrame) -> DataFrame:
    """The lines of crash files that open, close or stand in a trace or are a report; all others go as they are read."""
    return lines.filter(logs.counts_for_crashes(T.strip(F.col("raw_line")))).select("file", "line_number", "raw_line")


def crash_file_findings(lines: DataFrame) -> DataFrame:
    """Findings of crash files, over appended lines.

    A batch brings any lines of any files and writes its own only. A trace that batches cut is put together here, in the order of
    the line numbers, by fixed runs of them; a line that was read twice counts once.
    """
    return findings.crash_log_findings(lines.dropDuplicates(["file", "line_number"]))


# -- replies and code ------------------------------------------------------------


def scored_replies(replies: DataFrame) -> DataFrame:
    """Hallucination score and token counts of every reply."""
    scored = interactions.score_replies(replies)
    return scored.select(
        "interaction_id",
        "session_id",
        "language",
        "hallucination_detected",
        "confidence",
        (interactions.estimate_tokens(F.col("prompt_text")) + interactions.estimate_tokens(F.col("response_text"))).alias("total_tokens"),
    )


def reply_totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("session_id").agg(
        F.count("*").alias("total_llm_interactions"),
        F.sum("total_tokens").alias("total_tokens_consumed"),
        F.count_if("hallucination_detected").alias("detected"),
    )


def new_code_files(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each distinct text of a session once: later copies within the watermark are dropped.

    The arrival time of the file is the event time.
    """
    hashed = files.withColumn("source_hash", F.sha2("content", 256)).withWatermark("arrived_at", delay)
    fresh = hashed.dropDuplicatesWithinWatermark(["session_id", "source_hash"])
    issues = code.security_issues(F.col("content"), F.col("language"))
    return fresh.select(
        "session_id",
        "source_hash",
        "language",
        code.cyclomatic(F.col("content")).alias("cyclomatic_complexity"),
        F.size(issues).cast("bigint").alias("security_issues"),
        T.joined(F.transform(issues, lambda i: i["kind"])).alias("issue_kinds"),
    )


# -- resources, rates, health ----------------------------------------------------


def resource_samples(metrics: DataFrame) -> DataFrame:
    """What the smoothed figures need of every sample."""
    return metrics.select("session_id", "ts", "event_id", "cpu_percent", "memory_mb")


def resource_state(samples: DataFrame) -> DataFrame:
    """Smoothed CPU and peaks per session, over appended samples.

    A late sample changes all later averages, so samples are put in time order here and not in their
    batches; the fold is spread over tasks by ranges of (session, time).
    """
    smooth = sessions.smoothed_cpu(samples).withColumnRenamed("smoothed", "average_cpu")
    return smooth.join(sessions.peaks(samples).drop("samples"), "session_id")


RATE_LIMIT, RATE_MICROS = 60, 60_000_000


def rate_requests(requests: DataFrame) -> DataFrame:
    """Provider and time of every request."""
    return requests.select("provider", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def _rate_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per provider and task: what its requests do to a counter, for every place a restart can fall.

    A counter that comes in restarts with the first request after its minute, which is one of the first
    minute of the segment or the next one. For each such request: restarts and requests over the limit
    from it on, and the last restart with its requests.
    """
    held: list[pd.DataFrame] = []

    def fold() -> pd.DataFrame:
        rows = pd.concat(held)
        times = rows["at"].to_numpy()
        n = len(times)
        following = np.searchsorted(times, times + RATE_MICROS, side="right")
        # Chains by doubling: each pass joins a request's part of its chain with the equally long part behind it. Place n ends all chains.
        places, following = np.arange(n + 1), np.append(following, n)
        restarts, last = np.append(np.ones(n, np.int64), 0), places.copy()
        limited = np.where(following < n, np.maximum(0, following - places - RATE_LIMIT), 0)
        while (following < n).any():
            restarts, limited = restarts + restarts[following], limited + limited[following]
            last = np.where(following < n, last[following], last)
            following = following[following]
        restarts, limited, last = restarts[:n], limited[:n], last[:n]
        entries = min(int(np.searchsorted(times, times[0] + RATE_MICROS, side="right")) + 1, n)
        own = last[:entries]
        table = (times[:entries], restarts[:entries], limited[:entries], times[own], n - own)
        return pd.DataFrame(
            {"provider": [rows["provider"].iloc[0]], "task": [int(rows["task"].iloc[0])], "requests": [n], "last_at": [int(times[-1])],
             "entries": [np.stack(table).astype("<i8").tobytes()]}
        )

    for batch in batches:
        for _, run in batch.groupby((batch["provider"] != batch["provider"].shift()).cumsum(), sort=False):
            if held and held[-1]["provider"].iloc[0] != run["provider"].iloc[0]:
                yield fold()
                held = []
            held.append(run)
    if held:
        yield fold()


def _rate_chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of each provider in order: one counter (restart time, requests since) goes through them."""
    provider, reset, count, limited, resets = None, None, 0, 0, 0

    def out() -> pd.DataFrame:
        over = limited + max(0, count - RATE_LIMIT)
        return pd.DataFrame({"provider": [provider], "in_window": [count], "limited": [over], "resets": [resets]})

    for batch in batches:
        for row in batch.itertuples():
            if row.provider != provider:
                if provider is not None:
                    yield out()
                provider, reset, count, limited, resets = row.provider, None, 0, 0, 0
            times, restarts, over, last, after = np.frombuffer(row.entries, dtype="<i8").reshape(5, -1)
            if reset is not None and row.last_at <= reset + RATE_MICROS:
                count += row.requests
                continue
            at = 0 if reset is None else int(np.searchsorted(times, reset + RATE_MICROS, side="right"))
            limited += max(0, count + at - RATE_LIMIT) + int(over[at])
            resets += int(restarts[at])
            reset, count = int(last[at]), int(after[at])
    if provider is not None:
        yield out()


def rate_counters(requests: DataFrame) -> DataFrame:
    """Requests in the current window, requests over the limit and restarts per provider, over appended requests.

    The rule is a chain: a counter restarts with the first request more than a minute after the last
    restart. Requests are range-partitioned by (provider, time); a task says for each possible
    restart in its first minute where the chain goes, and the counter then takes one lookup per segment.
    """
    ranged = requests.repartitionByRange("provider", "at").sortWithinPartitions("provider", "at")
    ranged = ranged.select("provider", "at", F.spark_partition_id().alias("task"))
    segments = ranged.mapInPandas(_rate_segments, "provider STRING, task INT, requests BIGINT, last_at BIGINT, entries BINARY")
    return (
        segments.repartition("provider")
        .sortWithinPartitions("provider", "task")
        .mapInPandas(_rate_chain, "provider STRING, in_window BIGINT, limited BIGINT, resets BIGINT")
    )


_RUN = "session_id STRING, first TIMESTAMP, last TIMESTAMP, events BIGINT, last_id BIGINT, last_type STRING"


def _activity_runs(rows: DataFrame, gap: str, *within: str) -> DataFrame:
    """Rows (session_id, first, last, events, last_id, last_type) less than ``gap`` apart put together.

    With ``within`` only inside these columns: a first step that leaves few rows of a busy session.
    """
    ordered = Window.partitionBy("session_id", *within).orderBy("first", "last")
    before = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") >= F.col("before") + F.expr(f"interval {gap}"), F.lit(True))
    numbered = rows.withColumn("before", before).withColumn("run", F.sum(opens.cast("int")).over(ordered))
    return (
        numbered.groupBy("session_id", *within, "run")
        .agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"),
            F.max(F.struct("last", "last_id", "last_type")).alias("end"),
        )
        .select("session_id", "first", "last", "events", "end.last_id", "end.last_type")
    )


def session_lifecycle(events: DataFrame, label: str, gap: str = "6 hours", analysis: str = "1 hour", **where) -> DataFrame:
    """Activity runs per session with their state, open ones included: a run ends after ``gap`` without events.

    Batches append the runs of their own events; runs of any batches that touch are one run, so the order
    of arrival does not matter. The clock is the newest event. An open run is ``initializing`` with
    its first event, then ``running``; a run that ended within ``analysis`` before the clock is
    ``analyzing``; after that it is ``failed`` if its last event was an error, ``interrupted`` if it was a
    signup that nothing followed, else ``completed``.
    """

    def change(batch: DataFrame) -> DataFrame:
        single = batch.select(
            "session_id", F.col("ts").cast("timestamp").alias("first"), F.col("ts").cast("timestamp").alias("last"),
            F.lit(1).cast("bigint").alias("events"), F.col("event_id").alias("last_id"), F.col("event_type").alias("last_type"),
        )
        return by_day(single).drop("batch")

    def by_day(rows: DataFrame) -> DataFrame:
        runs = _activity_runs(rows.withColumn("day", F.to_date("first")), gap, "day")
        return runs.withColumn("batch", F.lit(None).cast("bigint"))

    schema = StructType.fromDDL(_RUN)
    runs = _activity_runs(versioned(events, label, schema, change, by_day, "append", **where), gap)
    clock = runs.agg(F.max("last").alias("clock"))
    ended = F.col("last") + F.expr(f"interval {gap}")
    status = (
        F.when((ended > F.col("clock")) & (F.col("events") == 1), "initializing")
        .when(ended > F.col("clock"), "running")
        .when(ended + F.expr(f"interval {analysis}") > F.col("clock"), "analyzing")
        .when(F.col("last_type") == "error", "failed")
        .when(F.col("last_type") == "signup", "interrupted")
        .otherwise("completed")
    )
    return runs.join(F.broadcast(clock)).select(
        "session_id", F.col("first").alias("started"), ended.alias("ended"), "events", status.alias("status")
    )


def minute_snapshots(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Per-minute activity and efficiency of every session."""
    timed = event_time(events, delay)
    return (
        timed.groupBy("session_id", F.window("ts", "1 minute").alias("w"))
        .agg(
            F.count_if(F.col("event_type") == "click").alias("drivers"),
            F.count_if(F.col("event_type") == "error").alias("crashes"),
            F.max("value").alias("peak_memory_mb"),
        )
        .select(
            "session_id",
            F.col("w.start").alias("minute"),
            "drivers",
            "crashes",
            F.greatest(F.lit(0.0), 1.0 - F.col("peak_memory_mb") / F.greatest("drivers", F.lit(1)) / 1000).alias("memory_efficiency"),
            (F.col("drivers") * 60.0).alias("drivers_per_hour"),
        )
    )


def hour_panes(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Totals per hour: the panes that a sliding day is laid out with, one state row per hour."""
    timed = event_time(events, delay)
    return (
        timed.groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(
            F.count("*").alias("events"),
            F.count_if(F.col("event_type") == "click").alias("drivers"),
            F.count_if(F.col("event_type") == "error").alias("vulnerabilities"),
            F.max("value").alias("highest"),
        )
        .select(F.col("w.start").alias("hour"), "events", "drivers", "vulnerabilities", "highest")
    )


def sliding_day(panes: DataFrame) -> DataFrame:
    """Totals over the 24 hours from every hour, out of hour panes: a pane belongs to 24 days, an event to one pane."""
    starts = F.sequence(F.col("hour") - F.expr("interval 23 hours"), F.col("hour"), F.expr("interval 1 hour"))
    totals = [F.sum(name).alias(name) for name in ("events", "drivers", "vulnerabilities")]
    return panes.withColumn("from", F.explode(starts)).groupBy("from").agg(*totals, F.max("highest").alias("highest"))


def latest_health(health: DataFrame) -> DataFrame:
    return interactions.latest_health(health)


def stale(latest: DataFrame, as_of: str, seconds: int = 300) -> DataFrame:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    return latest.withColumn("is_stale", age > seconds * 1_000_000)


def error_alerts(requests: DataFrame, threshold: float = 0.1, delay: str | None = None) -> DataFrame:
    """Error rate per provider and five minutes, with the alert flag."""
    timed = event_time(requests, delay)
    return (
        timed.groupBy("provider", F.window("ts", "5 minutes").alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "unhealthy").alias("errors"))
        .select(
            "provider", F.col("w.start").alias("from"), "requests", "errors",
            (F.col("errors") / F.col("requests") > threshold).alias("alert"),
        )
    )


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """The listed files of every snapshot; ``snapshot`` is its number."""
    return snapshots.select("snapshot", "path", "mtime")


def file_changes(rows: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Changes of each snapshot against the one numbered one less, over appended rows.

    ``manifest`` says how many ``files`` each ``snapshot`` lists: one with fewer rows so far is still arriving, and neither its changes nor those of the next
    are given before it is whole; a snapshot of no files has no rows and deletes all. Without a manifest every snapshot with a
    row counts as whole. The fold is made over the table, not over batches; a row that came twice counts once.
    """
    rows = rows.dropDuplicates(["snapshot", "path"])
    arrived = rows.groupBy("snapshot").agg(F.count("*").alias("arrived"))
    if manifest is None:
        whole = arrived.select("snapshot")
    else:
        listed = manifest.groupBy("snapshot").agg(F.max("files").alias("files"))
        there = F.coalesce(F.col("arrived"), F.lit(0)) >= F.col("files")
        whole = listed.join(arrived, "snapshot", "left").filter(there).select("snapshot")
    later = whole.join(whole.select((F.col("snapshot") + 1).alias("snapshot")), "snapshot")  # with a whole one before them
    old = rows.select((F.col("snapshot") + 1).alias("snapshot"), "path", F.col("mtime").alias("old"))
    new = rows.select("snapshot", "path", F.col("mtime").alias("new"), F.lit(True).alias("is_there"))
    both = old.withColumn("was_there", F.lit(True)).join(new, ["snapshot", "path"], "full_outer").join(later, "snapshot", "left_semi")
    change = (
        F.when(F.col("was_there").isNull(), "created")
        .when(F.col("is_there").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return both.select("snapshot", "path", change.alias("change"), "old", "new").filter("change is not null")
