from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trialscope.functions import text as T
from trialscope.operators import logs


def lines(spark, *texts, file="f"):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "file string, line_number bigint, raw_line string")


CRASH_DUMP = [
    "# before anything",
    "Segmentation fault SIGSEGV",
    "#0 0x41 in strcpy lib.c",
    "a stray line",
    "at 0xdead in main",
    "# asan frame of the open trace",
    "crash again",
    "#0 0x0 in free a.c",
    "",
    "#1 after the blank",
    "MSan: bad read",
    "asan and msan",
]


def check_crash_dump(spark):
    df = lines(spark, *CRASH_DUMP)
    rows = {r["crash_line"]: r for r in logs.crash_traces(df).collect()}
    assert sorted(rows) == [2, 7]
    assert rows[2]["frames"] == 3 and rows[2]["first_frame"].startswith("#0 0x41") and rows[2]["last_frame"].startswith("# asan")
    assert rows[7]["frames"] == 1
    assert rows[2]["signal"] == "SEGV" and rows[7]["signal"] is None
    reports = {(r["line_number"], r["sanitizer"]) for r in logs.sanitizer_reports(df).collect()}
    assert reports == {(11, "msan"), (12, "asan")}


def test_crash_dump(spark):
    check_crash_dump(spark)


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_crash_dump_cut_into_runs(spark, monkeypatch, run):
    monkeypatch.setattr(logs, "LINES_PER_RUN", run)
    check_crash_dump(spark)


def test_trace_spanning_many_runs(spark, monkeypatch):
    monkeypatch.setattr(logs, "LINES_PER_RUN", 4)
    df = lines(spark, "crash here", *[f"#{i} 0x1 in f" for i in range(50)], "", "#9 0x1 in g")
    (row,) = logs.crash_traces(df).collect()
    assert row["frames"] == 50 and row["last_frame"] == "#49 0x1 in f"


def test_final_statistics_keep_the_last_value(spark):
    df = lines(spark, "execs_done : 10", "speed : 1.5", "Target Mode : text:x", "execs_done : 12", "saved crash", " no key")
    rows = {r["key"]: r for r in logs.final_statistics(df).collect()}
    assert sorted(rows) == ["execs_done", "speed", "target_mode"]
    assert rows["execs_done"]["int_value"] == 12 and rows["execs_done"]["double_value"] is None
    assert rows["speed"]["double_value"] == 1.5 and rows["target_mode"]["value"] == "text:x"


def test_one_line_can_give_several_events(spark):
    kinds = [r["kind"] for r in logs.tool_events(lines(spark, "asan crash: leak"), "libfuzzer").collect()]
    assert sorted(kinds) == ["crash_found", "leak_found"]
    (row,) = logs.tool_events(lines(spark, "#99 INITED cov: 3 exec/s: 17"), "libfuzzer").collect()
    assert (row["kind"], row["iterations"], row["per_second"]) == ("execution_stats", 99, 17)


def test_units(values):
    assert values(logs.memory_mb, "memory: 2 gb", "mem 512 KB", "memory 1048576 bytes", "mem: 3.5mb", "none") == [2048.0, 0.5, 1.0, 3.5, None]
    assert values(logs.duration_ms, "took 5 ms", "took 2 s", "exec: 3 seconds", "execution 2 minutes", "no") == [5.0, 2000.0, 3000.0, 120000.0, None]


def test_last_kind_wins(values):
    assert values(logs.line_kind, "crash", "crash and exploit", "crash exploit by claude", "fine") == [
        "crash", "vulnerability", "llm_interaction", "log_line",
    ]


def test_word_boundaries_are_unicode(values):
    assert values(lambda c: c.rlike(logs.CRASH), "écrash", "crashé", "a crash!") == [False, False, True]


def test_tail_and_head(spark):
    df = lines(spark, *[str(i) for i in range(9)])
    assert sorted(r["line_number"] for r in logs.tail(df, 3).collect()) == [7, 8, 9]
    assert [r["line_number"] for r in logs.head(df, 2).collect()] == [1, 2]


def test_blank_lines_are_dropped_and_counted_once(spark):
    df = lines(spark, "  ", "\ttook 5 ms ", "")
    (row,) = logs.log_statistics(df).collect()
    assert (row["total_lines"], row["execution_events"]) == (1, 1)


def test_added_line_parser(spark):
    parsers = {"own": lambda line: [logs.event("hit", line.contains("x"))]}
    df = lines(spark, "x", "y").withColumn("tool", F.lit("own"))
    assert logs.dispatch_tools(df, parsers).count() == 1


def test_parsed_lines_equal_the_plain_patterns(spark):
    lines = [
        "MEM: 12.5 GB pid 7", "Memory 3 kb", "member 5 mb", "EXEC: 3 s", "took 2 minutes", "CPU: 55%", "Coverage: 12.5%", "coverage none",
        "Crash SIGSEGV signal 11 at 0xAB", "crashes", "CVE-2024-17 EXPLOIT", "Use After Free", "GPT-4 tokens: 12 $0.5", "plain", "PID: 9 claude-2",
    ]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "file string, line_number bigint, raw_line string")
    line = F.col("raw_line")
    plain = {
        "pid": T.whole_number(line, logs.PROCESS_ID),
        "memory_mb": logs.memory_mb(line),
        "cpu_percent": T.number(line, logs.CPU),
        "execution_time_ms": logs.duration_ms(line),
        "coverage_percent": T.number(line, logs.COVERAGE),
        "is_crash": line.rlike(logs.CRASH),
        "is_vulnerability": line.rlike(logs.VULNERABILITY),
        "kind": logs.line_kind(line),
    }
    parsed = logs.parse_lines(df)
    for name, column in plain.items():
        assert parsed.filter(~F.col(name).eqNullSafe(column)).count() == 0, name
    assert parsed.filter("is_crash").count() == 1 and parsed.filter("memory_mb is not null").count() == 2
