from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from trialscope.functions.statistics import p_value
from trialscope.operators import experiments, findings, sessions

CRASH = "crash_id bigint, signature string, stack_trace string, heap_corruption boolean, stack_overflow boolean"


def found(spark, *crash):
    df = spark.createDataFrame([(1, *crash)], CRASH)
    rows = findings.crash_findings(df, "crash_id").orderBy("seq").collect()
    return [(r["vulnerability_type"], r["severity"], round(r["confidence_score"], 2), r["detection_method"]) for r in rows]


def test_every_detector(spark):
    assert found(spark, "SIGSEGV: heap overflow, heap overflow", "at strcpy\n#1 free (x)\n0x0 end", True, True) == [
        ("buffer_overflow", "high", 0.6, "crash_signature_analysis"),
        ("null_pointer_dereference", "medium", 0.6, "crash_signature_analysis"),
        ("buffer_overflow", "medium", 0.5, "stack_trace_analysis"),
        ("use_after_free", "medium", 0.5, "stack_trace_analysis"),
        ("null_pointer_dereference", "medium", 0.8, "stack_trace_analysis"),
        ("use_after_free", "high", 0.9, "memory_analysis"),
        ("buffer_overflow", "high", 0.9, "memory_analysis"),
    ]
    assert found(spark, "timeout", "", False, False) == []


def test_a_signature_seen_on_two_lines_is_surer(spark):
    assert found(spark, "sigsegv\nsigsegv", "", False, False) == [("null_pointer_dereference", "medium", 0.9, "crash_signature_analysis")]


def test_frame_functions(values):
    assert values(findings.frame_functions, "at main (x.c:1)", "#0 0x1 in strcpy lib.c\n#1 gets(") == [["main"], ["strcpy", "gets"]]


def test_plan_priority_and_order(spark):
    rows = [("sql_injection", "low", 0.5)] * 2 + [("buffer_overflow", "high", 0.9), ("buffer_overflow", "critical", 0.9), ("memory_leak", "critical", 1.0)]
    plan = findings.remediation_plan(spark.createDataFrame(rows, "vulnerability_type string, severity string, confidence_score double")).collect()
    assert [(r["vulnerability_type"], r["affected_count"], r["priority"], r["estimated_effort"], r["timeline_complete"]) for r in plan] == [
        ("buffer_overflow", 2, 10, "high", "1 week"),
        ("sql_injection", 2, 3, "medium", "3 months"),
    ]
    assert len(plan[0]["immediate_actions"]) == 2 and len(plan[0]["long_term_solutions"]) == 2


def test_risk_levels(spark):
    rows = [("a", "buffer_overflow", s) for s in ("critical", "medium")] + [("b", "memory_leak", "info")]
    got = {r["g"]: r for r in findings.risk(spark.createDataFrame(rows, "g string, vulnerability_type string, severity string"), "g").collect()}
    assert (got["a"]["risk_score"], got["a"]["overall_risk"], got["a"]["exploitability_score"]) == (7.5, "critical", 0.6)
    assert got["a"]["attack_vectors"] == ["code_execution", "memory_corruption"] and got["a"]["availability_impact"] == 0.8
    assert (got["b"]["overall_risk"], got["b"]["attack_vectors"]) == ("low", [])


def finite_sum(r_squared, points):
    """Student's distribution in closed form, for a whole number of degrees of freedom."""
    v, x, r = points - 2, 1 - r_squared, math.sqrt(r_squared)
    total, term = 0.0, 1.0
    for j in range(v // 2 if v % 2 == 0 else (v - 1) // 2):
        total += term
        term *= x * ((2 * j + 1) / (2 * j + 2) if v % 2 == 0 else (2 * j + 2) / (2 * j + 3))
    return 1 - r * total if v % 2 == 0 else 1 - 2 / math.pi * (math.asin(r) + r * math.sqrt(x) * total)


def test_p_values(spark):
    rows = [(r, n) for n in (3, 4, 5, 6, 9, 10, 31, 100, 1001, 20000) for r in (0.0, 1e-9, 1e-5, 0.001, 0.01, 0.25, 0.5, 0.81, 0.999, 1.0)]
    rows += [(None, 5), (0.5, 2), (0.5, None), (math.nan, 5)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, r double, n bigint")
    got = [r["p"] for r in df.select("i", p_value(F.col("r"), F.col("n")).alias("p")).orderBy("i").collect()]
    # Two-sided t tests: r = 0.5, n = 10 and r = 0.9, n = 4 from tables.
    assert got[rows.index((0.25, 10))] == pytest.approx(0.1411, abs=2e-4)
    assert got[rows.index((0.81, 4))] == pytest.approx(0.1, abs=1e-9)
    assert got[-4:] == [None] * 4
    assert got[:-4] == [pytest.approx(finite_sum(*row), abs=1e-10) for row in rows[:-4]]


def trend(spark, points):
    rows = [("p", f"2024-01-01 00:00:{x:02d}", float(y), y, 0.0) for x, y in points]
    df = spark.createDataFrame(rows, "llm_provider string, start_time string, total_duration_ms double, fuzz_drivers_generated bigint, estimated_cost_usd double")
    df = df.withColumn("start_time", F.col("start_time").cast("timestamp"))
    return {r["measure"]: r for r in sessions.trends(df, "llm_provider").collect()}


def test_trends(spark):
    assert trend(spark, [(0, 1), (1, 2)]) == {}
    rows = trend(spark, [(0, 3), (1, 2), (2, 1)])
    assert rows["duration"]["slope"] == pytest.approx(-1) and rows["duration"]["trend_direction"] == "improving"
    assert rows["duration"]["significance"] == "significant"
    assert rows["costs"]["trend_direction"] == "stable" and rows["costs"]["p_value"] == 1.0


def test_session_issues(spark):
    df = spark.createDataFrame(
        [("test", 12345, "now", 0, 0.0), ("", 0, None, -1, -0.1)],
        "session_id string, pid int, start_time string, total_tokens_consumed bigint, estimated_cost_usd double",
    )
    got = [r["x"] for r in df.select(sessions.issues().alias("x")).collect()]
    assert got == [[], ["Missing session ID", "Invalid PID", "Missing start time", "Negative token count", "Negative cost estimate"]]


def test_readable_bytes(values):
    assert values(lambda c: sessions.readable_bytes(c.cast("bigint")), "5", "2048", "3670016", str(2**41)) == ["5.0 B", "2.0 KB", "3.5 MB", "2.0 TB"]


def test_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([("r", "m0", "completed"), ("q", "m1", "failed")], "repo_name string, model string, status string")
    got = {(r["repo_name"], r["model"]): (r["runs"], r["completed"]) for r in experiments.model_matrix(df, ["m0", "m1"]).collect()}
    assert got == {("r", "m0"): (1, 1), ("r", "m1"): (0, 0), ("q", "m0"): (0, 0), ("q", "m1"): (1, 0)}


def test_readable_bytes_round_the_exact_value(values):
    sizes = [800000, 256, 768, 1049, 1000, 1048575, 1.15, 1.25, 0.05, 0.35, 0.95, 9.96, -1.25, -0.04, 2.5e15]
    expected = ["781.2 KB", "256.0 B", "768.0 B", "1.0 KB", "1000.0 B", "1024.0 KB"]
    found = values(lambda c: sessions.readable_bytes(c.cast("double")), *map(str, sizes))
    assert found[:6] == expected
    assert found[6:] == [f"{x:.1f} B" for x in sizes[6:-1]] + [f"{sizes[-1] / 2**40:.1f} TB"]
    many = [i * 0.05 for i in range(400)] + [i / 16 for i in range(400)]
    assert values(lambda c: sessions.readable_bytes(c.cast("double")), *map(repr, many)) == [f"{x:.1f} B" for x in many]
