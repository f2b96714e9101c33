"""Crashes and findings: detection, risk, false positives, remediation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.numbers import clamp
from .logs import trace_frames, trace_state

W = T.WORD
FRAME_CALL = rf"(?:in|at)\s+{W}+|{W}+\s*\("
NULL_ADDRESS = r"0x0+(?:\s|$)|0x00000000"
UNLISTED_SEVERITY = "medium"


def _finding(kind, severity, confidence, method: str, detail: Column | None = None, line: Column | None = None) -> Column:
    def col(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(kind).alias("vulnerability_type"),
        col(severity).alias("severity"),
        col(confidence).cast("double").alias("confidence_score"),
        F.lit(method).alias("detection_method"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
        (F.lit(None) if line is None else line).cast("bigint").alias("line_number"),
    )


def known_severity(kind: str) -> str:
    return {row[0]: row[1] for row in rules.VULNERABILITIES}.get(kind, UNLISTED_SEVERITY)


def pattern_findings(source: Column) -> Column:
    """Every hit of a security rule, with its line."""

    table = rules.rule_array(rules.SECURITY_RULES)
    used = T.let(F.lower(source), lambda low: F.filter(table, lambda rule: rules.may_match(rule, low)))
    severity = {kind: known_severity(kind) for kind, _ in rules.SECURITY_RULES}
    hits = F.transform(
        used,
        lambda rule: F.transform(
            T.located(source, rule["pattern"]),
            lambda hit: _finding(
                rule["category"], rules.lookup(rule["category"], severity), 0.7, "pattern_matching", hit["match"], hit["line"]
            ),
        ),
    )
    return F.flatten(hits)


def signature_findings(signature: Column) -> Column:
    """One finding per signature rule that matches; surer when it matches twice."""
    parts = []
    for kind, pattern in rules.SIGNATURE_RULES:
        count = T.hits(signature, pattern)
        confidence = F.when(count > 1, 0.6 + 0.3).otherwise(0.6)
        parts.append(
            F.when(count > 0, _finding(kind, known_severity(kind), confidence, "crash_signature_analysis", F.lit(pattern)))
        )
    return F.array_compact(F.array(*parts))


def frame_functions(trace: Column) -> Column:
    """Function names of a stack trace, in order, repeats kept."""
    return F.transform(
        T.matches(trace, FRAME_CALL),
        lambda m: F.when(m.endswith("("), F.regexp_extract(m, rf"^({W}+)", 1)).otherwise(
            F.regexp_extract(m, rf"({W}+)$", 1)
        ),
    )


def call_findings(trace: Column) -> Column:
    """One finding per dangerous function called in the frames."""
    dangerous = F.filter(frame_functions(trace), lambda f: f.isin(*[name for name, _ in rules.DANGEROUS_FUNCTIONS]))
    return F.transform(
        dangerous,
        lambda f: _finding(rules.lookup(f, rules.DANGEROUS_FUNCTIONS), "medium", 0.5, "stack_trace_analysis", f),
    )


def trace_findings(trace: Column) -> Column:
    """Dangerous functions in the frames, and a null address anywhere."""
    null = F.when(
        trace.rlike(NULL_ADDRESS), _finding("null_pointer_dereference", "medium", 0.8, "stack_trace_analysis")
    )
    return F.concat(call_findings(trace), F.array_compact(F.array(null)))


def memory_findings(heap_corruption: Column, stack_overflow: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(heap_corruption, _finding("use_after_free", "high", 0.9, "memory_analysis")),
            F.when(stack_overflow, _finding("buffer_overflow", "high", 0.9, "memory_analysis")),
        )
    )


def crash_findings(crashes: DataFrame, *keys: str) -> DataFrame:
    """All findings of every crash; one projection and one explode. Source text is searched if ``source_code`` is there."""
    source = [pattern_findings(F.coalesce("source_code", F.lit("")))] if "source_code" in crashes.columns else []
    found = F.concat(
        *source,
        signature_findings(F.col("signature")),
        trace_findings(F.coalesce(F.col("stack_trace"), F.lit(""))),
        memory_findings(F.col("heap_corruption"), F.col("stack_overflow")),
    )
    rows = crashes.select(*keys, F.posexplode(found).alias("seq", "f")).select(*keys, "seq", "f.*")
    natural = F.concat_ws("|", *keys, F.col("seq"), "detection_method", "vulnerability_type")
    return rows.withColumn("finding_id", F.sha2(natural, 256))


def crash_analysis(crashes: DataFrame, *keys: str) -> DataFrame:
    """One row per crash: its findings' risk, how likely they are false, and what to do, most urgent first.

    A crash without findings has none of these and gives no row. The plan has a row per vulnerability
    type at most, so it is a short list.
    """
    found = crash_findings(crashes, *keys)
    doubt = found.select(*keys, false_positive_probability().alias("p")).groupBy(*keys).agg(
        F.avg("p").alias("false_positive_probability"), F.count_if(F.col("p") > 0.3).alias("to_verify")
    )
    steps = remediation_plan(found, *keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("order"), "vulnerability_type"))).alias("steps")
    )
    plan = F.transform("steps", lambda s: F.concat_ws(":", -s["order"], s["vulnerability_type"]))
    return risk(found, *keys).join(doubt, [*keys]).join(steps.select(*keys, plan.alias("plan")), [*keys], "left")


def crash_log_findings(lines: DataFrame) -> DataFrame:
    """Findings of crash dumps, straight from their lines.

    A stack trace stays a set of frame rows: functions are looked up per frame and a null
    address counts once per crash, so a trace of any length is never one value.
    """
    state = trace_state(lines)
    key = ["file", "crash_line"]
    starts = state.filter("starts").select("file", F.col("line_number").alias("crash_line"), "raw_line")
    message = F.col("raw_line")
    heap = F.lower(message).contains("heap")
    signed = starts.select(*key, F.explode(F.concat(signature_findings(message), memory_findings(heap, F.lit(False)))).alias("f"))
    frames = trace_frames(state)
    frame = F.col("frame")
    calls = frames.select(*key, F.explode(call_findings(frame)).alias("f"))
    null = _finding("null_pointer_dereference", "medium", 0.8, "stack_trace_analysis")
    nulls = frames.filter(frame.rlike(NULL_ADDRESS)).select(*key).distinct().select(*key, null.alias("f"))
    return signed.unionByName(calls).unionByName(nulls).select(*key, "f.*")


# -- risk ------------------------------------------------------------------------


def _severity(column: int, default=None) -> Column:
    return rules.lookup(F.col("severity"), [(row[0], row[column]) for row in rules.SEVERITIES], default)


def risk(findings: DataFrame, *keys: str) -> DataFrame:
    """Mean severity weight, level, severity counts, exploitability, vectors and impact.

    Every figure is a plain aggregate, so a group of any size folds on the map side.
    """
    exploitable = F.count_if(F.col("vulnerability_type").isin(*rules.EXPLOITABLE))
    vectors: dict[str, list[str]] = {}
    for kind, vector in rules.ATTACK_VECTORS:
        vectors.setdefault(vector, []).append(kind)
    seen = [
        F.when(F.max(F.col("vulnerability_type").isin(*kinds)), F.lit(vector)) for vector, kinds in sorted(vectors.items())
    ]
    score = F.avg(_severity(2))
    summary = findings.groupBy(*keys).agg(
        F.count("*").alias("findings"),
        score.alias("risk_score"),
        *[F.count_if(F.col("severity") == row[0]).alias(f"{row[0]}_count") for row in rules.SEVERITIES],
        exploitable.alias("highly_exploitable_count"),
        F.least(exploitable * 0.3, F.lit(1.0)).alias("exploitability_score"),
        F.array_compact(F.array(*seen)).alias("attack_vectors"),
        F.max(_severity(4)).alias("overall_business_impact"),
    )
    level = (
        F.when(F.col("risk_score") >= 7.5, "critical")
        .when(F.col("risk_score") >= 5.0, "high")
        .when(F.col("risk_score") >= 2.5, "medium")
        .otherwise("low")
    )
    return summary.withColumn("overall_risk", level).withColumn(
        "availability_impact", F.col("overall_business_impact") * 0.8
    )


# -- false positives -------------------------------------------------------------


def false_positive_probability() -> Column:
    method = rules.lookup(F.col("detection_method"), rules.METHOD_FACTORS, 1.0)
    kind = rules.lookup(F.col("vulnerability_type"), rules.TYPE_FACTORS, 1.0)
    return clamp(F.lit(0.1) * (1.0 - F.col("confidence_score")) * method * kind, 0.0, 1.0)


def false_positives(findings: DataFrame) -> DataFrame:
    """Probability, reasons, and whether to verify. Reads ``stack_trace`` and ``code_snippet``."""
    reasons = T.present(
        (F.col("confidence_score") < 0.5, "Low confidence score"),
        (F.col("detection_method") == "pattern_matching", "Pattern-based detection can have false positives"),
        (F.coalesce("stack_trace", F.lit("")) == "", "No stack trace for verification"),
        (F.coalesce("code_snippet", F.lit("")) == "", "No code snippet for manual review"),
    )
    return (
        findings.withColumn("probability", false_positive_probability())
        .withColumn("factors", reasons)
        .withColumn("verification_needed", F.col("probability") > 0.3)
    )


# -- lookups and remediation -----------------------------------------------------


def with_vulnerability_facts(findings: DataFrame) -> DataFrame:
    """Inner join with the known vulnerability types; others are dropped."""
    known = rules.dim(findings.sparkSession, rules.VULNERABILITIES, rules.VULNERABILITY_COLUMNS)
    return findings.join(F.broadcast(known), "vulnerability_type")


def with_defaults(findings: DataFrame) -> DataFrame:
    """Left joins with the effort, verification and timeline tables, with their defaults."""
    spark = findings.sparkSession
    effort = rules.dim(spark, rules.EFFORTS, "vulnerability_type string, effort string")
    steps = rules.dim(spark, rules.VERIFICATION, "vulnerability_type string, verification_steps array<string>")
    timeline = rules.dim(spark, rules.SEVERITIES, rules.SEVERITY_COLUMNS).select("severity", "immediate", "complete")
    return (
        findings.join(F.broadcast(effort), "vulnerability_type", "left")
        .join(F.broadcast(steps), "vulnerability_type", "left")
        .join(F.broadcast(timeline), "severity", "left")
        .withColumn("effort", F.coalesce("effort", F.lit("medium")))
        .withColumn("verification_steps", F.coalesce("verification_steps", F.array(F.lit(rules.DEFAULT_VERIFICATION))))
    )


def remediation_plan(findings: DataFrame, *keys: str) -> DataFrame:
    """One row per known vulnerability type (and ``keys``), most urgent first.

    Findings fold to one row per type before any lookup table is joined.
    """
    rank = rules.severity_rank(F.col("severity"))
    grouped = findings.groupBy(*keys, "vulnerability_type").agg(
        F.count("*").alias("affected_count"),
        F.max_by("severity", rank).alias("severity"),
        F.avg("confidence_score").alias("mean_confidence"),
    )
    base = rules.lookup(F.col("severity"), [(row[0], row[3]) for row in rules.SEVERITIES])
    priority = F.floor(base + F.least(F.col("affected_count") * 0.5, F.lit(2.0)) + F.col("mean_confidence"))
    plan = with_defaults(with_vulnerability_facts(grouped)).select(
        *keys,
        "vulnerability_type",
        "affected_count",
        F.least(priority, F.lit(10)).cast("int").alias("priority"),
        F.col("effort").alias("estimated_effort"),
        F.slice("remediation", 1, 2).alias("immediate_actions"),
        F.expr("slice(remediation, 3, greatest(size(remediation) - 2, 0))").alias("long_term_solutions"),
        "verification_steps",
        F.col("immediate").alias("timeline_immediate"),
        F.col("complete").alias("timeline_complete"),
    )
    return plan.orderBy(*keys, F.desc("priority"), "vulnerability_type")
