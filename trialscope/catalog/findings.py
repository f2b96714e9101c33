"""Queries over crashes and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..functions import text as T
from ..operators import findings as fx
from . import sql as S
from .registry import query


def severity(column: int, col: str = "severity", kind: str = "") -> str:
    arms = " ".join(
        f"when '{row[0]}' then {S.lit(row[column]) if isinstance(row[column], str) else repr(row[column]) + kind}"
        for row in rules.SEVERITIES
    )
    return f"case {col} {arms} end"


def factor(col: str, rows) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v}::double" for k, v in rows) + " else 1.0::double end"


def found(spark, sf):
    return view(spark, sf, "findings")


# -- detection -------------------------------------------------------------------

PATTERN_ROWS = " union all ".join(
    f"select doc_id, '{kind}' as vulnerability_type, i as line_number, x as code_snippet from "
    f"(select doc_id, i, unnest({S.rall('l[i]', pattern)}) as x from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from "
    "(select doc_id, string_split(content, chr(10)) as l from source_files) a) u) v"
    for kind, pattern in rules.SECURITY_RULES
)


@query(
    "sc70_pattern_findings",
    oracle(
        "source_files",
        f"select doc_id, vulnerability_type, 'high' as severity, line_number, code_snippet, 0.7::double as confidence_score from ({PATTERN_ROWS}) t",
    ),
)
def _(spark, sf):
    hits = view(spark, sf, "source_files").select("doc_id", F.explode(fx.pattern_findings(F.col("content"))).alias("f"))
    return hits.select(
        "doc_id",
        "f.vulnerability_type",
        "f.severity",
        "f.line_number",
        F.col("f.detail").alias("code_snippet"),
        "f.confidence_score",
    )


SIGNATURE_ROWS = " union all ".join(
    f"select crash_id, session_id, '{kind}' as vulnerability_type, '{fx.known_severity(kind)}' as severity, "
    f"case when {S.rc('signature', p)} > 1 then 0.6::double + 0.3::double else 0.6::double end as confidence_score, "
    f"'crash_signature_analysis' as detection_method from crashes where {S.rl('signature', p)}"
    for kind, p in rules.SIGNATURE_RULES
)
CALL = rf"(?:in|at)\s+({T.WORD}+)|({T.WORD}+)\s*\("
DANGEROUS = "case f " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.DANGEROUS_FUNCTIONS) + " end"
FRAMES = (
    f"select crash_id, session_id, case when a <> '' then a else b end as f from (select crash_id, session_id, "
    f"unnest(regexp_extract_all(stack_trace, {S.lit(CALL)}, 1)) as a, unnest(regexp_extract_all(stack_trace, {S.lit(CALL)}, 2)) as b from crashes) t"
)
TRACE_ROWS = (
    f"select crash_id, session_id, {DANGEROUS} as vulnerability_type, 'medium' as severity, 0.5::double as confidence_score, 'stack_trace_analysis' as detection_method "
    f"from ({FRAMES}) fr where {DANGEROUS} is not null union all "
    f"select crash_id, session_id, 'null_pointer_dereference', 'medium', 0.8::double, 'stack_trace_analysis' from crashes where {S.rl('stack_trace', fx.NULL_ADDRESS)}"
)
MEMORY_ROWS = (
    "select crash_id, session_id, 'use_after_free' as vulnerability_type, 'high' as severity, 0.9::double as confidence_score, 'memory_analysis' as detection_method from crashes where heap_corruption union all "
    "select crash_id, session_id, 'buffer_overflow', 'high', 0.9::double, 'memory_analysis' from crashes where stack_overflow"
)
ALL_ROWS = f"{SIGNATURE_ROWS} union all {TRACE_ROWS} union all {MEMORY_ROWS}"
COLS = ["crash_id", "session_id", "vulnerability_type", "severity", "confidence_score", "detection_method"]


def part(spark, sf, method: str):
    return (
        fx.crash_findings(view(spark, sf, "crashes"), "crash_id", "session_id")
        .filter(F.col("detection_method") == method)
        .select(*COLS)
    )


@query("sc71_signature_findings", oracle("crashes", SIGNATURE_ROWS))
def _(spark, sf):
    return part(spark, sf, "crash_signature_analysis")


@query("sc72_stack_trace_findings", oracle("crashes", TRACE_ROWS))
def _(spark, sf):
    return part(spark, sf, "stack_trace_analysis")


@query("sc73_memory_findings", oracle("crashes", MEMORY_ROWS))
def _(spark, sf):
    return part(spark, sf, "memory_analysis")


@query(
    "jn6_dangerous_frames",
    oracle("crashes", f"select f as function_name, {DANGEROUS} as vulnerability_type, count(*) as frames from ({FRAMES}) t where {DANGEROUS} is not null group by f"),
)
def _(spark, sf):
    dangerous = rules.dim(spark, rules.DANGEROUS_FUNCTIONS, "function_name string, vulnerability_type string")
    frames = view(spark, sf, "crashes").select(F.explode(fx.frame_functions(F.col("stack_trace"))).alias("function_name"))
    return (
        frames.groupBy("function_name").agg(F.count("*").alias("frames")).join(F.broadcast(dangerous), "function_name")
    )


def risk_sql(source: str, keys: str) -> str:
    level = "case when s >= 7.5 then 'critical' when s >= 5.0 then 'high' when s >= 2.5 then 'medium' else 'low' end"
    exploitable = "count(case when vulnerability_type in ('buffer_overflow','command_injection','sql_injection') then 1 end)"
    kinds: dict[str, list[str]] = {}
    for kind, vector in rules.ATTACK_VECTORS:
        kinds.setdefault(vector, []).append(f"'{kind}'")
    vectors = ", ".join(
        f"case when bool_or(vulnerability_type in ({','.join(k)})) then '{v}' end" for v, k in sorted(kinds.items())
    )
    counts = ", ".join(f"count(case when severity = '{row[0]}' then 1 end) as {row[0]}_count" for row in rules.SEVERITIES)
    key_list = f"{keys}, " if keys else ""
    return (
        f"select {key_list}n as findings, round(s, 9) as risk_score, {level} as overall_risk, critical_count, high_count, medium_count, low_count, info_count, "
        "e as highly_exploitable_count, round(least(e * 0.3::double, 1.0::double), 9) as exploitability_score, array_to_string([x for x in v if x is not null], '|') as attack_vectors, "
        "impact as overall_business_impact, round(impact * 0.8::double, 9) as availability_impact from ("
        f"select {key_list}count(*) as n, avg({severity(2, kind='::double')}) as s, {counts}, {exploitable} as e, [{vectors}] as v, "
        f"max({severity(4, kind='::double')}) as impact from {source} {'group by ' + keys if keys else ''}) g"
    )


def flat_risk(df):
    out = df.withColumn("attack_vectors", T.joined(F.col("attack_vectors")))
    for name in ("risk_score", "exploitability_score", "availability_impact"):
        out = out.withColumn(name, F.round(name, 9))
    return out


@query("sc74_crash_analysis", oracle("crashes", risk_sql(f"({ALL_ROWS}) t", "crash_id")))
def _(spark, sf):
    return flat_risk(fx.risk(fx.crash_findings(view(spark, sf, "crashes"), "crash_id", "session_id"), "crash_id"))


# Every second crash comes with the source around it.
SOURCE = "case when crash_id % 2 = 0 then concat('int x;', chr(10), 'strcpy(b, a); // ', signature) end"
WITH_SOURCE = "crashes_s as (select *, " + SOURCE + " as source_code from crashes)"
SOURCE_ROWS = " union all ".join(
    f"select crash_id, session_id, '{kind}' as vulnerability_type, '{fx.known_severity(kind)}' as severity, 0.7::double as confidence_score, 'pattern_matching' as detection_method "
    f"from (select crash_id, session_id, unnest({S.rall('l[i]', pattern)}) as x from (select crash_id, session_id, l, unnest([1, 2]) as i from "
    "(select crash_id, session_id, string_split(source_code, chr(10)) as l from crashes_s) a) u) v"
    for kind, pattern in rules.SECURITY_RULES
)


def whole_analysis_sql() -> str:
    doubt = f"least(greatest(0.1::double * (1.0::double - confidence_score) * {factor('detection_method', rules.METHOD_FACTORS)} * {factor('vulnerability_type', rules.TYPE_FACTORS)}, 0.0::double), 1.0::double)"
    plan = PLAN.replace("KEYS", "crash_id,").replace("from findings", "from af")
    return (
        f"with {WITH_SOURCE}, af as ({ALL_ROWS} union all {SOURCE_ROWS}), {plan.strip().removeprefix('with ')}, "
        f"rk as ({risk_sql('af', 'crash_id')}), fp as (select crash_id, round(avg(d), 9) as false_positive_probability, count(case when d > 0.3 then 1 end) as to_verify from (select crash_id, {doubt} as d from af) z group by crash_id), "
        "pl as (select crash_id, string_agg(concat(priority, ':', vulnerability_type), '|' order by priority desc, vulnerability_type) as plan from p group by crash_id) "
        "select * from rk join fp using (crash_id) left join pl using (crash_id)"
    )


@query("ag8_risk_per_session", oracle("findings", risk_sql("findings", "session_id")))
def _(spark, sf):
    return flat_risk(fx.risk(found(spark, sf), "session_id"))


@query(
    "ag9_exploitability",
    oracle(
        "findings",
        "select session_id, e as highly_exploitable_count, round(least(e * 0.3::double, 1.0::double), 9) as exploitability_score from "
        "(select session_id, count(case when vulnerability_type in ('buffer_overflow','command_injection','sql_injection') then 1 end) as e from findings group by session_id) t",
    ),
)
def _(spark, sf):
    return flat_risk(fx.risk(found(spark, sf), "session_id")).select(
        "session_id", "highly_exploitable_count", "exploitability_score"
    )


VECTOR_VALUES = ", ".join(f"('{k}','{v}')" for k, v in rules.ATTACK_VECTORS)


@query(
    "ag10_attack_vectors",
    oracle(
        "findings",
        f"select session_id, string_agg(distinct v, '|' order by v) as attack_vectors from findings join (values {VECTOR_VALUES}) t(k, v) on k = vulnerability_type group by session_id",
    ),
)
def _(spark, sf):
    return flat_risk(fx.risk(found(spark, sf), "session_id")).select("session_id", "attack_vectors").filter("attack_vectors <> ''")


@query(
    "ag11_business_impact",
    oracle(
        "findings",
        f"select session_id, max({severity(4, kind='::double')}) as overall_business_impact, round(max({severity(4, kind='::double')}) * 0.8::double, 9) as availability_impact from findings group by session_id",
    ),
)
def _(spark, sf):
    return flat_risk(fx.risk(found(spark, sf), "session_id")).select("session_id", "overall_business_impact", "availability_impact")


# -- false positives -------------------------------------------------------------

PROBABILITY = (
    f"least(greatest(0.1::double * (1.0::double - confidence_score) * {factor('detection_method', rules.METHOD_FACTORS)} "
    f"* {factor('vulnerability_type', rules.TYPE_FACTORS)}, 0.0::double), 1.0::double)"
)
TRACED = (
    "with t as (select f.*, c.stack_trace from findings f left join (select concat('f', cast(crash_id as string)) as finding_id, stack_trace from crashes) c using (finding_id))"
)


def traced(spark, sf):
    crashes = view(spark, sf, "crashes").select(F.concat(F.lit("f"), F.col("crash_id").cast("string")).alias("finding_id"), "stack_trace")
    return found(spark, sf).join(crashes, "finding_id", "left")


@query(
    "sc34_false_positive_probability",
    oracle("findings crashes", TRACED + f" select finding_id, round({PROBABILITY}, 9) as probability from t"),
)
def _(spark, sf):
    return fx.false_positives(traced(spark, sf)).select("finding_id", F.round("probability", 9).alias("probability"))


@query(
    "sc35_false_positive_factors",
    oracle(
        "findings crashes",
        TRACED
        + """ select finding_id, array_to_string([x for x in [case when confidence_score < 0.5 then 'Low confidence score' end,
        case when detection_method = 'pattern_matching' then 'Pattern-based detection can have false positives' end,
        case when coalesce(stack_trace, '') = '' then 'No stack trace for verification' end,
        case when coalesce(code_snippet, '') = '' then 'No code snippet for manual review' end] if x is not null], '|') as factors from t""",
    ),
)
def _(spark, sf):
    return fx.false_positives(traced(spark, sf)).select("finding_id", T.joined(F.col("factors")).alias("factors"))


@query(
    "flt9_verification_needed",
    oracle(
        "findings crashes",
        TRACED + f" select vulnerability_type, detection_method, count(*) as findings, count(case when {PROBABILITY} > 0.3 then 1 end) as to_verify from t group by 1, 2",
    ),
)
def _(spark, sf):
    return fx.false_positives(traced(spark, sf)).groupBy("vulnerability_type", "detection_method").agg(
        F.count("*").alias("findings"), F.count_if("verification_needed").alias("to_verify")
    )


# -- lookups and plan ------------------------------------------------------------


def sql_list(values) -> str:
    return "[" + ", ".join(S.lit(v) for v in values) + "]"


KNOWN = ", ".join(f"('{k}','{c}',{S.lit(d)},{sql_list(ids)},{sql_list(r)})" for k, _, c, d, ids, r in rules.VULNERABILITIES)
KNOWN_CTE = f"known(vulnerability_type, cwe_id, description, cve_ids, remediation) as (values {KNOWN})"
VERIFY = "case vulnerability_type " + " ".join(f"when '{k}' then {sql_list(v)}" for k, v in rules.VERIFICATION) + f" else {sql_list([rules.DEFAULT_VERIFICATION])} end"
EFFORT = "case vulnerability_type " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.EFFORTS) + " else 'medium' end"


@query(
    "jn3_vulnerability_facts",
    oracle(
        "findings",
        f"with {KNOWN_CTE} select finding_id, vulnerability_type, cwe_id, description, array_to_string(cve_ids, '|') as cve_ids, cast(len(remediation) as int) as steps from findings join known using (vulnerability_type)",
    ),
)
def _(spark, sf):
    return fx.with_vulnerability_facts(found(spark, sf)).select(
        "finding_id", "vulnerability_type", "cwe_id", "description", T.joined(F.col("cve_ids")).alias("cve_ids"), F.size("remediation").alias("steps")
    )


@query(
    "jn4_defaults",
    oracle(
        "findings",
        f"select finding_id, {EFFORT} as effort, array_to_string({VERIFY}, '|') as verification_steps, {severity(6)} as immediate, {severity(7)} as complete, "
        f"{factor('detection_method', rules.METHOD_FACTORS)} as method_factor, {factor('vulnerability_type', rules.TYPE_FACTORS)} as type_factor from findings",
    ),
)
def _(spark, sf):
    return fx.with_defaults(found(spark, sf)).select(
        "finding_id",
        "effort",
        T.joined(F.col("verification_steps")).alias("verification_steps"),
        "immediate",
        "complete",
        rules.lookup(F.col("detection_method"), rules.METHOD_FACTORS, 1.0).alias("method_factor"),
        rules.lookup(F.col("vulnerability_type"), rules.TYPE_FACTORS, 1.0).alias("type_factor"),
    )


PLAN = (
    f"with {KNOWN_CTE}, g as (select KEYS vulnerability_type, count(*) as affected_count, arg_max(severity, {severity(1)}) as severity, avg(confidence_score) as c from findings group by KEYS vulnerability_type), "
    f"p as (select g.*, remediation, cast(least(floor({severity(3)} + least(affected_count * 0.5, 2.0) + c), 10) as int) as priority from g join known using (vulnerability_type))"
)
PLAN_COLUMNS = (
    f"vulnerability_type, affected_count, priority, {EFFORT} as estimated_effort, array_to_string(remediation[1:2], '|') as immediate_actions, "
    f"array_to_string(remediation[3:], '|') as long_term_solutions, array_to_string({VERIFY}, '|') as verification_steps, {severity(6)} as timeline_immediate, {severity(7)} as timeline_complete"
)


def flat_plan(df):
    for name in ("immediate_actions", "long_term_solutions", "verification_steps"):
        df = df.withColumn(name, T.joined(F.col(name)))
    return df


@query("ag12_remediation_plan", oracle("findings", PLAN.replace("KEYS", "session_id,") + f" select session_id, {PLAN_COLUMNS} from p"))
def _(spark, sf):
    return flat_plan(fx.remediation_plan(found(spark, sf), "session_id"))


@query("tk3_plan_by_priority", oracle("findings", PLAN.replace("KEYS", "") + f" select {PLAN_COLUMNS} from p order by priority desc, vulnerability_type"))
def _(spark, sf):
    return flat_plan(fx.remediation_plan(found(spark, sf)))


@query(
    "ag13_remediation_priority",
    oracle("findings", PLAN.replace("KEYS", "session_id,") + " select session_id, vulnerability_type, affected_count, priority from p"),
)
def _(spark, sf):
    return fx.remediation_plan(found(spark, sf), "session_id").select("session_id", "vulnerability_type", "affected_count", "priority")


@query(
    "ag14_effort_and_timeline",
    oracle(
        "findings",
        PLAN.replace("KEYS", "session_id,") + f" select session_id, vulnerability_type, {EFFORT} as estimated_effort, {severity(6)} as timeline_immediate, {severity(7)} as timeline_complete from p",
    ),
)
def _(spark, sf):
    return fx.remediation_plan(found(spark, sf), "session_id").select(
        "session_id", "vulnerability_type", "estimated_effort", "timeline_immediate", "timeline_complete"
    )


@query(
    "ud1_analyzer_runs",
    oracle(
        "interactions source_files crashes",
        "select 'HallucinationDetector' as analyzer_name, count(*) as analyses, count(case when prompt_text like '%a%' then 1 end) as failed from interactions union all "
        "select 'CodeQualityAnalyzer', count(*), 0 from source_files union all select 'VulnerabilityAnalyzer', count(*), 0 from crashes",
    ),
)
def _(spark, sf):
    from ..plans import analyzers

    # Prompts with an "a" are taken away, so that rows with a missing value are seen.
    prompt = F.when(~F.col("prompt_text").contains("a"), F.col("prompt_text"))
    results = analyzers.analyze_all(
        {
            analyzers.REPLIES: view(spark, sf, "interactions").withColumn("prompt_text", prompt),
            analyzers.SOURCES: view(spark, sf, "source_files"),
            analyzers.CRASHES: view(spark, sf, "crashes"),
        }
    )
    return analyzers.summary(results).drop("average_confidence")


@query("sc74_whole_crash_analysis", oracle("crashes", whole_analysis_sql()))
def _(spark, sf):
    crashes = view(spark, sf, "crashes").withColumn("source_code", F.expr(SOURCE.replace("chr(10)", "char(10)")))
    out = flat_risk(fx.crash_analysis(crashes, "crash_id")).withColumn("plan", T.joined(F.col("plan")))
    return out.withColumn("false_positive_probability", F.round("false_positive_probability", 9))
