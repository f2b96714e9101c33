"""Queries over log lines: line fields, tool parsers, crash traces, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import text as T
from ..operators import logs
from . import sql as S
from .registry import query

L = "raw_line"
LOW = "lower(raw_line)"
MODEL = S.has(LOW, *logs.MODEL_TERMS)
CRASH = S.rl(L, logs.CRASH)
VULN = S.rl(L, logs.VULNERABILITY)
KIND = f"case when {MODEL} then 'llm_interaction' when {VULN} then 'vulnerability' when {CRASH} then 'crash' else 'log_line' end"
MEM_U = f"lower({S.rx(L, logs.MEMORY, 2)})"
MEM_V = S.rnum(L, logs.MEMORY)
MEMORY_MB = (
    f"case {MEM_U} when 'gb' then {MEM_V} * 1024 when 'kb' then {MEM_V} / 1024 "
    f"when 'byte' then {MEM_V} / 1048576 when 'bytes' then {MEM_V} / 1048576 else {MEM_V} end"
)
DUR_U = f"lower({S.rx(L, logs.DURATION, 2)})"
DUR_V = S.rnum(L, logs.DURATION)
DURATION_MS = (
    f"case when {DUR_U} in ('s','sec','second','seconds') then {DUR_V} * 1000 "
    f"when {DUR_U} in ('minute','minutes') then {DUR_V} * 60000 else {DUR_V} end"
)
PHRASE = "case " + " ".join(f"when contains({LOW}, '{p}') then '{k}'" for p, k in logs.VULNERABILITY_PHRASES) + " end"
MODEL_NAME = "coalesce(" + ", ".join(S.rx(L, p) for p in logs.MODEL_NAMES) + ")"


def parsed(spark, sf, *cols):
    return logs.parse_lines(view(spark, sf, "log_lines")).select("file", "line_number", *cols)


def lines_oracle(cols: str, where: str = "true") -> str:
    return oracle("log_lines", f"select file, line_number, {cols} from log_lines where {where}")


@query(
    "sc1_timestamp_level_pid",
    lines_oracle(
        f"{S.rx(L, logs.TIMESTAMP, 1)} as logged_at, upper({S.rx(L, logs.LEVEL, 1)}) as level, "
        f"{S.rnum(L, logs.PROCESS_ID, 1, 'bigint')} as pid"
    ),
)
def _(spark, sf):
    return parsed(spark, sf, "logged_at", "level", "pid")


@query("sc2_memory_mb", lines_oracle(f"{MEMORY_MB} as memory_mb", f"{MEM_V} is not null"))
def _(spark, sf):
    return parsed(spark, sf, "memory_mb").filter("memory_mb is not null")


# Each of these lists has an order, and the first entry that holds decides.
@query(
    "wn9_first_match",
    lines_oracle(f"{KIND} as kind, {PHRASE} as phrase, {MODEL_NAME} as model", f"contains({LOW}, 'crash') or {MODEL_NAME} is not null"),
)
def _(spark, sf):
    line = F.col(L)
    rows = view(spark, sf, "log_lines").select(
        "file", "line_number", L, logs.line_kind(line).alias("kind"), logs.vulnerability_phrase(line).alias("phrase"), logs.model_name(line).alias("model")
    )
    return rows.filter(F.lower(line).contains("crash") | F.col("model").isNotNull()).drop(L)


@query(
    "sc3_cpu_and_coverage",
    lines_oracle(f"{S.rnum(L, logs.CPU)} as cpu_percent, {S.rnum(L, logs.COVERAGE)} as coverage_percent"),
)
def _(spark, sf):
    return parsed(spark, sf, "cpu_percent", "coverage_percent")


@query("sc4_execution_time_ms", lines_oracle(f"{DURATION_MS} as execution_time_ms", f"{DUR_V} is not null"))
def _(spark, sf):
    return parsed(spark, sf, "execution_time_ms").filter("execution_time_ms is not null")


@query("sc5_line_kind", lines_oracle(f"{KIND} as kind"))
def _(spark, sf):
    return parsed(spark, sf, "kind")


@query(
    "sc6_crash_signal_addresses",
    lines_oracle(
        f"{S.rx(L, logs.SIGNAL, 1)} as signal, array_to_string({S.rall(L, logs.ADDRESS)}, '|') as addresses", CRASH
    ),
)
def _(spark, sf):
    return parsed(spark, sf, "signal", T.joined(F.col("addresses")).alias("addresses"), "is_crash").filter("is_crash").drop("is_crash")


@query(
    "sc7_vulnerability_info",
    lines_oracle(f"upper({S.rx(L, logs.CVE)}) as cve_id, {PHRASE} as vulnerability_type", VULN),
)
def _(spark, sf):
    return parsed(spark, sf, "cve_id", "vulnerability_type", "is_vulnerability").filter("is_vulnerability").drop("is_vulnerability")


@query(
    "sc8_model_tokens_cost",
    lines_oracle(
        f"{MODEL_NAME} as model, {S.rnum(L, logs.TOKENS, 1, 'bigint')} as tokens, {S.rnum(L, logs.COST)} as cost", MODEL
    ),
)
def _(spark, sf):
    return parsed(spark, sf, "model", "tokens", "cost", "is_model").filter("is_model").drop("is_model")


STATISTICS = f"""
  count(*) as total_lines, count({DUR_V}) as execution_events,
  count(case when {CRASH} then 1 end) as crash_events, count(case when {MODEL} then 1 end) as model_events,
  count(case when {KIND} = 'vulnerability' then 1 end) as vulnerability_entries,
  max({MEMORY_MB}) as peak_memory_mb, max({S.rnum(L, logs.COVERAGE)}) as best_coverage
"""


@query("ag18_log_statistics", oracle("log_lines", f"select file, {STATISTICS} from log_lines group by file"))
def _(spark, sf):
    return logs.log_statistics(view(spark, sf, "log_lines"))


@query(
    "sc18_api_calls_and_crash_classes",
    oracle(
        "tool_lines",
        f"""select file, line_number,
        {S.ordered_case(logs.API_CALLS, lambda p: S.rl(L, p))} as provider,
        case when {S.rl(L, logs.API_CALLS[0][1])} then {S.rnum(L, logs.API_CALLS[0][1], 1, 'bigint')}
             when {S.rl(L, logs.API_CALLS[1][1])} then {S.rnum(L, logs.API_CALLS[1][1], 1, 'bigint')} end as tokens,
        {S.ordered_case(logs.CRASH_CLASSES, lambda p: S.rl(L, p))} as crash_class
        from tool_lines""",
    ),
)
def _(spark, sf):
    line = F.col("raw_line")
    return view(spark, sf, "tool_lines").select(
        "file", "line_number", logs.api_call(line).alias("c"), logs.crash_class(line).alias("crash_class")
    ).select("file", "line_number", "c.provider", "c.tokens", "crash_class")


@query(
    "sc19_tool_statistics",
    oracle(
        "tool_lines",
        " union all ".join(
            f"select file, line_number, '{name}' as statistic, regexp_extract(raw_line, {S.lit(p)}, 1) as captured "
            f"from tool_lines where {S.rl(L, p)}"
            for name, p in logs.TOOL_STATISTICS
        ),
    ),
)
def _(spark, sf):
    return logs.tool_statistics(view(spark, sf, "tool_lines"))


# -- tool parsers ----------------------------------------------------------------

FUZZ = r"^#(\d+)\s+INITED.*exec/s:\s*(\d+)"
HONG = r"Iterations:\s*(\d+).*Speed:\s*(\d+)"
TOOL_SQL = {
    "afl": [
        ("afl_startup", S.has(LOW, "american fuzzy lop"), {}),
        ("crash_found", S.has(LOW, "saved crash"), {}),
        ("hang_found", S.has(LOW, "saved hang"), {}),
    ],
    "libfuzzer": [
        ("execution_stats", S.rl(L, FUZZ), {"iterations": S.rnum(L, FUZZ, 1, "bigint"), "per_second": S.rnum(L, FUZZ, 2, "bigint")}),
        ("crash_found", S.has(LOW, "crash", "asan"), {}),
        ("leak_found", S.has(LOW, "leak"), {}),
    ],
    "honggfuzz": [
        ("execution_stats", S.rl(L, HONG), {"iterations": S.rnum(L, HONG, 1, "bigint"), "per_second": S.rnum(L, HONG, 2, "bigint")}),
        ("crash_found", S.has(LOW, "crash", "unique"), {}),
    ],
    "cifuzz": [
        ("fuzz_test_start", S.has(LOW, "running fuzz test"), {}),
        ("build_event", S.has(LOW, "building", "compiling"), {}),
        ("llm_interaction", S.has(LOW, "generating", "llm", "ai"), {}),
        ("finding", S.has(LOW, "finding", "vulnerability"), {}),
    ],
    "llm": [
        ("api_call", S.has(LOW, "openai", "anthropic"), {}),
        ("token_usage", f"{S.rx(L, logs.TOKENS, 1)} is not null", {"tokens": S.rnum(L, logs.TOKENS, 1, "bigint")}),
        ("cost_tracking", f"{S.rx(L, logs.COST, 1)} is not null", {"cost": S.rnum(L, logs.COST)}),
    ],
    "compilation": [
        ("compilation_error", S.has(LOW, "error:"), {}),
        ("compilation_warning", S.has(LOW, "warning:"), {}),
        ("compilation_success", S.has(LOW, "successfully compiled", "build successful"), {}),
    ],
    "coverage": [
        ("coverage_data", f"{S.rx(L, logs.COVERAGE, 1)} is not null", {"percent": S.rnum(L, logs.COVERAGE)}),
        ("line_coverage", f"{S.rx(L, logs.LINE_COVERAGE, 1)} is not null", {"percent": S.rnum(L, logs.LINE_COVERAGE)}),
        ("branch_coverage", f"{S.rx(L, logs.BRANCH_COVERAGE, 1)} is not null", {"percent": S.rnum(L, logs.BRANCH_COVERAGE)}),
    ],
}


def tool_sql(tool: str, source: str, with_tool: bool = False) -> str:
    parts = []
    for kind, condition, values in TOOL_SQL[tool]:
        cols = ", ".join(
            f"{values.get(name, 'cast(null as ' + sql_type + ')')} as {name}"
            for name, sql_type in logs._EVENT_FIELDS.items()
        )
        head = "tool, " if with_tool else ""
        tail = "" if with_tool else ", raw_line as message"
        where = f" and tool = '{tool}'" if with_tool else ""
        parts.append(f"select {head}file, line_number, '{kind}' as kind, {cols}{tail} from {source} where {condition}{where}")
    return " union all ".join(parts)


def tool_query(name: str, tool: str) -> None:
    @query(name, oracle("tool_lines", tool_sql(tool, "tool_lines")))
    def _(spark, sf):
        return logs.tool_events(view(spark, sf, "tool_lines"), tool)


tool_query("sc10_afl_events", "afl")
tool_query("sc11_libfuzzer_events", "libfuzzer")
tool_query("sc12_honggfuzz_events", "honggfuzz")
tool_query("sc13_test_runner_events", "cifuzz")
tool_query("sc14_model_call_events", "llm")
tool_query("sc15_compilation_events", "compilation")
tool_query("sc16_coverage_events", "coverage")

@query(
    "ag29_final_statistics",
    oracle(
        "tool_lines",
        rf"""with kv as (
          select file, line_number, replace(lower({S.strip("substr(l, 1, instr(l, ':') - 1)")}), ' ', '_') as key,
            {S.strip("substr(l, instr(l, ':') + 1)")} as value
          from (select file, line_number, {S.strip(L)} as l from tool_lines) t where instr(l, ':') > 0),
        last as (select file, key, arg_max(value, line_number) as value from kv group by file, key)
        select file, key, value,
          case when regexp_matches(value, '^\d+$') then try_cast(value as bigint) end as int_value,
          case when regexp_matches(value, '^\d+\.\d+$') then try_cast(value as double) end as double_value
        from last""",
    ),
)
def _(spark, sf):
    return logs.final_statistics(view(spark, sf, "tool_lines"))


# -- crash traces ----------------------------------------------------------------

STARTS = S.has("lower(l)", *logs.CRASH_START_TERMS)
TRACE = f"""with b as (
    select file, line_number, l, {STARTS} as starts,
      case when {STARTS} then line_number when l = '' then -1 end as marker
    from (select file, line_number, {S.strip(L)} as l from tool_lines) t),
  s as (select *, nullif(last_value(marker ignore nulls) over (partition by file order by line_number
      rows between unbounded preceding and 1 preceding), -1) as open_at from b),
  f as (select file, open_at as crash_line, line_number, l as frame from s
    where not starts and open_at is not null and (starts_with(l, '#') or contains(l, '0x')))"""
SIGNAL_SQL = (
    f"coalesce({S.rx('l', '(?i)SIG(\\w+)', 1)}, {S.rx('l', '(?i)signal\\s*(\\d+)', 1)}, "
    f"{S.rx('l', '(?i)segmentation fault')}, {S.rx('l', '(?i)abort')})"
)
CRASH_TRACES = oracle(
    "tool_lines",
    TRACE
    + f""", g as (select file, crash_line, count(*) as frames, arg_min(frame, line_number) as first_frame,
      arg_max(frame, line_number) as last_frame from f group by file, crash_line)
    select s.file, s.line_number as crash_line, {SIGNAL_SQL} as signal, l as message,
      coalesce(frames, 0) as frames, first_frame, last_frame
    from s left join g on g.file = s.file and g.crash_line = s.line_number where starts""",
)


@query("wn6_crash_traces", CRASH_TRACES)
def _(spark, sf):
    return logs.crash_traces(view(spark, sf, "tool_lines"))


@query("wn6_trace_frames", oracle("tool_lines", TRACE + " select file, crash_line, line_number, frame from f"))
def _(spark, sf):
    return logs.trace_frames(logs.trace_state(view(spark, sf, "tool_lines")))


@query(
    "sc17_sanitizer_reports",
    oracle(
        "tool_lines",
        TRACE
        + f""" select file, line_number, case when contains(lower(l), 'asan') then 'asan' else 'msan' end as sanitizer, l as message
        from s where not starts and {S.has('lower(l)', 'asan', 'msan')}
        and not (open_at is not null and (starts_with(l, '#') or contains(l, '0x') or l = ''))""",
    ),
)
def _(spark, sf):
    return logs.sanitizer_reports(view(spark, sf, "tool_lines"))


# -- all tools -------------------------------------------------------------------

TOOL_SQL["crash"] = [("crash_start", S.has(LOW, *logs.CRASH_START_TERMS), {})]
NO_VALUES = ", ".join(f"cast(null as {t}) as {n}" for n, t in logs._EVENT_FIELDS.items())
SANITIZED = (
    f"select 'crash' as tool, file, line_number, 'sanitizer_report' as kind, {NO_VALUES} from ("
    + TRACE.replace("from tool_lines", "from tool_lines where tool = 'crash'")
    + f""" select file, line_number from s where not starts and {S.has('lower(l)', 'asan', 'msan')}
      and not (open_at is not null and (starts_with(l, '#') or contains(l, '0x') or l = ''))) z"""
)
ALL_TOOLS = " union all ".join([*(tool_sql(tool, "tool_lines", True) for tool in TOOL_SQL), SANITIZED])


@query("ud4_tool_parser_registry", oracle("tool_lines", ALL_TOOLS))
def _(spark, sf):
    return logs.dispatch_tools(view(spark, sf, "tool_lines"))


@query(
    "flt4_handled_event_kinds",
    oracle(
        "tool_lines",
        f"with e as ({ALL_TOOLS}) select tool, kind, count(*) as events, count(distinct file) as files, max(percent) as best "
        "from e where kind in ('crash_found','crash_start','compilation_error','coverage_data','finding') group by tool, kind",
    ),
)
def _(spark, sf):
    events = logs.handled_events(logs.dispatch_tools(view(spark, sf, "tool_lines")))
    return events.groupBy("tool", "kind").agg(
        F.count("*").alias("events"), F.countDistinct("file").alias("files"), F.max("percent").alias("best")
    )


# -- tails -----------------------------------------------------------------------


@query(
    "tk6_last_lines",
    oracle(
        "log_lines",
        "select file, line_number, raw_line from (select *, row_number() over (partition by file order by line_number desc) as r "
        "from log_lines) t where r <= 50",
    ),
)
def _(spark, sf):
    return logs.tail(view(spark, sf, "log_lines").select("file", "line_number", "raw_line"), 50)


@query("tk5_sample_entries", lines_oracle(f"{KIND} as kind").replace(" where true", " where true order by file, line_number limit 10"))
def _(spark, sf):
    return logs.head(parsed(spark, sf, "kind"), 10)


@query(
    "tk7_latest_file",
    oracle("log_lines", "select arg_max(file, t) as file, max(t) as modified_micros from (select file, max(epoch_us(ts)) as t from log_lines group by file) f"),
)
def _(spark, sf):
    files = view(spark, sf, "log_lines").groupBy("file").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    return files.agg(F.max_by("file", "t").alias("file"), F.max("t").alias("modified_micros"))
