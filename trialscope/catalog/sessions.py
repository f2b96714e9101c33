"""Queries over sessions, their samples and their processes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..functions import text as T
from ..operators import sessions as sx
from . import sql as S
from .registry import query

AS_OF = "2024-02-01 00:00:00"
DAY = "2024-01-02 00:00:00"
SUMS = "critical high medium low".split()
VALUE = " + ".join(f"{row[0]}_vulnerabilities * {row[5]}" for row in reversed(rules.SEVERITIES) if row[5])


def analyzed_ctes() -> str:
    counts = ", ".join(f"count(case when severity = '{n}' then 1 end) as {n}_vulnerabilities" for n in SUMS)
    filled = ", ".join(f"coalesce({n}_vulnerabilities, 0) as {n}_vulnerabilities" for n in SUMS)
    return f"""sv as (select session_id, {counts} from findings group by session_id),
    sd as (select s.*, {filled}, (epoch_us(case when status = 'running' then timestamp '{AS_OF}' else end_time end) - epoch_us(start_time)) / 1000.0::double as total_duration_ms
      from sessions s left join sv using (session_id)),
    se as (select *, total_duration_ms / 3600000 as hours,
      case when average_cpu_usage > 0 and fuzz_drivers_generated > 0 then least(fuzz_drivers_generated / (average_cpu_usage / 100), 1.0::double) else 0.0::double end as cpu_efficiency,
      case when peak_memory_usage_mb > 0 then greatest(0.0::double, 1.0::double - peak_memory_usage_mb / greatest(fuzz_drivers_generated, 1) / 1000) else 0.0::double end as memory_efficiency,
      case when network_bytes_sent > 0 and total_llm_interactions > 0 then greatest(0.0::double, 1.0::double - network_bytes_sent / cast(total_llm_interactions as double) / 100000) else 0.0::double end as network_efficiency from sd),
    sf as (select *, (cpu_efficiency + memory_efficiency + network_efficiency) / 3 as overall_efficiency,
      case when hours > 0 then fuzz_drivers_generated / hours else 0.0::double end as drivers_per_hour,
      case when hours > 0 then total_llm_interactions / hours else 0.0::double end as interactions_per_hour,
      case when hours > 0 then unique_crashes_found / hours else 0.0::double end as crashes_per_hour,
      case when hours > 0 then cast(total_tokens_consumed as double) / (hours * 60) else 0.0::double end as tokens_per_minute,
      case when fuzz_drivers_generated > 0 then estimated_cost_usd / fuzz_drivers_generated else 0.0::double end as cost_per_driver,
      case when security_vulnerabilities_found > 0 then estimated_cost_usd / security_vulnerabilities_found else 0.0::double end as cost_per_vulnerability,
      case when total_tokens_consumed > 0 then estimated_cost_usd / cast(total_tokens_consumed as double) else 0.0::double end as cost_per_token,
      {VALUE} as value_usd from se),
    sa as (select *, (value_usd - estimated_cost_usd) / greatest(estimated_cost_usd, 0.01::double) as roi_ratio,
      case when fuzz_drivers_generated > 0 then least(fuzz_drivers_generated / 10.0::double, 1.0::double) else 0.0::double end as automation_score,
      drivers_per_hour / 20.0::double as effectiveness_score from sf),
    sb as (select *, (overall_efficiency + automation_score + effectiveness_score) / 3.0::double as overall_score from sa)"""


def sql(select: str, ctes: str = "") -> str:
    return oracle("sessions findings", f"with {analyzed_ctes()}{', ' + ctes if ctes else ''} {select}")


def sessions(spark, sf):
    return view(spark, sf, "sessions")


def analyzed(spark, sf):
    return sx.analyze(sessions(spark, sf), view(spark, sf, "findings"), AS_OF)


def rounded(df, *names: str, digits: int = 6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def figures(name: str, *columns: str, plain: str = "") -> None:
    extra = [c.strip() for c in plain.split(",") if c.strip()]

    @query(name, sql(f"select session_id, {r(*columns)}{', ' + ', '.join(extra) if extra else ''} from sb"))
    def _(spark, sf):
        return rounded(analyzed(spark, sf).select("session_id", *columns, *extra), *columns)


figures("sc80_resource_efficiency", "cpu_efficiency", "memory_efficiency", "network_efficiency", "overall_efficiency")
figures("sc81_throughput", "drivers_per_hour", "interactions_per_hour", "crashes_per_hour", "tokens_per_minute")
figures("sc82_cost_efficiency", "cost_per_driver", "cost_per_vulnerability", "cost_per_token")
figures("sc86_scores", "automation_score", "effectiveness_score", "overall_score")
figures("sc87_duration", "total_duration_ms", plain="status")


@query(
    "sc83_return_on_investment",
    sql("select session_id, cast(value_usd as bigint) as estimated_value_usd, round(value_usd - estimated_cost_usd, 6) as net_value_usd, round(roi_ratio, 4) as roi_ratio, cast(value_usd as bigint) as break_even_cost from sb"),
)
def _(spark, sf):
    df = analyzed(spark, sf).select("session_id", "estimated_value_usd", "net_value_usd", "roi_ratio", "break_even_cost")
    return rounded(rounded(df, "net_value_usd"), "roi_ratio", digits=4)


@query(
    "sc84_suggestions",
    sql(
        """select session_id, array_to_string([x for x in [
        case when cpu_efficiency < 0.5 then 'Low CPU efficiency detected. Consider parallel processing or algorithm optimization.' end,
        case when memory_efficiency < 0.5 then 'High memory usage detected. Consider memory optimization and garbage collection tuning.' end,
        case when drivers_per_hour < 10 then 'Low driver generation rate. Consider optimizing LLM prompts or increasing concurrency.' end,
        case when cost_per_driver > 1.0 then 'High cost per driver. Consider using more efficient models or optimizing token usage.' end,
        case when roi_ratio < 1.0 then 'Low ROI detected. Focus on finding higher-impact vulnerabilities or reducing costs.' end] if x is not null], '|') as suggestions from sb"""
    ),
)
def _(spark, sf):
    return analyzed(spark, sf).select("session_id", T.joined(F.col("suggestions")).alias("suggestions"))


BENCH = """bm as (select session_id, fuzz_drivers_generated / greatest(hours, 0.01::double) as a, estimated_cost_usd / greatest(fuzz_drivers_generated, 1) as b,
   security_vulnerabilities_found / cast(greatest(fuzz_drivers_generated, 1) as double) as c from sb),
   bt as (select session_id, 'drivers_per_hour' as metric, a as v, 20.0::double as t from bm union all select session_id, 'cost_per_driver', b, 0.5 from bm union all select session_id, 'vulnerability_find_rate', c, 0.1 from bm)"""


@query(
    "jn9_sc85_benchmark_comparison",
    sql("select session_id, metric, round(v, 6) as session_value, t as benchmark_value, round(v / t, 6) as ratio, case when v > t then 'above' else 'below' end as performance from bt", BENCH),
)
def _(spark, sf):
    return rounded(sx.benchmark(sx.with_duration(sessions(spark, sf), AS_OF)), "session_value", "ratio")


COUNTS = ", ".join(f"count(case when severity = '{n}' then 1 end) as {n}_vulnerabilities" for n in SUMS)


@query("ag3_severity_counts", oracle("findings", f"select session_id, {COUNTS} from findings group by session_id"))
def _(spark, sf):
    return sx.severity_counts(view(spark, sf, "findings"))


def child_sql(*tables: str) -> str:
    joins = " ".join(f"left join (select session_id, count(*) as n_{t} from {t} group by session_id) {t} using (session_id)" for t in tables)
    cols = ", ".join(f"coalesce(n_{t}, 0) as {t}" for t in tables)
    return oracle("sessions " + " ".join(tables), f"select session_id, {cols} from sessions {joins}")


@query("ag2_driver_and_finding_counts", child_sql("source_files", "findings"))
def _(spark, sf):
    return sx.child_counts(sessions(spark, sf), {n: view(spark, sf, n) for n in ("source_files", "findings")})


@query("jn1_session_children", child_sql("interactions", "source_files", "findings", "crashes"))
def _(spark, sf):
    names = ("interactions", "source_files", "findings", "crashes")
    return sx.child_counts(sessions(spark, sf), {n: view(spark, sf, n) for n in names})


@query(
    "ag4_summary_report",
    sql(
        "select coalesce(llm_provider, 'ALL') as provider, count(*) as sessions, round(sum(total_duration_ms) / 3600000, 4) as duration_hours, cast(sum(fuzz_drivers_generated) as bigint) as drivers, "
        "cast(sum(security_vulnerabilities_found) as bigint) as vulnerabilities, round(sum(estimated_cost_usd), 4) as cost_usd from sb group by rollup(llm_provider)"
    ),
)
def _(spark, sf):
    return rounded(sx.summary(sx.with_duration(sessions(spark, sf), AS_OF)), "duration_hours", "cost_usd", digits=4)


def counts_sql(column: str) -> str:
    return f"(select string_agg(concat({column}, '=', cast(n as varchar)), '|' order by {column}) from (select {column}, count(*) as n from dy group by {column}) t)"


@query(
    "ag5_daily_summary",
    sql(
        "select count(*) as sessions_analyzed, round(sum(total_duration_ms) / 3600000, 4) as total_duration_hours, cast(sum(fuzz_drivers_generated) as bigint) as total_drivers_generated, "
        "cast(sum(security_vulnerabilities_found) as bigint) as total_vulnerabilities_found, round(sum(estimated_cost_usd), 4) as total_cost_usd, round(avg(overall_score), 6) as average_quality_score, "
        f"{counts_sql('llm_provider')} as provider_usage, {counts_sql('primary_language')} as language_distribution from dy",
        f"dy as (select * from sb where start_time > timestamp '{DAY}' - interval 24 hour)",
    ),
)
def _(spark, sf):
    out = sx.daily_summary(sx.started_within(analyzed(spark, sf), DAY))
    for name in ("provider_usage", "language_distribution"):
        pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        out = out.withColumn(name, T.joined(pairs))
    return rounded(rounded(out, "total_duration_hours", "total_cost_usd", digits=4), "average_quality_score")


@query(
    "ag6_breakdowns",
    oracle(
        "sessions",
        "select case when grouping(llm_provider) = 1 and grouping(primary_language) = 1 then 'total' when grouping(llm_provider) = 0 then 'provider' else 'language' end as grouping, "
        "coalesce(llm_provider, primary_language, 'ALL') as value, count(*) as sessions, cast(sum(fuzz_drivers_generated) as bigint) as drivers, round(sum(estimated_cost_usd), 4) as cost_usd "
        "from sessions group by grouping sets ((), (llm_provider), (primary_language))",
    ),
)
def _(spark, sf):
    return rounded(sx.breakdowns(sessions(spark, sf)), "cost_usd", digits=4)


TREND_ROWS = """tr as (select llm_provider, primary_language, epoch_us(start_time) / 1e6 as x, total_duration_ms as duration, cast(fuzz_drivers_generated as double) as drivers, estimated_cost_usd as costs from sb),
 ty as (select llm_provider, primary_language, x, 'duration' as measure, duration as y from tr union all select llm_provider, primary_language, x, 'drivers', drivers from tr union all select llm_provider, primary_language, x, 'costs', costs from tr),
 tf as (select llm_provider, primary_language, measure, count(*) as points, regr_slope(y, x) as slope, case when var_pop(y) = 0 then 0.0 else regr_r2(y, x) end as r2 from ty group by all having count(*) >= 3)"""


def trend_rows(spark, sf):
    return sx.trends(sx.with_duration(sessions(spark, sf), AS_OF), "llm_provider", "primary_language")


@query(
    "wn4_trends",
    sql(
        "select llm_provider, primary_language, measure, points, round(slope, 7) as slope, round(r2, 7) as r_squared, case when slope < 0 then 'improving' when slope > 0 then 'degrading' else 'stable' end as trend_direction from tf",
        TREND_ROWS,
    ),
)
def _(spark, sf):
    return rounded(trend_rows(spark, sf).drop("p_value", "significance"), "slope", "r_squared", digits=7)


# Student's distribution in closed form: a finite sum for each whole number of degrees of freedom.
SIGNIFICANCE = (
    TREND_ROWS
    + """,
 tv as (select *, points - 2 as v, greatest(1 - r2, 0) as x from tf),
 tp as (select *, case when v % 2 = 0
    then 1 - sqrt(r2) * list_sum(list_transform(range(v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(x, j)))
    else 1 - 2 / pi() * (asin(least(sqrt(r2), 1)) + sqrt(r2) * sqrt(x) * coalesce(list_sum(list_transform(range((v - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(x, j))), 0)) end as p from tv)"""
)


@query(
    "wn4_trend_significance",
    sql("select llm_provider, primary_language, measure, points, round(p, 9) as p_value, case when p < 0.05 then 'significant' else 'not_significant' end as significance from tp", SIGNIFICANCE),
)
def _(spark, sf):
    return trend_rows(spark, sf).select(
        "llm_provider", "primary_language", "measure", "points", F.round("p_value", 9).alias("p_value"), "significance"
    )


# -- samples ---------------------------------------------------------------------


def ewma_sql(keep: float, add: float, value: str) -> str:
    return oracle(
        "metrics",
        f"with o as (select session_id, {value} as v, row_number() over (partition by session_id order by ts desc, event_id desc) - 1 as age from metrics) "
        f"select session_id, round(sum(v * {add}::double * pow({keep}::double, age)), 6) as smoothed from o group by session_id",
    )


@query("wn1_smoothed_cpu", ewma_sql(0.9, 0.1, "cpu_percent"))
def _(spark, sf):
    return rounded(sx.smoothed_cpu(view(spark, sf, "metrics")), "smoothed")


@query("wn1_smoothed_cpu_slow", ewma_sql(0.95, 0.05, "cpu_percent"))
def _(spark, sf):
    return rounded(sx.smoothed_cpu(view(spark, sf, "metrics"), 0.05), "smoothed")


@query("wn2_smoothed_ratio", ewma_sql(0.5, 0.5, "memory_mb / 100"))
def _(spark, sf):
    samples = view(spark, sf, "metrics").withColumn("ratio", F.col("memory_mb") / 100)
    return rounded(sx.smoothed_ratio(samples, "session_id", ["ts", "event_id"], "ratio"), "smoothed")


TALL = (
    "with t as (select 'cpu_percent' as metric, cpu_percent as value, ts, event_id from metrics union all select 'memory_mb', memory_mb, ts, event_id from metrics), "
    "k as (select * from (select *, row_number() over (partition by metric order by ts desc, event_id desc) as rn from t) r where rn <= 1000)"
)


def tall(spark, sf):
    return view(spark, sf, "metrics").unpivot(["ts", "event_id"], ["cpu_percent", "memory_mb"], "metric", "value")


@query("wn3_recent_samples", oracle("metrics", TALL + " select metric, event_id, value from k"))
def _(spark, sf):
    return sx.recent_samples(tall(spark, sf), "metric", ["ts", "event_id"]).select("metric", "event_id", "value")


@query(
    "ag17_sample_summary",
    oracle("metrics", TALL + " select metric, round(avg(value), 6) as average, max(value) as highest, min(value) as lowest, count(*) as samples from k group by metric"),
)
def _(spark, sf):
    return rounded(sx.sample_summary(tall(spark, sf), "metric", ["ts", "event_id"]), "average")


@query(
    "ag32_peaks",
    oracle("metrics", "select session_id, max(cpu_percent) as peak_cpu, max(memory_mb) as peak_memory_mb, count(*) as samples from metrics group by session_id"),
)
def _(spark, sf):
    return sx.peaks(view(spark, sf, "metrics"))


@query(
    "st14_admissions",
    oracle(
        "sessions",
        "with c as (select epoch_us(start_time) as moment, 1 as d from sessions union all select epoch_us(end_time), -1 from sessions where end_time is not null), "
        "f as (select moment, cast(sum(d) as bigint) as change from c group by moment) select moment, change, cast(sum(change) over (order by moment) as bigint) as active, sum(change) over (order by moment) > 10 as over_limit from f",
    ),
)
def _(spark, sf):
    return sx.admissions(sessions(spark, sf))


# -- filters, checks, projections ------------------------------------------------

MONITORED = (
    "status <> 'zombie' and coalesce(cmdline, '') <> '' and ("
    + S.rl("cmdline", "(?i)" + "|".join(sx.COMMAND_PATTERNS))
    + " or "
    + S.has("lower(name)", *sx.PROCESS_NAMES)
    + ")"
)


@query("flt1_monitored_processes", oracle("proc_snapshot", f"select pid, name, cmdline from proc_snapshot where {MONITORED}"))
def _(spark, sf):
    return sx.monitored_processes(view(spark, sf, "proc_snapshot")).select("pid", "name", "cmdline")


@query(
    "jn7_not_yet_monitored",
    oracle("proc_snapshot sessions", f"select pid, cmdline from proc_snapshot where {MONITORED} and pid not in (select pid from sessions)"),
)
def _(spark, sf):
    return sx.not_yet_monitored(view(spark, sf, "proc_snapshot"), sessions(spark, sf)).select("pid", "cmdline")


@query("flt2_sessions_by_status", oracle("sessions", "select session_id, status, llm_provider from sessions where status = 'completed'"))
def _(spark, sf):
    return sessions(spark, sf).filter(F.col("status") == "completed").select("session_id", "status", "llm_provider")


@query(
    "flt3_last_day",
    oracle("sessions", f"select session_id, pid from sessions where start_time > timestamp '{DAY}' - interval 24 hour"),
)
def _(spark, sf):
    return sx.started_within(sessions(spark, sf), DAY).select("session_id", "pid")


BROKEN = (
    "b as (select case when pid % 7 = 0 then '' else session_id end as session_id, pid, case when pid % 5 = 0 then -pid else pid end as p, "
    "case when pid % 11 = 0 then null else start_time end as start_time, case when pid % 3 = 0 then -1 else total_tokens_consumed end as t, case when pid % 13 = 0 then -0.5 else estimated_cost_usd end as c from sessions)"
)


@query(
    "flt8_session_issues",
    oracle(
        "sessions",
        f"""with {BROKEN} select pid, array_to_string([x for x in [case when coalesce(session_id, '') = '' then 'Missing session ID' end, case when p <= 0 then 'Invalid PID' end,
        case when start_time is null then 'Missing start time' end, case when t < 0 then 'Negative token count' end, case when c < 0 then 'Negative cost estimate' end] if x is not null], '|') as issues from b""",
    ),
)
def _(spark, sf):
    pid = F.col("original_pid")
    broken = (
        sessions(spark, sf)
        .withColumn("original_pid", F.col("pid"))
        .withColumn("session_id", F.when(pid % 7 == 0, "").otherwise(F.col("session_id")))
        .withColumn("start_time", F.when(pid % 11 != 0, F.col("start_time")))
        .withColumn("total_tokens_consumed", F.when(pid % 3 == 0, -1).otherwise(F.col("total_tokens_consumed")))
        .withColumn("estimated_cost_usd", F.when(pid % 13 == 0, -0.5).otherwise(F.col("estimated_cost_usd")))
        .withColumn("pid", F.when(pid % 5 == 0, -pid).otherwise(pid))
    )
    return broken.select(pid.alias("pid"), T.joined(sx.issues()).alias("issues"))


PANEL = (
    "concat(substr(session_id, 1, 20), '...') as session, status, concat(format('{:.1f}', total_duration_ms / 60000), 'm') as duration, "
    "cast(fuzz_drivers_generated as varchar) as drivers, cast(security_vulnerabilities_found as varchar) as vulnerabilities"
)


@query("prj2_session_panel", sql(f"select {PANEL} from sb"))
def _(spark, sf):
    return sx.panel(sx.with_duration(sessions(spark, sf), AS_OF))


def newest_query(name: str, count: int) -> None:
    @query(name, sql(f"select session_id, status, round(total_duration_ms, 3) as total_duration_ms from sb order by start_time desc, session_id limit {count}"))
    def _(spark, sf):
        df = sx.newest(sx.with_duration(sessions(spark, sf), AS_OF), count)
        return rounded(df.select("session_id", "status", "total_duration_ms"), "total_duration_ms", digits=3)


newest_query("tk1_newest_sessions", 20)
newest_query("tk2_recent_panel", 5)


@query(
    "prj1_session_report",
    sql(
        "select session_id, round(total_duration_ms / 60000, 6) as duration_minutes, status, primary_language as language, llm_provider as provider, cast(total_tokens_consumed as bigint) as total_tokens, "
        "fuzz_drivers_generated as drivers_generated, critical_vulnerabilities as critical, low_vulnerabilities as low, round(overall_score, 6) as overall_score from sb"
    ),
)
def _(spark, sf):
    nested = sx.report(analyzed(spark, sf))
    return nested.select(
        "session_id",
        F.round("session_summary.duration_minutes", 6).alias("duration_minutes"),
        "session_summary.status",
        "session_summary.language",
        "usage.provider",
        "usage.total_tokens",
        "fuzzing_results.drivers_generated",
        "vulnerability_breakdown.critical",
        "vulnerability_breakdown.low",
        F.round("performance_metrics.overall_score", 6).alias("overall_score"),
    )


UNITS = "".join(
    f"when v < {1024 ** (i + 1)} then concat(format('{{:.1f}}', v / {1024 ** i}::double), ' {u}') " for i, u in enumerate(["B", "KB", "MB", "GB"])
)


@query(
    "prj3_readable_bytes",
    oracle(
        "sessions",
        f"select session_id, case {UNITS} else concat(format('{{:.1f}}', v / {1024 ** 4}::double), ' TB') end as size from (select session_id, cast(network_bytes_sent as double) * pow(10, pid % 9) as v from sessions) t",
    ),
)
def _(spark, sf):
    size = F.col("network_bytes_sent").cast("double") * F.pow(F.lit(10), F.col("pid") % 9)
    return sessions(spark, sf).select("session_id", sx.readable_bytes(size).alias("size"))


@query(
    "ag30_historical_summary",
    oracle(
        "interactions findings log_lines",
        r"""select 'provider' as section, llm_provider as value, count(*) as n from interactions group by 2 union all
        select 'model', llm_model, count(*) from interactions group by 2 union all
        select 'vulnerability', vulnerability_type, count(*) from findings group by 2 union all
        select * from (select 'error' as section, regexp_extract(raw_line, 'pid: \d+ (.*)$', 1) as value, count(*) as n from log_lines where contains(raw_line, ' ERROR ') group by 2 order by n desc, value limit 10) e""",
    ),
)
def _(spark, sf):
    from ..plans.history import historical_summary

    return historical_summary(view(spark, sf, "interactions"), view(spark, sf, "findings"), view(spark, sf, "log_lines"))
