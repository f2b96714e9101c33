"""Queries that run the streaming jobs over the given tables and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..operators import findings as fx
from ..session import work_path
from ..sources.growing import ledger
from ..streaming import jobs
from ..streaming.io import append, stream_table, upsert
from . import sql as S
from .code import BASE, SECURITY
from .findings import CALL, DANGEROUS
from .interactions import HEALTH
from .logs import ALL_TOOLS, KIND, TRACE, lines_oracle
from .registry import query


def live(spark, sf, name: str, base: str = "events"):
    return view(spark, sf, name, {base: stream_table(spark, sf, base)})


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@query("st1_log_tail", lines_oracle(f"{KIND} as kind"))
def _(spark, sf):
    events = jobs.log_events(live(spark, sf, "log_lines")).select("file", "line_number", "kind")
    return append(events, "log-tail")


GROWN_LOGS, STEPS = 3, 3


def grow_logs(spark, sf, path: str, step: int) -> None:
    """Write the log files of ``path`` as they are at ``step``: each has more lines than before, but the first one begins anew at the last step."""
    rows = view(spark, sf, "log_lines").select((F.col("line_number") % GROWN_LOGS).cast("int").alias("part"), "line_number", "raw_line")
    fresh = (F.col("part") == 0) & F.lit(step == STEPS - 1)
    growth = F.floor(F.col("line_number") % 1000 * STEPS / 1000)  # a step's lines stand behind those of the one before
    there = F.when(fresh, F.col("line_number") % 7 == 0).otherwise(growth <= step)
    staged = work_path(spark, "staged")
    rows.filter(there).withColumn("growth", growth).repartition("part").sortWithinPartitions("part", "growth", "line_number").select(
        "part", "raw_line"
    ).write.partitionBy("part").text(staged)
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(of(path))
    for part in range(GROWN_LOGS):
        for found in system.globStatus(of(f"{staged}/part={part}/part-*")) or []:
            system.delete(of(path, f"p{part}.log"), False)
            system.rename(found.getPath(), of(path, f"p{part}.log"))


GROWN = f"""g as (select line_number % {GROWN_LOGS} as part, raw_line, line_number, length(raw_line) + 1 as bytes, {KIND} as kind, line_number % 1000 * {STEPS} // 1000 as growth from log_lines),
  e as (select * from g where case when part = 0 then line_number % 7 = 0 else true end),
  b as (select part, sum(bytes) as bytes from g where part > 0 or growth < {STEPS - 1} group by part union all select part, sum(bytes) from e where part = 0 group by part)"""


@query(
    "st1_growing_logs",
    oracle(
        "log_lines",
        f"""with {GROWN} select concat('p', cast(part as varchar), '.log') as name, kind, count(*) as events, cast((select sum(bytes) from b where b.part = e.part) as bigint) as bytes_read from e group by part, kind""",
    ),
)
def _(spark, sf):
    """Three passes over files that grow, one of them replaced at the end: events of the end state, and bytes read in all passes."""
    path, state, read = work_path(spark, "growing"), work_path(spark, "growing-state"), []
    for step in range(STEPS):
        grow_logs(spark, sf, path, step)
        events = jobs.growing_log_events(spark, path, state)
        read.append(ledger(spark, state).select("file", "bytes_read"))
    total = read[0].unionByName(read[1]).unionByName(read[2]).groupBy("file").agg(F.sum("bytes_read").alias("bytes_read"))
    name = F.regexp_extract("file", r"([^/]+)$", 1).alias("name")
    counted = events.groupBy("file", "kind").agg(F.count("*").alias("events"))
    return counted.join(total, "file").select(name, "kind", "events", "bytes_read")


@query("st2_resource_state", oracle(
    "metrics",
    "with o as (select *, row_number() over (partition by session_id order by ts desc, event_id desc) - 1 as age from metrics) "
    "select session_id, round(sum(cpu_percent * 0.1::double * pow(0.9::double, age)), 6) as average_cpu, max(cpu_percent) as peak_cpu, max(memory_mb) as peak_memory_mb from o group by session_id",
))
def _(spark, sf):
    state = jobs.resource_state(append(jobs.resource_samples(live(spark, sf, "metrics")), "resources"))
    return state.withColumn("average_cpu", F.round("average_cpu", 6))


# The counter restarts with the first request more than 60 s after the last restart.
RATES = """with recursive q as (select provider, epoch_us(ts) as t from provider_health),
 nx as (select provider, t, first_value(t) over (partition by provider order by t range between 60000001 following and unbounded following) as following from q),
 chain as (select provider, min(t) as reset from q group by provider
   union all select nx.provider, nx.following from chain c join nx on nx.provider = c.provider and nx.t = c.reset where nx.following is not null),
 r as (select provider, reset, lead(reset) over (partition by provider order by reset) as following from chain),
 n as (select r.provider, r.reset, count(*) as requests from r join q on q.provider = r.provider and q.t >= r.reset and (r.following is null or q.t < r.following) group by 1, 2)
 select provider, cast(arg_max(requests, reset) as bigint) as in_window, cast(sum(greatest(requests - 60, 0)) as bigint) as limited, count(*) as resets from n group by provider"""


@query("st3_rate_counters", oracle("provider_health", RATES).replace("with provider_health", "with recursive provider_health", 1).replace("recursive q as", "q as"))
def _(spark, sf):
    return jobs.rate_counters(append(jobs.rate_requests(live(spark, sf, "provider_health")), "rates"))


LIFECYCLE = """with e as (select concat('s', cast(user_id as varchar)) as session_id, ts, event_id, event_type, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
 g as (select *, sum(case when before is null or ts - before >= interval 6 hour then 1 else 0 end) over (partition by session_id order by ts, event_id) as run from e),
 r as (select session_id, run, min(ts) as started, max(ts) + interval 6 hour as ended, count(*) as events, last(event_type order by ts, event_id) as last_type from g group by 1, 2),
 c as (select max(ts) as clock from events)
 select session_id, strftime(started, '%Y-%m-%d %H:%M:%S') as started, strftime(ended, '%Y-%m-%d %H:%M:%S') as ended, events,
  case when ended > clock and events = 1 then 'initializing' when ended > clock then 'running' when ended + interval 1 hour > clock then 'analyzing'
    when last_type = 'error' then 'failed' when last_type = 'signup' then 'interrupted' else 'completed' end as status from r, c"""


@query("st4_session_lifecycle", LIFECYCLE)
def _(spark, sf):
    events = stream_table(spark, sf, "events").withColumn("session_id", F.concat(F.lit("s"), F.col("user_id").cast("string")))
    runs = jobs.session_lifecycle(events, "lifecycle")
    return runs.withColumn("started", stamp("started")).withColumn("ended", stamp("ended"))


@query(
    "st5_session_counters",
    oracle(
        "tool_lines",
        f"with e as ({ALL_TOOLS}) select file as session, count(case when kind in ('crash_found','crash_start') then 1 end) as unique_crashes, count(case when kind = 'compilation_error' then 1 end) as failed_compilations, "
        "count(case when kind = 'finding' then 1 end) as findings, max(case when kind = 'coverage_data' then percent end) as best_coverage from e "
        "where kind in ('crash_found','crash_start','compilation_error','coverage_data','finding') group by file",
    ),
)
def _(spark, sf):
    return upsert(jobs.session_counters(live(spark, sf, "tool_lines")), "counters", "session")


@query(
    "st6_reply_totals",
    oracle(
        "code_replies",
        "select session_id, count(*) as total_llm_interactions, cast(sum(length(prompt_text) // 4 + length(response_text) // 4) as bigint) as total_tokens_consumed from code_replies group by session_id",
    ),
)
def _(spark, sf):
    scored = append(jobs.scored_replies(live(spark, sf, "code_replies", "documents")), "replies")
    return jobs.reply_totals(scored).drop("detected")


@query(
    "st7_new_code_files",
    oracle(
        "source_files",
        f"with {BASE}, {SECURITY}, n as (select doc_id, count(*) as n from se group by doc_id) "
        "select distinct session_id, sha256(content) as source_hash, language, cyclomatic_complexity, coalesce(n, 0) as security_issues from m left join n using (doc_id)",
    ),
)
def _(spark, sf):
    # The arrival time of a text is its event time.
    arrived = live(spark, sf, "source_files", "documents").withColumn("arrived_at", F.current_timestamp())
    return append(jobs.new_code_files(arrived), "code-files").drop("issue_kinds")


SIGNED = " union all ".join(
    f"select file, line_number as crash_line, 'crash_signature_analysis' as detection_method, '{kind}' as vulnerability_type, '{fx.known_severity(kind)}' as severity from cr where {S.rl('l', p)}"
    for kind, p in rules.SIGNATURE_RULES
)
CRASH_LOG = (
    TRACE.replace("from tool_lines", "from tool_lines where tool = 'crash'")
    + ", cr as (select * from s where starts), fc as (select file, crash_line, case when a <> '' then a else b end as f from (select file, crash_line, "
    f"unnest(regexp_extract_all(frame, {S.lit(CALL)}, 1)) as a, unnest(regexp_extract_all(frame, {S.lit(CALL)}, 2)) as b from f) t) "
    f"{SIGNED} union all select file, line_number, 'memory_analysis', 'use_after_free', 'high' from cr where contains(lower(l), 'heap') "
    f"union all select file, crash_line, 'stack_trace_analysis', {DANGEROUS}, 'medium' from fc where {DANGEROUS} is not null "
    f"union all select distinct file, crash_line, 'stack_trace_analysis', 'null_pointer_dereference', 'medium' from f where {S.rl('frame', fx.NULL_ADDRESS)}"
)


@query("st8_crash_file_findings", oracle("tool_lines", CRASH_LOG))
def _(spark, sf):
    lines = live(spark, sf, "tool_lines").filter("tool = 'crash'").select("file", "line_number", "raw_line")
    found = jobs.crash_file_findings(append(jobs.crash_lines(lines), "crash-files"))
    return found.select("file", "crash_line", "detection_method", "vulnerability_type", "severity")


@query(
    "st9_minute_snapshots",
    oracle(
        "events",
        "select concat('s', cast(user_id as varchar)) as session_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, count(case when event_type = 'click' then 1 end) as drivers, "
        "count(case when event_type = 'error' then 1 end) as crashes, round(greatest(0.0::double, 1.0::double - max(value) / greatest(count(case when event_type = 'click' then 1 end), 1) / 1000), 9) as memory_efficiency, "
        "count(case when event_type = 'click' then 1 end) * 60.0::double as drivers_per_hour from events group by 1, 2",
    ),
)
def _(spark, sf):
    events = stream_table(spark, sf, "events").withColumn("session_id", F.concat(F.lit("s"), F.col("user_id").cast("string")))
    out = upsert(jobs.minute_snapshots(events), "minutes", "session_id", "minute")
    return out.withColumn("minute", stamp("minute")).withColumn("memory_efficiency", F.round("memory_efficiency", 9))


@query(
    "st10_sliding_day",
    oracle(
        "events",
        "select strftime(date_trunc('hour', ts) - i * interval 1 hour, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as events, count(case when event_type = 'click' then 1 end) as drivers, "
        "count(case when event_type = 'error' then 1 end) as vulnerabilities, max(value) as highest from events, range(24) r(i) group by 1",
    ),
)
def _(spark, sf):
    out = jobs.sliding_day(upsert(jobs.hour_panes(stream_table(spark, sf, "events")), "day", "hour"))
    return out.withColumn("from", stamp("from")).withColumnRenamed("from", "window_start")


@query(
    "st11_file_changes",
    oracle(
        "file_snapshots",
        "select * from (select coalesce(o.path, n.path) as path, case when o.path is null then 'created' when n.path is null then 'deleted' when o.mtime <> n.mtime then 'modified' end as change, o.mtime as old, n.mtime as new "
        "from (select * from file_snapshots where snap = 'prev') o full join (select * from file_snapshots where snap = 'cur') n on o.path = n.path) t where change is not null",
    ),
)
def _(spark, sf):
    number = F.when(F.col("snap") == "prev", 1).otherwise(2)
    listed = live(spark, sf, "file_snapshots", "part").withColumn("snapshot", number)
    manifest = view(spark, sf, "file_snapshots").groupBy(number.alias("snapshot")).agg(F.count("*").alias("files"))
    return jobs.file_changes(append(jobs.snapshot_rows(listed), "changes"), manifest).drop("snapshot")


@query(
    "st12_latest_health",
    oracle(
        "provider_health",
        HEALTH + " select provider, status, strftime(checked_at, '%Y-%m-%d %H:%M:%S') as checked_at, timestamp '2024-01-31' - checked_at > interval 300 second as is_stale from latest",
    ),
)
def _(spark, sf):
    latest = upsert(jobs.latest_health(live(spark, sf, "provider_health")), "health", "provider")
    return jobs.stale(latest, "2024-01-31 00:00:00").withColumn("checked_at", stamp("checked_at"))


@query(
    "st13_error_alerts",
    oracle(
        "provider_health",
        "select provider, strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as requests, count(case when status = 'unhealthy' then 1 end) as errors "
        "from provider_health group by 1, 2 having count(case when status = 'unhealthy' then 1 end) / cast(count(*) as double) > 0.1",
    ),
)
def _(spark, sf):
    out = upsert(jobs.error_alerts(live(spark, sf, "provider_health")), "alerts", "provider", "from")
    return out.filter("alert").withColumn("from", stamp("from")).withColumnRenamed("from", "window_start").drop("alert")
