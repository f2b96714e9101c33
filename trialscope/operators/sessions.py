"""Session roll-ups, efficiency, cost, trends and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.numbers import one_decimal, ratio
from ..functions.ordered import first_of_each, running_total, smoothed
from ..functions.statistics import p_value

HOUR_MS = 1000 * 3600


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def duration_ms(start: Column, end: Column, as_of: Column) -> Column:
    """Milliseconds from start to end, or to ``as_of`` while the session runs."""
    return (micros(F.coalesce(end, as_of)) - micros(start)) / 1000.0


def with_duration(sessions: DataFrame, as_of: str) -> DataFrame:
    """Add ``total_duration_ms``; a running session has no end yet."""
    end = F.when(F.col("status") != "running", F.col("end_time").cast("timestamp"))
    return sessions.withColumn(
        "total_duration_ms", duration_ms(F.col("start_time").cast("timestamp"), end, F.lit(as_of).cast("timestamp"))
    )


# -- counts ----------------------------------------------------------------------


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("session_id").agg(
        *[F.count_if(F.col("severity") == name).alias(f"{name}_vulnerabilities") for name in ("critical", "high", "medium", "low")]
    )


def child_counts(sessions: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Sessions with the number of rows each child table holds for them.

    Children fold to one row per session first, so the joins never fan out and a session
    with most of the rows costs no more than another.
    """
    out = sessions.select("session_id")
    for name, child in children.items():
        counted = child.groupBy("session_id").agg(F.count("*").alias(name))
        out = out.join(counted, "session_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def with_severity_counts(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    counts = severity_counts(findings)
    filled = {name: 0 for name in counts.columns if name != "session_id"}
    return sessions.join(counts, "session_id", "left").na.fill(filled)


# -- efficiency, throughput, cost ------------------------------------------------


def efficiency_columns() -> list[Column]:
    drivers, cpu = F.col("fuzz_drivers_generated"), F.col("average_cpu_usage")
    memory, sent, calls = F.col("peak_memory_usage_mb"), F.col("network_bytes_sent"), F.col("total_llm_interactions")
    cpu_part = F.when((cpu > 0) & (drivers > 0), F.least(drivers / (cpu / 100), F.lit(1.0))).otherwise(0.0)
    per_result = memory / F.greatest(drivers, F.lit(1))
    memory_part = F.when(memory > 0, F.greatest(F.lit(0.0), 1.0 - per_result / 1000)).otherwise(0.0)
    network_part = F.when(
        (sent > 0) & (calls > 0), F.greatest(F.lit(0.0), 1.0 - sent / calls / 100000)
    ).otherwise(0.0)
    return [
        cpu_part.alias("cpu_efficiency"),
        memory_part.alias("memory_efficiency"),
        network_part.alias("network_efficiency"),
        ((cpu_part + memory_part + network_part) / 3).alias("overall_efficiency"),
    ]


def throughput_columns() -> list[Column]:
    hours = F.col("total_duration_ms") / HOUR_MS
    return [
        ratio(F.col("fuzz_drivers_generated"), hours).alias("drivers_per_hour"),
        ratio(F.col("total_llm_interactions"), hours).alias("interactions_per_hour"),
        ratio(F.col("unique_crashes_found"), hours).alias("crashes_per_hour"),
        ratio(F.col("total_tokens_consumed"), hours * 60).alias("tokens_per_minute"),
    ]


def cost_columns() -> list[Column]:
    cost = F.col("estimated_cost_usd")
    return [
        ratio(cost, F.col("fuzz_drivers_generated")).alias("cost_per_driver"),
        ratio(cost, F.col("security_vulnerabilities_found")).alias("cost_per_vulnerability"),
        ratio(cost, F.col("total_tokens_consumed")).alias("cost_per_token"),
    ]


def roi_columns() -> list[Column]:
    value, cost = F.lit(0), F.col("estimated_cost_usd")
    for row in rules.SEVERITIES:
        if row[5]:
            value = value + F.col(f"{row[0]}_vulnerabilities") * row[5]
    return [
        value.cast("bigint").alias("estimated_value_usd"),
        (value - cost).alias("net_value_usd"),
        ((value - cost) / F.greatest(cost, F.lit(0.01))).alias("roi_ratio"),
        value.cast("bigint").alias("break_even_cost"),
    ]


def analyze(sessions: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    """Every per-session figure: one join with the folded findings, then projections."""
    base = with_duration(with_severity_counts(sessions, findings), as_of)
    figures = base.select("*", *efficiency_columns(), *throughput_columns(), *cost_columns(), *roi_columns())
    return scores(figures).withColumn("suggestions", suggestions())


def suggestions() -> Column:
    return T.present(
        (
            F.col("cpu_efficiency") < 0.5,
            "Low CPU efficiency detected. Consider parallel processing or algorithm optimization.",
        ),
        (
            F.col("memory_efficiency") < 0.5,
            "High memory usage detected. Consider memory optimization and garbage collection tuning.",
        ),
        (
            F.col("drivers_per_hour") < 10,
            "Low driver generation rate. Consider optimizing LLM prompts or increasing concurrency.",
        ),
        (
            F.col("cost_per_driver") > 1.0,
            "High cost per driver. Consider using more efficient models or optimizing token usage.",
        ),
        (F.col("roi_ratio") < 1.0, "Low ROI detected. Focus on finding higher-impact vulnerabilities or reducing costs."),
    )


def scores(analyzed: DataFrame) -> DataFrame:
    drivers = F.col("fuzz_drivers_generated")
    automation = F.when(drivers > 0, F.least(drivers / 10.0, F.lit(1.0))).otherwise(0.0)
    return (
        analyzed.withColumn("automation_score", automation)
        .withColumn("effectiveness_score", F.col("drivers_per_hour") / 20.0)
        .withColumn(
            "overall_score",
            (F.col("overall_efficiency") + F.col("automation_score") + F.col("effectiveness_score")) / 3.0,
        )
    )


def benchmark(sessions: DataFrame) -> DataFrame:
    """Sessions' figures next to the fixed targets, one row per (session, metric)."""
    hours, drivers = F.col("total_duration_ms") / HOUR_MS, F.greatest("fuzz_drivers_generated", F.lit(1))
    wide = sessions.select(
        "session_id",
        (F.col("fuzz_drivers_generated") / F.greatest(hours, F.lit(0.01))).alias("drivers_per_hour"),
        (F.col("estimated_cost_usd") / drivers).alias("cost_per_driver"),
        (F.col("security_vulnerabilities_found") / drivers).alias("vulnerability_find_rate"),
    )
    metrics = ["drivers_per_hour", "cost_per_driver", "vulnerability_find_rate"]
    tall = wide.unpivot("session_id", metrics, "metric", "session_value")
    targets = rules.dim(sessions.sparkSession, rules.BENCHMARKS, "metric string, benchmark_value double")
    return tall.join(F.broadcast(targets), "metric").select(
        "session_id",
        "metric",
        "session_value",
        "benchmark_value",
        (F.col("session_value") / F.col("benchmark_value")).alias("ratio"),
        F.when(F.col("session_value") > F.col("benchmark_value"), "above").otherwise("below").alias("performance"),
    )


# -- summaries -------------------------------------------------------------------


def summary(sessions: DataFrame) -> DataFrame:
    """Totals (``provider`` = ``ALL``) and sessions per provider, in one pass."""
    return (
        sessions.groupingSets([[], ["llm_provider"]], "llm_provider")
        .agg(
            F.grouping("llm_provider").alias("total"),
            F.count("*").alias("sessions"),
            (F.sum("total_duration_ms") / HOUR_MS).alias("duration_hours"),
            F.sum("fuzz_drivers_generated").alias("drivers"),
            F.sum("security_vulnerabilities_found").alias("vulnerabilities"),
            F.sum("estimated_cost_usd").alias("cost_usd"),
        )
        .withColumn("provider", F.when(F.col("total") == 1, "ALL").otherwise(F.col("llm_provider")))
        .drop("total", "llm_provider")
    )


def started_within(sessions: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return sessions.filter(F.col("start_time").cast("timestamp") > cutoff)


def daily_summary(analyzed: DataFrame) -> DataFrame:
    """One row: totals, mean score, and session counts per provider and language as maps.

    The groupings are made in one pass; the maps are built from their few folded rows.
    """
    grouped = analyzed.groupingSets([[], ["llm_provider"], ["primary_language"]], "llm_provider", "primary_language").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n"),
        F.sum("total_duration_ms").alias("ms"),
        F.sum("fuzz_drivers_generated").alias("drivers"),
        F.sum("security_vulnerabilities_found").alias("vulnerabilities"),
        F.sum("estimated_cost_usd").alias("cost"),
        F.avg("overall_score").alias("score"),
    )

    def total(name: str) -> Column:
        return F.max(F.when(F.col("level") == 3, F.col(name)))

    def counts(level: int, key: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct(key, "n")))))

    return grouped.agg(
        total("n").alias("sessions_analyzed"),
        (total("ms") / HOUR_MS).alias("total_duration_hours"),
        total("drivers").alias("total_drivers_generated"),
        total("vulnerabilities").alias("total_vulnerabilities_found"),
        total("cost").alias("total_cost_usd"),
        total("score").alias("average_quality_score"),
        counts(1, "llm_provider").alias("provider_usage"),
        counts(2, "primary_language").alias("language_distribution"),
    )


def breakdowns(sessions: DataFrame) -> DataFrame:
    """Several independent groupings in one pass."""
    return (
        sessions.groupingSets([[], ["llm_provider"], ["primary_language"]], "llm_provider", "primary_language")
        .agg(
            F.grouping_id().alias("level"),
            F.count("*").alias("sessions"),
            F.sum("fuzz_drivers_generated").alias("drivers"),
            F.sum("estimated_cost_usd").alias("cost_usd"),
        )
        .select(
            F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "provider").otherwise("language").alias("grouping"),
            F.coalesce("llm_provider", "primary_language", F.lit("ALL")).alias("value"),
            "sessions",
            "drivers",
            "cost_usd",
        )
    )


# -- trends and samples ----------------------------------------------------------


def trends(sessions: DataFrame, *keys: str, least_points: int = 3) -> DataFrame:
    """Slope, r squared, p-value and direction of three measures over start time."""
    seconds = micros(F.col("start_time")) / 1e6
    tall = (
        sessions.select(
            *keys,
            seconds.alias("x"),
            F.col("total_duration_ms").alias("duration"),
            F.col("fuzz_drivers_generated").cast("double").alias("drivers"),
            F.col("estimated_cost_usd").alias("costs"),
        ).unpivot([*keys, "x"], ["duration", "drivers", "costs"], "measure", "y")
    )
    fitted = (
        tall.groupBy(*keys, "measure")
        .agg(
            F.count("*").alias("points"),
            F.regr_slope("y", "x").alias("slope"),
            # A flat line explains nothing.
            F.when(F.var_pop("y") == 0, 0.0).otherwise(F.regr_r2("y", "x")).alias("r_squared"),
        )
        .filter(F.col("points") >= least_points)
    )
    return (
        fitted.withColumn("p_value", p_value(F.col("r_squared"), F.col("points")))
        .withColumn(
            "trend_direction",
            F.when(F.col("slope") < 0, "improving").when(F.col("slope") > 0, "degrading").otherwise("stable"),
        )
        .withColumn("significance", F.when(F.col("p_value") < 0.05, "significant").otherwise("not_significant"))
    )


def smoothed_cpu(metrics: DataFrame, weight: float = 0.1) -> DataFrame:
    """Exponentially weighted CPU use per session, newest sample weighted ``weight``."""
    return smoothed(metrics, ["session_id"], ["ts", "event_id"], "cpu_percent", 1.0 - weight, weight)


def smoothed_ratio(samples: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running half-and-half mean of a ratio."""
    return smoothed(samples, [key], order, value, 0.5, 0.5)


def recent_samples(samples: DataFrame, key: str, order: list[str], most: int = 1000) -> DataFrame:
    """The newest ``most`` samples of every metric."""
    return first_of_each(samples, [key], [F.desc(c) for c in order], most).drop("rank")


def sample_summary(samples: DataFrame, key: str, order: list[str], value: str = "value", most: int = 1000) -> DataFrame:
    return recent_samples(samples, key, order, most).groupBy(key).agg(
        F.avg(value).alias("average"), F.max(value).alias("highest"), F.min(value).alias("lowest"), F.count("*").alias("samples")
    )


def peaks(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("session_id").agg(
        F.max("cpu_percent").alias("peak_cpu"), F.max("memory_mb").alias("peak_memory_mb"), F.count("*").alias("samples")
    )


def admissions(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """Active sessions after every start or end, flagged beyond ``limit``."""
    starts = sessions.select(micros(F.col("start_time")).alias("moment"), F.lit(1).alias("change"))
    ends = sessions.filter("end_time is not null").select(micros(F.col("end_time")).alias("moment"), F.lit(-1).alias("change"))
    changes = starts.unionByName(ends).groupBy("moment").agg(F.sum("change").alias("change"))
    return running_total(changes, "moment", "change").select(
        "moment", "change", F.col("running").alias("active"), (F.col("running") > limit).alias("over_limit")
    )


# -- filters, checks, projections ------------------------------------------------

# What marks a process as a monitored run.
COMMAND_PATTERNS = [
    "cifuzz.*spark", "ci-fuzz.*spark", "cifuzz.*ai", "spark.*fuzz", "cifuzz.*llm", "fuzz.*ai", "llm.*fuzz", "intelligent.*fuzz",
]
PROCESS_NAMES = ["cifuzz", "spark", "ai-fuzz", "llm-fuzz"]


def monitored_processes(processes: DataFrame) -> DataFrame:
    command = F.col("cmdline").rlike("(?i)" + "|".join(COMMAND_PATTERNS))
    name = T.has(F.lower("name"), *PROCESS_NAMES)
    alive = (F.col("status") != "zombie") & (F.coalesce("cmdline", F.lit("")) != "")
    return processes.filter(alive & (command | name))


def not_yet_monitored(processes: DataFrame, sessions: DataFrame) -> DataFrame:
    return monitored_processes(processes).join(sessions.select("pid"), "pid", "left_anti")


def issues() -> Column:
    """Data-quality problems of a session row."""
    return T.present(
        (F.coalesce("session_id", F.lit("")) == "", "Missing session ID"),
        (F.col("pid") <= 0, "Invalid PID"),
        (F.col("start_time").isNull(), "Missing start time"),
        (F.col("total_tokens_consumed") < 0, "Negative token count"),
        (F.col("estimated_cost_usd") < 0, "Negative cost estimate"),
    )


def newest(sessions: DataFrame, count: int) -> DataFrame:
    return sessions.orderBy(F.desc("start_time"), "session_id").limit(count)


def panel(sessions: DataFrame) -> DataFrame:
    """Short display columns of a session."""
    return sessions.select(
        F.concat(F.substring("session_id", 1, 20), F.lit("...")).alias("session"),
        "status",
        F.format_string("%.1fm", F.col("total_duration_ms") / 60000).alias("duration"),
        F.col("fuzz_drivers_generated").cast("string").alias("drivers"),
        F.col("security_vulnerabilities_found").cast("string").alias("vulnerabilities"),
    )


def readable_bytes(size: Column) -> Column:
    """Size in the largest unit below 1024, one decimal."""
    out, value = F.lit(None), size.cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    for power in reversed(range(len(units))):
        text = F.concat(one_decimal(value / float(1024**power)), F.lit(f" {units[power]}"))
        out = text if power == len(units) - 1 else F.when(value < float(1024 ** (power + 1)), text).otherwise(out)
    return out


def report(analyzed: DataFrame) -> DataFrame:
    """One nested report per session."""

    def part(*names: str | tuple[str, str]) -> Column:
        return F.struct(*[F.col(n[1]).alias(n[0]) if isinstance(n, tuple) else F.col(n) for n in names])

    return analyzed.withColumn("duration_minutes", F.col("total_duration_ms") / 60000).select(
        "session_id",
        part("session_id", "duration_minutes", "status", ("language", "primary_language")).alias("session_summary"),
        part(
            ("provider", "llm_provider"), ("total_interactions", "total_llm_interactions"),
            ("total_tokens", "total_tokens_consumed"), "estimated_cost_usd",
        ).alias("usage"),
        part(
            ("drivers_generated", "fuzz_drivers_generated"), ("unique_crashes", "unique_crashes_found"),
            ("vulnerabilities_found", "security_vulnerabilities_found"),
        ).alias("fuzzing_results"),
        part(*[(name, f"{name}_vulnerabilities") for name in ("critical", "high", "medium", "low")]).alias("vulnerability_breakdown"),
        part(
            ("efficiency_score", "overall_efficiency"), "automation_score", "effectiveness_score", "overall_score",
            ("peak_memory_mb", "peak_memory_usage_mb"), ("average_cpu_percent", "average_cpu_usage"),
        ).alias("performance_metrics"),
        "suggestions",
    )
