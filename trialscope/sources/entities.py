"""Session documents and metric rows, in and out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .text import listing

SESSION_SCHEMA = (
    "session_id STRING, pid INT, start_time STRING, end_time STRING, llm_provider STRING, primary_language STRING, status STRING, "
    "fuzz_drivers_generated BIGINT, total_llm_interactions BIGINT, total_tokens_consumed BIGINT, security_vulnerabilities_found BIGINT, "
    "unique_crashes_found BIGINT, estimated_cost_usd DOUBLE, average_cpu_usage DOUBLE, peak_memory_usage_mb DOUBLE, network_bytes_sent BIGINT"
)
METRIC_SCHEMA = "timestamp STRING, metric_category STRING, metric_name STRING, value STRING, additional_data STRING"
# The known states and providers.
STATUSES = ["initializing", "running", "completed", "failed", "interrupted", "analyzing"]
PROVIDERS = ["openai", "anthropic", "ollama", "huggingface", "localai", "together", "cohere", "unknown"]
CODECS = ("none", "gzip", "lz4")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session JSON (plain or compressed) with ISO times parsed and unknown labels made ``unknown``."""
    rows = spark.read.schema(SESSION_SCHEMA).json(path)
    for name in ("start_time", "end_time"):
        rows = rows.withColumn(name, F.to_timestamp(name))
    provider, status = F.lower("llm_provider"), F.lower("status")
    return rows.withColumn("llm_provider", F.when(provider.isin(*PROVIDERS), provider).otherwise("unknown")).withColumn(
        "status", F.when(status.isin(*STATUSES), status).otherwise("initializing")
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric CSV files, one per session; the session id is in the file name."""
    rows = spark.read.schema(METRIC_SCHEMA).option("header", "true").option("recursiveFileLookup", "true").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"session_id=([^/]+)", 1)
    return rows.select(
        name.alias("session_id"),
        F.to_timestamp("timestamp").alias("ts"),
        "metric_category",
        "metric_name",
        "value",
        F.try_parse_json("additional_data").alias("additional_data"),
    )


# -- writing ---------------------------------------------------------------------


def codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name}; known: {', '.join(CODECS)}")
    return name


def append_entities(df: DataFrame, path: str) -> None:
    """Append versions of entities; ``latest`` picks the current one."""
    df.write.mode("append").parquet(path)


def latest(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version per key; versions fold on the map side, whatever their number."""
    picked = versions.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("row"))
    return picked.select("row.*")


def append_metrics(df: DataFrame, path: str, compression: str = "none") -> None:
    """Metric rows as CSV with header, one folder per day and category."""
    dated = df.withColumn("date", F.to_date("timestamp"))
    dated.write.mode("append").option("header", "true").option("compression", codec(compression)).partitionBy(
        "date", "metric_category"
    ).csv(path)


#: Sessions that one task writes files for, and rows of one file: what bounds a task of ``write_session_metrics``.
TASK_SESSIONS, FILE_ROWS = 200, 1_000_000


def write_session_metrics(df: DataFrame, path: str) -> None:
    """Metric CSV per session, the layout ``read_metrics`` expects.

    Rows meet by session before they are written, so that a session has one file for each ``FILE_ROWS`` rows, not one for each
    task that has rows of it, and there are as many tasks as files need, however the rows came.
    """
    sizes = written(df.groupBy("session_id").agg(F.count("*").alias("rows")), "session-sizes")
    sizes = sizes.withColumn("files", F.ceil(F.col("rows") / FILE_ROWS))
    facts = sizes.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("files").alias("most")).first()
    keys, columns = ["session_id"], df.columns
    if (facts["most"] or 0) > 1:
        large = sizes.filter("files > 1").select(F.col("session_id").alias("large_session"), "files")
        df = df.join(large, F.col("session_id").eqNullSafe(F.col("large_session")), "left")
        df = df.withColumn("file", F.coalesce(F.pmod(F.xxhash64(*columns), F.col("files")), F.lit(0))).drop("large_session", "files")
        keys.append("file")
    tasks = math.ceil(facts["sessions"] / TASK_SESSIONS + facts["rows"] / FILE_ROWS)
    dealt = df.repartition(max(1, tasks), *keys).drop("file")
    dealt.write.mode("append").option("header", "true").partitionBy("session_id").csv(path)


def export(sessions: DataFrame, children: dict[str, DataFrame], path: str, ids: DataFrame | None = None, compression: str = "gzip") -> DataFrame:
    """Write the chosen sessions and their related rows; return the row counts per kind.

    Related rows are matched on the whole id, and every kind is one partitioned write.
    """
    chosen = sessions if ids is None else sessions.join(ids, "session_id", "left_semi")
    counts = None
    for kind, rows in {"sessions": chosen, **children}.items():
        kept = rows if kind == "sessions" else rows.join(chosen.select("session_id"), "session_id", "left_semi")
        target = f"{path}/{kind}"
        kept.write.option("compression", codec(compression)).json(target)
        schema = kept.schema
        stored = kept.sparkSession.read.schema(schema).json(target).agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"))
        counts = stored if counts is None else counts.unionByName(stored)
    return counts


def archive(rows: DataFrame, ts: str, as_of: Column, days_old: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Move rows older than the cutoff to ``path/archive`` and the rest to ``path/live``.

    Returns (archived, live) as read back.
    """
    cutoff = as_of.cast("timestamp") - F.make_dt_interval(F.lit(days_old))
    old = F.col(ts).cast("timestamp") < cutoff
    tagged = rows.withColumn("part", F.when(old, "archive").otherwise("live"))
    tagged.write.partitionBy("part").parquet(path)
    stored = rows.sparkSession.read.parquet(path)
    return tuple(stored.filter(F.col("part") == part).drop("part") for part in ("archive", "live"))


def archive_days(spark: SparkSession, live: str, target: str, as_of: str, days_old: int) -> DataFrame:
    """Move the days before the cutoff of the table at ``live`` (partitioned by ``day``) to ``target``; live rows are not touched.

    Returns one row: ``files_archived``, ``bytes_saved``, ``errors`` (days whose files could not be removed). A day is
    removed only after its copy was written, and a repeated run overwrites the copy, so it may fail anywhere.
    """
    cutoff = F.to_date(F.lit(as_of)) - F.expr(f"interval {days_old} days")
    rows = spark.read.parquet(live).filter(F.col("day").cast("date") < cutoff)
    days = [r["day"] for r in rows.select(F.col("day").cast("string")).distinct().collect()]  # one per day
    old = listing(spark, live).withColumn("day", F.regexp_extract("file", r"/day=([^/]+)/", 1))
    old = old.filter(F.to_date("day") < cutoff).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    if days:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
    root = spark._jvm.org.apache.hadoop.fs.Path(live)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = [day for day in days if not system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{live}/day={day}"), True)]
    return spark.createDataFrame([(old["files"], old["bytes"], len(kept))], "files_archived long, bytes_saved long, errors long")


def surplus_backups(backups: DataFrame, keep: int = 5) -> DataFrame:
    """Backups beyond the newest ``keep`` of each base file.

    Only the newest ``keep`` are ranked (the ranks are cut before the shuffle); the oldest
    of them is the bound the others are compared with.
    """
    newest = Window.partitionBy("base").orderBy(F.desc("mtime"), F.desc("path"))
    kept = backups.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= keep)
    bound = kept.groupBy("base").agg(F.min(F.struct("mtime", "path")).alias("bound"))
    return backups.join(bound, "base").filter(F.struct("mtime", "path") < F.col("bound")).drop("bound")


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.json(path)
