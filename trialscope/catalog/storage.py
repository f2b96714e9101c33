"""Queries over readers and writers: parsed formats, and round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import text as T
from ..plans import log_analysis
from ..session import work_path
from ..sources import entities, structured, text
from . import sql as S
from .registry import query

SHARD_LINES = 1000


def mixed(spark, sf):
    return view(spark, sf, "mixed_lines").select("file", "line_number", "raw_line")


def only(spark, sf, prefix: str):
    return mixed(spark, sf).filter(F.col("file").startswith(prefix))


# -- formats ---------------------------------------------------------------------

FORMAT = "case regexp_extract(file, '^[a-z]+') when 'json' then 'json' when 'table' then 'csv' when 'fuzz' then 'libfuzzer' else 'text' end"
JSON = "j as (select *, raw_line = '{broken' as is_bad, contains(raw_line, '\"exec\"') as ex, contains(lower(raw_line), 'crash') as cr, contains(raw_line, '\"model\"') as mo from mixed_lines where starts_with(file, 'json'))"
TIME = r"""nullif(regexp_extract(raw_line, '"time(?:stamp)?":"([^"]*)"', 1), '')"""
LEVEL = r"""nullif(regexp_extract(raw_line, '"(?:level|severity)":"([^"]*)"', 1), '')"""
MESSAGE = r"""nullif(regexp_extract(raw_line, '"(?:message|msg)":"([^"]*)"', 1), '')"""
KIND = "case when ex then 'execution' when cr then 'crash' when mo then 'llm_interaction' end"


@query("src2_detect_format", oracle("mixed_lines", f"select distinct file, {FORMAT} as format from mixed_lines"))
def _(spark, sf):
    return text.detect_formats(mixed(spark, sf))


@query("src3_json_lines", oracle("mixed_lines", f"with {JSON} select file, count(*) as entries, count(case when is_bad then 1 end) as errors from j group by file"))
def _(spark, sf):
    return structured.json_lines(only(spark, sf, "json")).groupBy("file").agg(
        F.count("*").alias("entries"), F.count_if("is_bad").alias("errors")
    )


@query("src5_json_entries", oracle("mixed_lines", f"with {JSON} select file, line_number, {TIME} as logged_at, {LEVEL} as level, {MESSAGE} as message, {KIND} as kind from j"))
def _(spark, sf):
    return structured.json_lines(only(spark, sf, "json")).select("file", "line_number", "logged_at", "level", "message", "kind")


@query(
    "sc9_json_entry_fields",
    oracle(
        "mixed_lines",
        rf"""with {JSON} select file, line_number, case when mo then nullif(regexp_extract(raw_line, '"model":"([^"]*)"', 1), '') end as model,
        case when mo then nullif(regexp_extract(raw_line, '"tokens":(\d+)', 1), '') end as tokens, case when cr then nullif(regexp_extract(raw_line, '"signal":"([^"]*)"', 1), '') end as signal from j where mo or cr""",
    ),
)
def _(spark, sf):
    rows = structured.json_lines(only(spark, sf, "json")).filter("model_data is not null or crash_data is not null")
    return rows.select("file", "line_number", "model_data.model", "model_data.tokens", "crash_data.signal")


@query(
    "src4_json_documents",
    oracle(
        "events",
        "select concat('d', cast(event_id as varchar)) as file, cast(i as int) as entry, case when i = 0 then event_type else cast(user_id as varchar) end as message from events, (values (0), (1)) v(i) where i = 0 or event_id % 2 = 0",
    ),
)
def _(spark, sf):
    first = F.to_json(F.struct(F.col("event_type").alias("message")))
    second = F.to_json(F.struct(F.col("user_id").cast("string").alias("msg")))
    content = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))).otherwise(first)
    docs = view(spark, sf, "events").select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("file"), content.alias("content"))
    return structured.json_documents(docs).select("file", "entry", "message")


def reports(spark, sf):
    return view(spark, sf, "xml_reports")


@query(
    "src6_junit_xml",
    oracle(
        "orders",
        """select concat('x', cast(o_orderkey as varchar), '.xml') as file, concat('s', cast(o_custkey % 5 as varchar)) as suite, concat('a', cast(o_orderkey as varchar)) as name, cast(o_orderkey % 100 as double) + 0.5 as time, 'passed' as status, cast(null as varchar) as problem_message, cast(null as varchar) as problem_text from orders where o_orderkey % 4 = 0
        union all select concat('x', cast(o_orderkey as varchar), '.xml'), concat('s', cast(o_custkey % 5 as varchar)), concat('b', cast(o_orderkey as varchar)), 1.0, 'failed', o_orderstatus, 'boom' from orders where o_orderkey % 4 = 0
        union all select concat('x', cast(o_orderkey as varchar), '.xml'), concat('r', cast(o_custkey % 5 as varchar)), concat('c', cast(o_orderkey as varchar)), 0.0, 'error', o_orderstatus, 'bad' from orders where o_orderkey % 4 = 1""",
    ),
)
def _(spark, sf):
    docs = reports(spark, sf).filter(structured.xml_root(F.col("content")).isin("testsuites", "testsuite"))
    return structured.junit_cases(docs).drop("classname")


@query(
    "src7_coverage_xml",
    oracle(
        "orders",
        """select concat('x', cast(o_orderkey as varchar), '.xml') as file, concat('p', cast(o_custkey % 7 as varchar)) as package, concat('C', cast(o_orderkey as varchar)) as class, 'f.c' as filename, 0.5::double as line_rate, 0.25::double as branch_rate,
        2 as lines, cast(o_orderkey % 9 as bigint) as hits, 1 as branches from orders where o_orderkey % 4 = 2""",
    ),
)
def _(spark, sf):
    docs = reports(spark, sf).filter(structured.xml_root(F.col("content")) == "coverage")
    rows = structured.coverage_classes(docs)
    return rows.select(
        "file", "package", "class", "filename", "line_rate", "branch_rate",
        F.size("lines").alias("n"),
        F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["hits"]).alias("hits"),
        F.size(F.filter("lines", lambda x: x["branch"])).alias("branches"),
    ).withColumnRenamed("n", "lines")


@query(
    "src8_generic_xml",
    oracle(
        "orders",
        "select concat('x', cast(o_orderkey as varchar), '.xml') as file, 'other' as root, cast(o_orderkey as varchar) as id, o_orderstatus as item from orders where o_orderkey % 4 = 3",
    ),
)
def _(spark, sf):
    return structured.xml_documents(reports(spark, sf)).filter("root = 'other'").select(
        "file",
        "root",
        F.try_variant_get("data", "$._id", "string").alias("id"),
        F.try_variant_get("data", "$.item", "string").alias("item"),
    )


@query(
    "src9_csv_rows",
    oracle(
        "mixed_lines events",
        "select file, line_number, strftime(e.ts, '%Y-%m-%d %H:%M:%S') as logged_at, event_type as level, cast(user_id as varchar) as code, 'a, \"quoted\" note' as note from mixed_lines m join events e using (event_id) where starts_with(file, 'table')",
    ),
)
def _(spark, sf):
    rows = structured.csv_rows(only(spark, sf, "table"))
    return rows.select(
        "file", "line_number", "logged_at", "level", F.col("data")["code"].alias("code"), F.col("data")["note"].alias("note")
    )


# Every third note is plain; the others go over lines, one with a blank line in it.
NOTES = """case o_orderkey % 3 when 0 then concat('a', chr(10), 'b "q"') when 1 then 'x, y' else concat('l1', chr(10), chr(10), 'l3') end"""


def write_csv_files(spark, sf) -> str:
    """The orders as CSV files whose cells hold line breaks, delimiters and quotes."""
    path = work_path(spark, "csv")
    orders = view(spark, sf, "orders").withColumn("file", F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")))
    note = F.replace(F.expr(NOTES.replace("chr(", "char(")), F.lit('"'), F.lit('""'))
    record = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), note, F.lit('",'), "o_orderstatus")
    head = orders.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("at"), F.lit("key,note,level").alias("text"))
    rows = head.unionByName(orders.select("file", F.col("o_orderkey").cast("bigint").alias("at"), record.alias("text")))
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "text").write.partitionBy("file").text(path)
    return path


@query(
    "src9_csv_cells_over_lines",
    oracle(
        "orders",
        f"""select concat('f', cast(o_custkey % 3 as varchar)) as file, cast(o_orderkey as varchar) as key, {NOTES} as note, o_orderstatus as level,
        cast(2 + coalesce(sum(case o_orderkey % 3 when 0 then 2 when 1 then 1 else 3 end) over (partition by o_custkey % 3 order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as bigint) as line_number from orders""",
    ),
)
def _(spark, sf):
    rows = structured.csv_rows(text.numbered_lines(spark, write_csv_files(spark, sf)))
    return rows.select(
        F.regexp_extract("file", r"file=(\w+)", 1).alias("file"), F.col("data")["key"].alias("key"), F.col("data")["note"].alias("note"), "level", "line_number"
    )


PARSED = f"""{JSON}, f as (select * from mixed_lines where starts_with(file, 'fuzz')),
  ev as (select file, 'json' as format, {KIND} as kind from j
  union all select file, 'csv', 'csv_row' from mixed_lines where starts_with(file, 'table') and line_number > 1
  union all select file, 'libfuzzer', 'execution_stats' from f where regexp_matches(raw_line, '^#(\\d+)\\s+INITED.*exec/s:\\s*(\\d+)')
  union all select file, 'libfuzzer', 'crash_found' from f where contains(raw_line, 'crash')
  union all select file, 'libfuzzer', 'leak_found' from f where contains(raw_line, 'leak')
  union all select file, 'text', 'log_line' from mixed_lines where starts_with(file, 'text'))"""


@query("src1_parse_any_format", oracle("mixed_lines", f"with {PARSED} select file, format, kind, count(*) as entries from ev group by file, format, kind"))
def _(spark, sf):
    return log_analysis.parse_table(mixed(spark, sf)).groupBy("file", "format", "kind").agg(F.count("*").alias("entries"))


@query(
    "ud8_added_rules",
    oracle("mixed_lines", "select file, count(*) as hits from mixed_lines where contains(raw_line, 'libfuzzer leak') group by file"),
)
def _(spark, sf):
    from ..operators.logs import dispatch_tools, event

    added = {"own": lambda line: [event("own_leak", line.contains("libfuzzer leak"))]}
    found = dispatch_tools(mixed(spark, sf).withColumn("tool", F.lit("own")), added)
    return found.groupBy("file").agg(F.count("*").alias("hits"))


# -- files -----------------------------------------------------------------------


def write_shards(spark, sf, extension: str = "txt") -> str:
    """The log lines as text files of at most ``SHARD_LINES`` lines."""
    path = work_path(spark, "logs")
    shard = F.floor(F.col("line_number") / SHARD_LINES)
    rows = view(spark, sf, "log_lines").withColumn("shard", shard)
    ordered = rows.repartition("shard").sortWithinPartitions("shard", "line_number").select("shard", "raw_line")
    ordered.write.partitionBy("shard").text(path)
    return path


def shard_of(file):
    return F.regexp_extract(file, r"shard=(\d+)", 1)


SHARDS = "with s as (select cast(line_number // 1000 as varchar) as shard, row_number() over (partition by line_number // 1000 order by line_number) as line_number, raw_line from log_lines) "


@query("src10_src11_numbered_lines", oracle("log_lines", SHARDS + "select shard, line_number, raw_line from s"))
def _(spark, sf):
    lines = text.numbered_lines(spark, write_shards(spark, sf))
    return lines.select(shard_of(F.col("file")).alias("shard"), "line_number", "raw_line")


@query(
    "src14_file_contents",
    oracle("log_lines", SHARDS + "select shard, cast(sum(length(raw_line) + 1) as bigint) as size_bytes, count(*) + 1 as line_count from s group by shard"),
)
def _(spark, sf):
    files = text.file_contents(spark, write_shards(spark, sf))
    return files.select(shard_of(F.col("file")).alias("shard"), "size_bytes", F.size(T.lines(F.col("content"))).cast("bigint").alias("line_count"))


@query(
    "src15_ag16_listing",
    oracle("log_lines", SHARDS + "select shard, cast(sum(length(raw_line) + 1) as bigint) as size_bytes, cast(1 as bigint) as file_count from s group by shard"),
)
def _(spark, sf):
    stats = text.storage_statistics(text.listing(spark, write_shards(spark, sf), "*.txt"))
    return stats.select(shard_of(F.col("directory")).alias("shard"), "size_bytes", "file_count")


TREE = {"area": 2, "half": 3, "part": 5}


@query(
    "ag16_folder_totals",
    oracle(
        "log_lines",
        "with f as (select concat('area=', line_number % 2) as a, concat('half=', line_number % 3) as h, concat('part=', line_number % 5) as p, sum(length(raw_line) + 1) as n from log_lines group by 1, 2, 3), "
        "d as (select unnest(['', a, concat_ws('/', a, h), concat_ws('/', a, h, p)]) as folder, unnest([0, 1, 2, 3]) as depth, a, h, n from f), "
        "t as (select folder, depth, sum(n) as n, count(*) as files, count(distinct a) as areas, count(distinct concat(a, h)) as halves from d group by folder, depth) "
        "select folder, cast(n as bigint) as size_bytes, files + case depth when 0 then areas + halves + files when 1 then halves + files when 2 then files else 0 end as entries from t",
    ),
)
def _(spark, sf):
    """A tree of folders, three deep with a file in each of the lowest."""
    path, named = work_path(spark, "tree"), list(TREE)
    rows = view(spark, sf, "log_lines").select("raw_line", *[(F.col("line_number") % n).alias(name) for name, n in TREE.items()])
    rows.repartition(*named).write.partitionBy(*named).text(path)
    return text.folder_totals(text.listing(spark, path, "*.txt"), text.qualified(spark, path))


@query(
    "snk9_analyze_folder",
    oracle("log_lines", "select 'text' as format, count(distinct line_number // 1000) as files, count(*) as total_entries, cast(0 as bigint) as total_errors from log_lines"),
)
def _(spark, sf):
    return log_analysis.analyze_folder(spark, write_shards(spark, sf), work_path(spark, "totals"), "*.txt")


DOCUMENTS = {0: "list.json", 1: "lines.json", 2: "suite.xml", 3: "table.csv"}


def write_documents(spark, sf) -> str:
    """The events as files of every format: lists of JSON over many lines, JSON by line, XML suites, CSV with line breaks."""
    path, events = work_path(spark, "documents"), view(spark, sf, "events")
    kind, identity = (F.col("event_id") % 4).cast("int"), F.col("event_id").cast("string")
    level = F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string"))
    one = F.concat(F.lit('{"message": "'), "event_type", F.lit('",\n  "level": "'), level, F.lit('"},'))
    line = F.concat(F.lit('{"message":"'), "event_type", F.lit('","level":"'), level, F.lit('"}'))
    case = F.concat(F.lit('<testcase name="e'), identity, F.lit('"/>'))
    row = F.concat(level, F.lit(',"a\n""b"", c",'), identity, F.lit(",x"))
    body = F.when(kind == 0, one).when(kind == 1, line).when(kind == 2, case).otherwise(row)
    rows = events.select(kind.alias("kind"), (F.col("user_id") % 2).cast("int").alias("shard"), F.col("event_id").cast("bigint").alias("at"), body.alias("text"))
    files, (k, last) = rows.select("kind", "shard").distinct(), (F.col("kind"), F.lit(1 << 60))
    head = F.when(k == 0, "[").when(k == 2, '<testsuites>\n<testsuite name="s">').when(k == 3, "level,note,id,more")
    foot = F.when(k == 0, '{"message": "end"}\n]').when(k == 1, "{broken").when(k == 2, "</testsuite>\n</testsuites>")
    for at, edge in ((F.lit(-1).cast("bigint"), head), (last.cast("bigint"), foot)):
        rows = rows.unionByName(files.select("kind", "shard", at.alias("at"), edge.alias("text")).filter("text is not null"))
    ordered = rows.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "at").select("kind", "shard", "text")
    ordered.write.partitionBy("kind", "shard").text(path)
    # The writer names all files .txt; the formats go by the extension.
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, name in DOCUMENTS.items():
        for found in system.globStatus(of(f"{path}/kind={kind}/shard=*/part-*")) or []:
            folder = found.getPath().getParent()
            system.rename(found.getPath(), of(folder, name))
    return path


DOCUMENT_EVENTS = """x as (select event_id % 4 as k, cast(user_id % 2 as varchar) as shard, concat('l', cast(user_id % 3 as varchar)) as lv, event_type from events),
  ev as (select k, shard, case when k < 2 then 'json' when k = 2 then 'xml' else 'csv' end as format, case k when 2 then 'test_case' when 3 then 'csv_row' end as kind,
      case when k = 2 then 'passed' else lv end as level, case when k < 2 then event_type end as message, false as is_bad from x
    union all select distinct k, shard, 'json', null, null, 'end', false from x where k = 0
    union all select distinct k, shard, 'json', null, null, null, true from x where k = 1)"""
DOCUMENT_NAME = "case k when 0 then 'list.json' when 1 then 'lines.json' when 2 then 'suite.xml' else 'table.csv' end"


@query(
    "src1_documents_of_any_size",
    oracle("events", f"with {DOCUMENT_EVENTS} select {DOCUMENT_NAME} as name, shard, format, kind, level, message, is_bad, count(*) as entries from ev group by all"),
)
def _(spark, sf):
    rows = log_analysis.parse_folder(spark, write_documents(spark, sf))
    named = F.when(F.col("format") == "json", F.col("message")).alias("message")
    return rows.groupBy(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), F.regexp_extract("file", r"shard=(\d+)", 1).alias("shard"), "format", "kind", "level", named, "is_bad"
    ).agg(F.count("*").alias("entries"))


@query(
    "snk9_analyze_documents",
    oracle(
        "events",
        f"with {DOCUMENT_EVENTS} select format, count(distinct concat({DOCUMENT_NAME}, shard)) as files, count(case when not is_bad then 1 end) as total_entries, count(case when is_bad then 1 end) as total_errors from ev group by format",
    ),
)
def _(spark, sf):
    return log_analysis.analyze_folder(spark, write_documents(spark, sf), work_path(spark, "totals"), "*.{json,xml,csv}")


# -- entities --------------------------------------------------------------------

SESSION_COLUMNS = "session_id, pid, llm_provider, status, fuzz_drivers_generated, estimated_cost_usd"
SESSION_SQL = f"select {SESSION_COLUMNS}, strftime(start_time, '%Y-%m-%d %H:%M:%S') as started from sessions"


def session_columns(df):
    return df.select(*SESSION_COLUMNS.split(", "), F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("src12_session_documents", oracle("sessions", SESSION_SQL))
def _(spark, sf):
    path = work_path(spark, "sessions")
    view(spark, sf, "sessions").withColumn("llm_provider", F.upper("llm_provider")).write.json(path)
    return session_columns(entities.read_sessions(spark, path))


@query("set5_plain_and_compressed_sessions", oracle("sessions", SESSION_SQL))
def _(spark, sf):
    path, sessions = work_path(spark, "sessions"), view(spark, sf, "sessions")
    sessions.filter("pid % 3 > 0").write.json(path)
    sessions.filter("pid % 3 < 2").write.mode("append").option("compression", "gzip").json(path)
    return session_columns(entities.read_sessions(spark, path).dropDuplicates(["session_id"]))


def metric_rows(spark, sf):
    return view(spark, sf, "metrics").select(
        "session_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "metric_category",
        F.lit("cpu").alias("metric_name"),
        F.col("cpu_percent").cast("string").alias("value"),
        F.to_json(F.struct("event_id")).alias("additional_data"),
    )


@query(
    "src13_metric_files",
    oracle("metrics", "select session_id, metric_category, count(*) as samples, round(sum(cpu_percent), 3) as total, cast(max(event_id) as bigint) as last_event, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen from metrics group by 1, 2"),
)
def _(spark, sf):
    path = work_path(spark, "metrics")
    entities.write_session_metrics(metric_rows(spark, sf), path)
    rows = entities.read_metrics(spark, path)
    return rows.groupBy("session_id", "metric_category").agg(
        F.count("*").alias("samples"),
        F.round(F.sum(F.col("value").cast("double")), 3).alias("total"),
        F.max(F.try_variant_get("additional_data", "$.event_id", "bigint")).alias("last_event"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
    )


@query("snk1_latest_version", oracle("sessions", SESSION_SQL))
def _(spark, sf):
    path, sessions = work_path(spark, "versions"), view(spark, sf, "sessions")
    entities.append_entities(sessions.withColumn("status", F.lit("initializing")).withColumn("version", F.lit(1)), path)
    entities.append_entities(sessions.withColumn("version", F.lit(2)), path)
    return session_columns(entities.latest(spark.read.parquet(path), "session_id", "version"))


@query(
    "snk2_metric_partitions",
    oracle("metrics", "select strftime(ts, '%Y-%m-%d') as date, metric_category, count(*) as samples from metrics group by 1, 2"),
)
def _(spark, sf):
    path = work_path(spark, "metrics")
    entities.append_metrics(metric_rows(spark, sf).drop("session_id"), path)
    written = spark.read.option("header", "true").csv(path)
    return written.groupBy(F.col("date").cast("string").alias("date"), "metric_category").agg(F.count("*").alias("samples"))


@query(
    "snk3_codecs",
    oracle("findings", "select codec, count(*) as findings, round(sum(confidence_score), 3) as confidence from findings, (values ('none'), ('gzip'), ('lz4')) v(codec) group by codec"),
)
def _(spark, sf):
    out = None
    for name in entities.CODECS:
        path = work_path(spark, f"findings-{name}")
        findings = view(spark, sf, "findings")
        findings.write.option("compression", entities.codec(name)).json(path)
        read = spark.read.schema(findings.schema).json(path).agg(
            F.lit(name).alias("codec"), F.count("*").alias("findings"), F.round(F.sum("confidence_score"), 3).alias("confidence")
        )
        out = read if out is None else out.unionByName(read)
    return out


EXPORTED = ("interactions", "findings", "crashes")


@query(
    "snk4_export",
    oracle(
        "sessions " + " ".join(EXPORTED),
        "with c as (select session_id from sessions where status = 'completed') select 'sessions' as kind, count(*) as rows from c"
        + "".join(f" union all select '{n}', count(*) from {n} where session_id in (select session_id from c)" for n in EXPORTED),
    ),
)
def _(spark, sf):
    sessions = view(spark, sf, "sessions")
    ids = sessions.filter("status = 'completed'").select("session_id")
    return entities.export(sessions, {n: view(spark, sf, n) for n in EXPORTED}, work_path(spark, "export"), ids)


@query(
    "snk5_archive",
    oracle(
        "findings",
        "select case when ts < timestamp '2024-01-31' - interval 7 day then 'archive' else 'live' end as part, count(*) as rows, cast(sum(length(finding_id)) as bigint) as id_chars from findings group by 1",
    ),
)
def _(spark, sf):
    parts = entities.archive(
        view(spark, sf, "findings"), "ts", F.lit("2024-01-31 00:00:00"), 7, work_path(spark, "archive")
    )
    out = [
        df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.sum(F.length("finding_id")).alias("id_chars"))
        for name, df in zip(("archive", "live"), parts)
    ]
    return out[0].unionByName(out[1])


@query(
    "snk5_archive_figures",
    oracle(
        "findings",
        "with f as (select *, cast(ts as date) < cast(timestamp '2024-01-31' - interval 7 day as date) as old from findings) "
        "select count(distinct case when old then cast(ts as date) end) as files_archived, cast(0 as bigint) as errors, count(case when old then 1 end) as archived, count(case when not old then 1 end) as live from f",
    ),
)
def _(spark, sf):
    live, target = work_path(spark, "live"), work_path(spark, "archived")
    rows = view(spark, sf, "findings").withColumn("day", F.to_date("ts"))
    rows.repartition("day").write.partitionBy("day").parquet(live)  # one file per day
    figures = entities.archive_days(spark, live, target, "2024-01-31", 7)
    counts = [spark.read.schema(rows.schema).parquet(p).agg(F.count("*").alias(n)) for p, n in ((target, "archived"), (live, "live"))]
    return figures.select("files_archived", "errors").join(counts[0]).join(counts[1])


@query(
    "snk6_surplus_backups",
    oracle(
        "events",
        "select base, path from (select concat('b', cast(user_id as varchar)) as base, cast(event_id as varchar) as path, row_number() over (partition by user_id order by ts desc, cast(event_id as varchar) desc) as r from events) t where r > 5",
    ),
)
def _(spark, sf):
    backups = view(spark, sf, "events").select(
        F.concat(F.lit("b"), F.col("user_id").cast("string")).alias("base"), F.col("event_id").cast("string").alias("path"), F.col("ts").alias("mtime")
    )
    return entities.surplus_backups(backups).select("base", "path")


@query("snk8_cumulative_results", oracle("experiments", "select status, count(*) as runs, cast(sum(generated_files) as bigint) as files from experiments group by status"))
def _(spark, sf):
    path, runs = work_path(spark, "experiments"), view(spark, sf, "experiments")
    entities.append_entities(runs.filter("category <= '3'"), path)
    entities.append_entities(runs.filter("category > '3'"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("runs"), F.sum("generated_files").alias("files"))


@query(
    "snk7_session_reports",
    oracle("sessions findings", "select session_id, status, llm_provider as provider, cast(total_tokens_consumed as bigint) as total_tokens, count(f.finding_id) filter (where severity = 'critical') as critical from sessions s left join findings f using (session_id) group by all"),
)
def _(spark, sf):
    from ..operators import sessions as sx

    path = work_path(spark, "reports")
    analyzed = sx.analyze(view(spark, sf, "sessions"), view(spark, sf, "findings"), "2024-02-01 00:00:00")
    report = sx.report(analyzed)
    entities.write_reports(report, path)
    read = spark.read.schema(report.schema).json(path)
    return read.select(
        "session_id", "session_summary.status", "usage.provider", "usage.total_tokens", "vulnerability_breakdown.critical"
    )


@query(
    "fn1_fn8_functions",
    oracle(
        "events",
        f"""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, strftime(ts - interval 3 day, '%Y-%m-%d %H:%M:%S') as cutoff, event_id // 7 as floored, round(least(greatest(value, 5.0::double), 50.0::double), 6) as clamped,
        sha256(props) as digest, json_extract_string(props, '$.k') as k, upper({S.strip("concat(' ', event_type, chr(10))")}) as label, replace(event_type, 'e', '_') as replaced,
        length(event_type) - length(replace(event_type, 'e', '')) as counted from events""",
    ),
)
def _(spark, sf):
    kind = F.col("event_type")
    return view(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"),
        F.date_format(F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(3)), "yyyy-MM-dd HH:mm:ss").alias("cutoff"),
        F.floor(F.col("event_id") / 7).alias("floored"),
        F.round(F.least(F.greatest("value", F.lit(5.0)), F.lit(50.0)), 6).alias("clamped"),
        F.sha2("props", 256).alias("digest"),
        F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"),
        F.upper(T.strip(F.concat(F.lit(" "), kind, F.lit("\n")))).alias("label"),
        F.replace(kind, F.lit("e"), F.lit("_")).alias("replaced"),
        T.literal_count(kind, "e").alias("counted"),
    )
