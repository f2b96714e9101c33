"""Log lines -> typed events.

Input everywhere: ``file``, ``line_number``, ``raw_line``. All parsing is column
expressions over one scan; nothing here shuffles except the crash-trace grouping,
whose windows are cut into fixed runs of line numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import first_of_each

# Patterns of the generic line parser.
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?)"
LEVEL = T.WORD_START + r"((?i)DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)" + T.WORD_END
PROCESS_ID = T.WORD_START + r"(?i)pid[:\s]*(\d+)"
MEMORY = r"(?i)(?:memory|mem)[:\s]*(\d+(?:\.\d+)?)\s*(mb|gb|kb|bytes?)"
CPU = r"(?i)cpu[:\s]*(\d+(?:\.\d+)?)%"
DURATION = r"(?i)(?:exec|execution|took)[:\s]*(\d+(?:\.\d+)?)\s*(ms|s|sec|seconds?|minutes?)"
COVERAGE = r"(?i)coverage[:\s]*(\d+(?:\.\d+)?)%"
LINE_COVERAGE = r"(?i)lines?[:\s]*(\d+(?:\.\d+)?)%"
BRANCH_COVERAGE = r"(?i)branch(?:es)?[:\s]*(\d+(?:\.\d+)?)%"
CRASH = "(?i)" + T.whole("crash|abort|segfault|sigsegv|sigabrt")
VULNERABILITY = "(?i)" + T.whole(r"vulnerability|exploit|cve-\d{4}-\d+|buffer overflow|use after free")
# Lower-case words of which every match of a pattern above holds one.
CRASH_WORDS = ("crash", "abort", "segfault", "sigsegv", "sigabrt")
VULNERABILITY_WORDS = ("vulnerability", "exploit", "cve-", "buffer overflow", "use after free")
MODEL_TERMS = ("llm", "openai", "anthropic", "ollama", "gpt", "claude")
SIGNAL = r"(?i)signal\s*(\d+|SIG\w+)"
ADDRESS = r"0x[0-9a-fA-F]+"
CVE = r"(?i)CVE-\d{4}-\d+"
MODEL_NAMES = (
    r"(?i)gpt-[34](?:\.\d+)?(?:-turbo)?",
    r"(?i)claude-[23](?:-\w+)?",
    r"(?i)llama-?\d+",
    r"(?i)text-davinci-\d+",
)
TOKENS = r"(?i)tokens?[:\s]*(\d+)"
COST = r"\$(\d+(?:\.\d+)?)"
VULNERABILITY_PHRASES = (
    ("buffer overflow", "buffer_overflow"),
    ("use after free", "use_after_free"),
    ("null pointer", "null_pointer_dereference"),
    ("sql injection", "sql_injection"),
)
API_CALLS = (
    ("openai", r"(?i)POST.*openai.*completions.*tokens.*(\d+)"),
    ("anthropic", r"(?i)POST.*anthropic.*messages.*tokens.*(\d+)"),
    ("ollama", r"(?i)POST.*localhost:11434.*generate"),
    ("huggingface", r"(?i)POST.*huggingface.*inference"),
)
CRASH_CLASSES = (
    ("buffer_overflow", r"(?i)stack.*overflow|heap.*overflow|buffer.*overflow"),
    ("use_after_free", r"(?i)use.*after.*free|heap.*corruption|double.*free"),
    ("null_pointer", r"(?i)sigsegv|access.*violation|null.*pointer"),
    ("memory_leak", r"(?i)memory.*leak|leak.*detected"),
)
TOOL_STATISTICS = (
    ("afl_stats", r"(?i)execs_done\s*:\s*(\d+)"),
    ("libfuzzer_stats", r"(?i)#(\d+)\s+INITED.*exec/s:\s*(\d+)"),
    ("honggfuzz_stats", r"(?i)Iterations:\s*(\d+).*Speed:\s*(\d+)"),
    ("cifuzz_output", r"(?i)Running fuzz test.*?(\w+)"),
    ("compilation_error", r"(?i)error:\s*(.+)"),
    ("llm_generation", r"(?i)(?:generating|generated).*?(?:fuzz|test|driver).*?(\w+)"),
)


# -- generic lines ---------------------------------------------------------------


def clean_lines(df: DataFrame) -> DataFrame:
    """Strip every line and drop blank ones."""
    return df.withColumn("raw_line", T.strip(F.col("raw_line"))).filter(F.col("raw_line") != "")


def memory_mb(line: Column) -> Column:
    value, unit = T.number(line, MEMORY, 1), F.lower(T.first(line, MEMORY, 2))
    return (
        F.when(unit == "gb", value * 1024)
        .when(unit == "kb", value / 1024)
        .when(unit.isin("byte", "bytes"), value / (1024 * 1024))
        .otherwise(value)
    )


def duration_ms(line: Column) -> Column:
    value, unit = T.number(line, DURATION, 1), F.lower(T.first(line, DURATION, 2))
    return (
        F.when(unit.isin("s", "sec", "second", "seconds"), value * 1000)
        .when(unit.isin("minute", "minutes"), value * 60000)
        .otherwise(value)
    )


def mentions_model(line: Column) -> Column:
    return T.has(F.lower(line), *MODEL_TERMS)


def kind_of(is_model: Column, is_vulnerability: Column, is_crash: Column) -> Column:
    """The last rule that holds decides, so the rules are tried from the end."""
    return F.when(is_model, "llm_interaction").when(is_vulnerability, "vulnerability").when(is_crash, "crash").otherwise("log_line")


def line_kind(line: Column) -> Column:
    return kind_of(mentions_model(line), line.rlike(VULNERABILITY), line.rlike(CRASH))


def vulnerability_phrase(line: Column) -> Column:
    text, out = F.lower(line), F.lit(None).cast("string")
    for phrase, kind in reversed(VULNERABILITY_PHRASES):
        out = F.when(text.contains(phrase), kind).otherwise(out)
    return out


def model_name(line: Column) -> Column:
    return F.coalesce(*[T.first(line, pattern) for pattern in MODEL_NAMES])


def parse_lines(df: DataFrame) -> DataFrame:
    """All generic fields of every non-blank line. Lines are lower-cased once, and patterns tried only where a word of theirs is."""
    line, low = F.col("raw_line"), F.col("_low")

    def holding(*words: str) -> Column:
        return F.when(T.has(low, *words), line)

    tests = {
        "is_crash": T.has(low, *CRASH_WORDS) & line.rlike(CRASH),
        "is_vulnerability": T.has(low, *VULNERABILITY_WORDS) & line.rlike(VULNERABILITY),
        "is_model": T.has(low, *MODEL_TERMS),
    }
    is_crash, is_vulnerability, is_model = (F.col(name) for name in tests)
    return clean_lines(df).withColumn("_low", F.lower(line)).withColumns(tests).select(
        "file",
        "line_number",
        "raw_line",
        T.first(line, TIMESTAMP, 1).alias("logged_at"),
        F.upper(T.first(line, LEVEL, 1)).alias("level"),
        T.whole_number(holding("pid"), PROCESS_ID).alias("pid"),
        memory_mb(holding("mem")).alias("memory_mb"),
        T.number(holding("cpu"), CPU).alias("cpu_percent"),
        duration_ms(holding("exec", "took")).alias("execution_time_ms"),
        T.number(holding("coverage"), COVERAGE).alias("coverage_percent"),
        *tests,
        kind_of(is_model, is_vulnerability, is_crash).alias("kind"),
        F.when(is_crash, T.first(line, SIGNAL, 1)).alias("signal"),
        F.when(is_crash, T.matches(line, ADDRESS)).alias("addresses"),
        F.when(is_vulnerability, F.upper(T.first(line, CVE))).alias("cve_id"),
        F.when(is_vulnerability, vulnerability_phrase(line)).alias("vulnerability_type"),
        F.when(is_model, model_name(line)).alias("model"),
        F.when(is_model, T.whole_number(line, TOKENS)).alias("tokens"),
        F.when(is_model, T.number(line, COST)).alias("cost"),
    )


def log_statistics(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per file (or other ``keys``) over the raw lines."""
    events = parse_lines(df)
    return events.groupBy(*(keys or ("file",))).agg(
        F.count("*").alias("total_lines"),
        F.count("execution_time_ms").alias("execution_events"),
        F.count_if("is_crash").alias("crash_events"),
        F.count_if("is_model").alias("model_events"),
        F.count_if(F.col("kind") == "vulnerability").alias("vulnerability_entries"),
        F.max("memory_mb").alias("peak_memory_mb"),
        F.max("coverage_percent").alias("best_coverage"),
    )


def api_call(line: Column) -> Column:
    """STRUCT<provider, tokens> of an API request line; the first provider that matches wins."""
    out = F.lit(None).cast("string")
    tokens = F.lit(None).cast("bigint")
    for provider, pattern in reversed(API_CALLS):
        found = line.rlike(pattern)
        out = F.when(found, provider).otherwise(out)
        counted = T.whole_number(line, pattern) if "(\\d+)" in pattern else F.lit(None).cast("bigint")
        tokens = F.when(found, counted).otherwise(tokens)
    return F.struct(out.alias("provider"), tokens.alias("tokens"))


def crash_class(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(CRASH_CLASSES):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def tool_statistics(df: DataFrame) -> DataFrame:
    """One row per statistic pattern a line matches, with the captured text."""
    line = F.col("raw_line")
    found = [
        F.when(
            line.rlike(pattern),
            F.struct(F.lit(name).alias("statistic"), F.regexp_extract(line, pattern, 1).alias("captured")),
        )
        for name, pattern in TOOL_STATISTICS
    ]
    return df.select("file", "line_number", F.explode(F.array_compact(F.array(*found))).alias("s")).select(
        "file", "line_number", "s.statistic", "s.captured"
    )


# -- tool parsers ----------------------------------------------------------------

_EVENT_FIELDS = {
    "iterations": "bigint",
    "per_second": "bigint",
    "tokens": "bigint",
    "cost": "double",
    "percent": "double",
}


def event(kind: str, condition: Column, **values: Column) -> Column:
    """An event struct where ``condition`` holds, else NULL."""
    fields = [F.lit(kind).alias("kind")] + [
        values.get(name, F.lit(None)).cast(sql_type).alias(name) for name, sql_type in _EVENT_FIELDS.items()
    ]
    return F.when(condition, F.struct(*fields))


def emit(df: DataFrame, events: list[Column]) -> DataFrame:
    """Explode the events each line gives; one line may give several."""
    return df.select(
        "file", "line_number", "raw_line", F.explode(F.array_compact(F.array(*events))).alias("e")
    ).select("file", "line_number", "e.*", F.col("raw_line").alias("message"))


def afl_events(line: Column) -> list[Column]:
    low = F.lower(line)
    return [
        event("afl_startup", low.contains("american fuzzy lop")),
        event("crash_found", low.contains("saved crash")),
        event("hang_found", low.contains("saved hang")),
    ]


def libfuzzer_events(line: Column) -> list[Column]:
    low, pattern = F.lower(line), r"^#(\d+)\s+INITED.*exec/s:\s*(\d+)"
    return [
        event(
            "execution_stats",
            line.rlike(pattern),
            iterations=T.whole_number(line, pattern, 1),
            per_second=T.whole_number(line, pattern, 2),
        ),
        event("crash_found", T.has(low, "crash", "asan")),
        event("leak_found", low.contains("leak")),
    ]


def honggfuzz_events(line: Column) -> list[Column]:
    low, pattern = F.lower(line), r"Iterations:\s*(\d+).*Speed:\s*(\d+)"
    return [
        event(
            "execution_stats",
            line.rlike(pattern),
            iterations=T.whole_number(line, pattern, 1),
            per_second=T.whole_number(line, pattern, 2),
        ),
        event("crash_found", T.has(low, "crash", "unique")),
    ]


def test_runner_events(line: Column) -> list[Column]:
    low = F.lower(line)
    return [
        event("fuzz_test_start", low.contains("running fuzz test")),
        event("build_event", T.has(low, "building", "compiling")),
        event("llm_interaction", T.has(low, "generating", "llm", "ai")),
        event("finding", T.has(low, "finding", "vulnerability")),
    ]


def model_call_events(line: Column) -> list[Column]:
    tokens, cost = T.whole_number(line, TOKENS), T.number(line, COST)
    return [
        event("api_call", T.has(F.lower(line), "openai", "anthropic")),
        event("token_usage", tokens.isNotNull(), tokens=tokens),
        event("cost_tracking", cost.isNotNull(), cost=cost),
    ]


def compilation_events(line: Column) -> list[Column]:
    low = F.lower(line)
    return [
        event("compilation_error", low.contains("error:")),
        event("compilation_warning", low.contains("warning:")),
        event("compilation_success", T.has(low, "successfully compiled", "build successful")),
    ]


def coverage_events(line: Column) -> list[Column]:
    return [
        event(kind, T.number(line, pattern).isNotNull(), percent=T.number(line, pattern))
        for kind, pattern in (
            ("coverage_data", COVERAGE),
            ("line_coverage", LINE_COVERAGE),
            ("branch_coverage", BRANCH_COVERAGE),
        )
    ]


def crash_dump_events(line: Column) -> list[Column]:
    """The start of each crash; what hangs on other lines is in ``TABLE_PARSERS``."""
    return [event("crash_start", T.has(F.lower(line), *CRASH_START_TERMS))]


# Tool name -> line parser. Callers may add entries.
LINE_PARSERS: dict[str, Callable[[Column], list[Column]]] = {
    "afl": afl_events,
    "libfuzzer": libfuzzer_events,
    "honggfuzz": honggfuzz_events,
    "cifuzz": test_runner_events,
    "llm": model_call_events,
    "compilation": compilation_events,
    "coverage": coverage_events,
    "crash": crash_dump_events,
}


def tool_events(df: DataFrame, tool: str) -> DataFrame:
    """Events of the lines of one tool."""
    stripped = df.withColumn("raw_line", T.strip(F.col("raw_line")))
    return emit(stripped, LINE_PARSERS[tool](F.col("raw_line")))


def dispatch_tools(df: DataFrame, parsers: dict[str, Callable[[Column], list[Column]]] | None = None) -> DataFrame:
    """Every line through the parser its ``tool`` column names, in one scan.

    Events that hang on other lines of the file come from ``TABLE_PARSERS``; a stream has no whole
    file, so there they are left to a run over the appended lines.
    """
    line = F.col("raw_line")
    guarded = [
        F.when(F.col("tool") == tool, candidate)
        for tool, parser in (parsers or LINE_PARSERS).items()
        for candidate in parser(line)
    ]
    stripped = df.withColumn("raw_line", T.strip(line))
    rows = (
        stripped.select("tool", "file", "line_number", F.explode(F.array_compact(F.array(*guarded))).alias("e"))
        .select("tool", "file", "line_number", "e.*")
    )
    if not df.isStreaming:
        for tool, (kind, parser) in (TABLE_PARSERS if parsers is None else {}).items():
            found = parser(df.filter(F.col("tool") == tool)).select("file", "line_number", event(kind, F.lit(True)).alias("e"))
            rows = rows.unionByName(found.select(F.lit(tool).alias("tool"), "file", "line_number", "e.*"))
    return rows


def final_statistics(df: DataFrame) -> DataFrame:
    """Last value per ``key: value`` line, typed as integer, decimal or text.

    One row per (file, key): the aggregate keeps one candidate per key on the map side,
    so a file of any length folds before the shuffle.
    """
    line = T.strip(F.col("raw_line"))
    at = F.instr(line, ":")
    pairs = df.select(
        "file",
        "line_number",
        F.replace(F.lower(T.strip(F.substring(line, F.lit(1), at - 1))), F.lit(" "), F.lit("_")).alias("key"),
        T.strip(F.substring(line, at + 1, F.length(line))).alias("value"),
    ).filter(at > 0)
    last = pairs.groupBy("file", "key").agg(F.max_by("value", "line_number").alias("value"))
    value = F.col("value")
    return last.select(
        "file",
        "key",
        "value",
        F.when(value.rlike(r"^\d+$"), value.try_cast("bigint")).alias("int_value"),
        F.when(value.rlike(r"^\d+\.\d+$"), value.try_cast("double")).alias("double_value"),
    )


# -- crash dumps -----------------------------------------------------------------

CRASH_START_TERMS = ("segmentation fault", "sigsegv", "sigabrt", "crash")
LINES_PER_RUN = 1 << 16


def crash_signal(line: Column) -> Column:
    return F.coalesce(
        T.first(line, r"(?i)SIG(\w+)", 1),
        T.first(line, r"(?i)signal\s*(\d+)", 1),
        T.first(line, "(?i)segmentation fault"),
        T.first(line, "(?i)abort"),
    )


def _opens_crash(line: Column) -> Column:
    return T.has(F.lower(line), *CRASH_START_TERMS)


def counts_for_crashes(line: Column) -> Column:
    """Whether a stripped line opens or closes a trace, stands in one or is a report itself."""
    return _opens_crash(line) | (line == "") | line.startswith("#") | line.contains("0x") | T.has(F.lower(line), "asan", "msan")


def trace_state(df: DataFrame) -> DataFrame:
    """Each line that matters to crashes with ``open_at``: the start line of the crash still open before it.

    A start line opens a trace, a blank line closes it. The file is cut into runs of
    line numbers so that no window ever holds a whole long file: inside a run the last
    marker is a window, between runs one marker per run is carried on.
    """
    line = T.strip(F.col("raw_line"))
    starts = _opens_crash(line)
    base = df.filter(counts_for_crashes(line)).select(
        "file",
        "line_number",
        line.alias("raw_line"),
        starts.alias("starts"),
        F.floor(F.col("line_number") / LINES_PER_RUN).cast("bigint").alias("run"),
        F.when(starts, F.col("line_number")).when(line == "", F.lit(-1)).alias("marker"),
    )
    inside = Window.partitionBy("file", "run").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    between = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        base.groupBy("file", "run")
        .agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_number"))).alias("marker"))
        .select("file", "run", F.last("marker", ignorenulls=True).over(between).alias("carried"))
    )
    return (
        base.withColumn("local", F.last("marker", ignorenulls=True).over(inside))
        .join(carried, ["file", "run"])
        .select(
            "file",
            "line_number",
            "raw_line",
            "starts",
            F.nullif(F.coalesce("local", "carried", F.lit(-1)), F.lit(-1)).alias("open_at"),
        )
    )


def trace_frames(state: DataFrame) -> DataFrame:
    """Frame lines with the crash they belong to."""
    line = F.col("raw_line")
    return state.filter(
        ~F.col("starts") & F.col("open_at").isNotNull() & (line.startswith("#") | line.contains("0x"))
    ).select("file", F.col("open_at").alias("crash_line"), "line_number", F.col("raw_line").alias("frame"))


def crash_traces(df: DataFrame) -> DataFrame:
    """One row per crash: its start, signal, and the extent of its stack trace."""
    state = trace_state(df)
    starts = state.filter("starts").select(
        "file", F.col("line_number").alias("crash_line"), crash_signal(F.col("raw_line")).alias("signal"), "raw_line"
    )
    frames = trace_frames(state).groupBy("file", "crash_line").agg(
        F.count("*").alias("frames"),
        F.min_by("frame", "line_number").alias("first_frame"),
        F.max_by("frame", "line_number").alias("last_frame"),
    )
    return starts.join(frames, ["file", "crash_line"], "left").select(
        "file",
        "crash_line",
        "signal",
        F.col("raw_line").alias("message"),
        F.coalesce("frames", F.lit(0)).alias("frames"),
        "first_frame",
        "last_frame",
    )


def sanitizer_reports(df: DataFrame) -> DataFrame:
    """Sanitizer lines that are neither a crash start, nor a frame or end of an open trace."""
    line, low = F.col("raw_line"), F.lower(F.col("raw_line"))
    in_frame = F.col("open_at").isNotNull() & (line.startswith("#") | line.contains("0x") | (line == ""))
    return trace_state(df).filter(~F.col("starts") & ~in_frame & T.has(low, "asan", "msan")).select(
        "file",
        "line_number",
        F.when(low.contains("asan"), "asan").otherwise("msan").alias("sanitizer"),
        line.alias("message"),
    )


# Tool name -> kind and parser of whole line tables, for events that need more than their line.
TABLE_PARSERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"crash": ("sanitizer_report", sanitizer_reports)}


# -- routing and tails -----------------------------------------------------------

HANDLED_KINDS = ("crash_found", "crash_start", "compilation_error", "coverage_data", "finding")


def handled_events(events: DataFrame) -> DataFrame:
    """Only the event kinds that change a session."""
    return events.filter(F.col("kind").isin(*HANDLED_KINDS))


def tail(df: DataFrame, count: int) -> DataFrame:
    """The last ``count`` lines of every file, without a full sort of any file."""
    return first_of_each(df, ["file"], [F.desc("line_number")], count).drop("rank")


def head(df: DataFrame, count: int) -> DataFrame:
    """The first ``count`` entries in (file, line) order."""
    return df.orderBy("file", "line_number").limit(count)
