"""Parse every log file below a folder, whatever its format, and total the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import logs
from ..session import written
from ..sources import structured
from ..sources.text import SNIFFED_LINES, extension, format_of, numbered_lines, sniffing_tests

COMMON = ["file", "line_number", "format", "kind", "logged_at", "level", "message", "is_bad"]


def _common(df: DataFrame, form: Column, **columns: Column) -> DataFrame:
    values = {name: columns.get(name, F.col(name) if name in df.columns else F.lit(None)) for name in COMMON if name != "format"}
    values["format"] = form
    kinds = {"line_number": "bigint", "is_bad": "boolean"}
    return df.select(*[values[name].cast(kinds.get(name, "string")).alias(name) for name in COMMON])


def file_facts(lines: DataFrame) -> DataFrame:
    """Format, delimiter and column names per file, from its first lines only."""
    line, first = F.col("raw_line"), F.col("line_number") <= SNIFFED_LINES
    tests = sniffing_tests(line)
    seen = (
        lines.filter(F.col("line_number") <= structured.SAMPLE_CHARS)
        .groupBy("file")
        .agg(*[F.max(first & test).alias(name) for name, test in tests.items()], structured.top_lines().alias("top"))
    )
    seen = seen.withColumn("format", format_of(F.col("file"), list(tests)))
    return seen.select("file", "format", *structured.header_columns(F.col("top")))


def _entry(kind: Column, logged_at=None, level=None, message=None, is_bad=None) -> Column:
    values = {"kind": kind, "logged_at": logged_at, "level": level, "message": message}
    fields = [(F.lit(None) if v is None else v).cast("string").alias(name) for name, v in values.items()]
    return F.struct(*fields, (F.lit(False) if is_bad is None else is_bad).alias("is_bad"))


def _json_entry(line: Column) -> Column:
    def entry(document: Column) -> Column:
        logged_at, level, message, kind = structured.entry_columns(document, line)[:4]
        return _entry(kind, logged_at, level, message, document.isNull())

    return T.let(F.try_parse_json(line), entry)


def _text_entry(line: Column) -> Column:
    return _entry(logs.line_kind(line), T.first(line, logs.TIMESTAMP, 1), F.upper(T.first(line, logs.LEVEL, 1)), line)


def _tool_entries(parser, line: Column) -> Column:
    return F.transform(F.array_compact(F.array(*parser(line))), lambda e: _entry(e["kind"], message=line))


def parse_table(lines: DataFrame, hint: str | None = None) -> DataFrame:
    """Events of a line table: each line goes to the parser of its file's format.

    The lines are read for the few that decide the formats, and once for all parsers of single lines (from a written copy, if a
    format needs more readings), which sit in one projection behind the format. The facts per file are a small table, which AQE
    broadcasts; if it is not, the join on the file splits skewed files. Formats whose entries go over lines are read besides, where a
    file has them: CSV records are put together where they have several lines, ``.json`` files that are one document are cut into the elements of
    their list, and XML documents are read whole. Any other JSON is read line by line.
    """
    line, form = F.col("raw_line"), F.col("format")
    if hint == "crash":
        rows = logs.crash_traces(lines)
        return _common(rows, F.lit("crash"), kind=F.lit("crash_start"), line_number=F.col("crash_line"))
    facts = file_facts(lines)
    if hint:
        facts = facts.withColumn("format", F.lit(hint))
    facts = written(facts, "facts")
    whole_json = (form == "json") & (extension(F.col("file")) == "json")
    kinds = facts.agg(F.collect_set("format").alias("formats"), F.max(whole_json).alias("whole_json")).first()  # formats are few
    joined = lines.join(facts, "file")
    if kinds["whole_json"] or {"csv", "xml"} & set(kinds["formats"]):
        # Entries over lines take several readings: the numbered lines are written once.
        joined = written(joined.select(*lines.columns, "format", "delimiter"), "lines")
    parsed = []
    if "csv" in kinds["formats"]:
        parsed.append(parse_csv_lines(joined.filter(form == "csv").select("file", "line_number", "raw_line", "delimiter")))
    if "xml" in kinds["formats"]:
        texts = F.array_sort(F.collect_list(F.struct("line_number", "raw_line")))
        documents = joined.filter(form == "xml").groupBy("file").agg(F.array_join(F.transform(texts, lambda r: r["raw_line"]), "\n").alias("content"))
        parsed.append(parse_xml_table(documents))
    stripped = joined.filter(~form.isin("xml", "csv")).withColumn("raw_line", T.strip(line))
    if kinds["whole_json"]:
        entries = written(structured.json_file_entries(joined.filter(whole_json).select("file", "line_number", "raw_line")), "documents")
        parsed.append(_common(entries.filter("not is_empty"), F.lit("json"), is_bad=F.lit(False)))
        stripped = stripped.join(written(entries.select("file").distinct(), "whole-files"), "file", "left_anti")
    used = line != ""
    entries = F.when((form == "json") & used, F.array(_json_entry(line)))
    for tool, parser in logs.LINE_PARSERS.items():
        entries = entries.when(form == tool, _tool_entries(parser, line))
    entries = entries.when((form == "text") & used, F.array(_text_entry(line)))
    rows = stripped.select("file", "line_number", "format", F.explode(entries).alias("e"))
    out = _common(rows.select("file", "line_number", "format", "e.*"), form)
    for other in parsed:
        out = out.unionByName(other)
    return out


def parse_csv_lines(lines: DataFrame) -> DataFrame:
    """One entry per CSV record of ``lines`` with the file's ``delimiter``; a record too long to be put together is a bad row."""
    rows = structured.csv_record_rows(structured.csv_records(lines))
    return _common(rows, F.lit("csv"), kind=F.lit("csv_row"), message=F.col("raw_line"))


def parse_json_table(documents: DataFrame) -> DataFrame:
    """Entries of whole JSON documents; none of texts that are no one document."""
    return _common(structured.json_documents(documents.filter(_one_document(F.col("content")))), F.lit("json"))


def _one_document(content: Column) -> Column:
    """Whether a text is one JSON document and not one per line (the parser passes over what follows the first)."""
    used = F.regexp_replace(content, r"^\s+|\s+$", "")
    first = F.try_parse_json(F.regexp_extract(used, r"^[^\n]*", 0))
    return F.try_parse_json(used).isNotNull() & (~used.contains("\n") | first.isNull())


def parse_xml_table(documents: DataFrame) -> DataFrame:
    """Entries of whole XML documents by their root element, and one bad row for each that is not well formed.

    Roots other than test suites and coverage give one row with the root's name.
    """
    rooted = documents.withColumn("root", structured.xml_root(F.col("content")))
    # A document is put together and parsed for all its readers once.
    rooted = written(rooted.withColumn("sound", structured.well_formed(F.col("content"))), "xml")
    suite, coverage = F.col("root").isin("testsuites", "testsuite"), F.col("root") == "coverage"
    suites = structured.junit_cases(rooted.filter(F.col("sound") & suite))
    classes = structured.coverage_classes(rooted.filter(F.col("sound") & coverage))
    others = rooted.filter(F.col("sound") & ~suite & ~coverage)
    good = F.lit(False)
    rows = [
        _common(suites, F.lit("xml"), kind=F.lit("test_case"), message=F.col("name"), level=F.col("status"), is_bad=good),
        _common(classes, F.lit("xml"), kind=F.lit("coverage"), message=F.col("class"), is_bad=good),
        _common(others, F.lit("xml"), kind=F.lit("xml_data"), message=F.col("root"), is_bad=good),
        _common(rooted.filter(~F.col("sound")), F.lit("xml"), is_bad=F.lit(True)),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def parse_folder(spark: SparkSession, path: str, glob: str | None = None, hint: str | None = None) -> DataFrame:
    return parse_table(numbered_lines(spark, path, glob), hint)


def file_totals(events: DataFrame) -> DataFrame:
    """Entries and errors per file."""
    bad = F.coalesce("is_bad", F.lit(False))
    return events.groupBy("file", "format").agg(
        F.count_if(~bad).alias("parsed_entries"),
        F.count_if(bad).alias("errors"),
        F.count_if(F.col("kind") == "crash").alias("crash_events"),
        F.count_if(F.col("kind") == "llm_interaction").alias("model_events"),
    )


def analyze_folder(spark: SparkSession, path: str, out: str, glob: str = "*.log") -> DataFrame:
    """Parse all matching files, write per-file totals to ``out``, return the grand totals."""
    file_totals(parse_folder(spark, path, glob)).write.json(out)
    written = spark.read.schema("file STRING, format STRING, parsed_entries BIGINT, errors BIGINT, crash_events BIGINT, model_events BIGINT").json(out)
    return written.groupBy("format").agg(
        F.count("*").alias("files"), F.sum("parsed_entries").alias("total_entries"), F.sum("errors").alias("total_errors")
    )
