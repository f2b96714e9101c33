"""JSON, XML and CSV logs. Input is a line table or a table of whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

MODEL_FIELDS = ["model", "provider", "tokens", "cost", "prompt", "response", "prompt_tokens", "completion_tokens", "total_tokens"]
CRASH_FIELDS = ["signal", "exit_code", "stack_trace", "address", "instruction"]


#: Lines of a run: what is known of a run before it is read is one row.
RUN_LINES = 1024


def _run(line_number: Column) -> Column:
    return F.floor((line_number - 1) / RUN_LINES).cast("bigint")


# -- JSON ------------------------------------------------------------------------


def field(document: Column, *names: str, kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(document, f"$.{name}", kind) for name in names])


def has_field(document: Column, *names: str) -> Column:
    test = F.try_variant_get(document, f"$.{names[0]}", "variant").isNotNull()
    for name in names[1:]:
        test = test | F.try_variant_get(document, f"$.{name}", "variant").isNotNull()
    return test


def entry_columns(document: Column, raw: Column) -> list[Column]:
    """Time, level, message and kind of a JSON entry; the last kind that holds wins."""
    low = F.lower(raw)
    crash, model = T.has(low, "crash", "segfault"), has_field(document, "llm", "model")
    kind = F.when(has_field(document, "exec", "execution"), "execution").when(crash, "crash").when(model, "llm_interaction")
    return [
        field(document, "timestamp", "time").alias("logged_at"),
        field(document, "level", "severity").alias("level"),
        field(document, "message", "msg").alias("message"),
        kind.alias("kind"),
        F.when(model, F.struct(*[field(document, name).alias(name) for name in MODEL_FIELDS])).alias("model_data"),
        F.when(crash, F.struct(*[field(document, name).alias(name) for name in CRASH_FIELDS])).alias("crash_data"),
    ]


def json_lines(lines: DataFrame) -> DataFrame:
    """One row per non-blank line; ``is_bad`` marks lines that are no JSON."""
    line = T.strip(F.col("raw_line"))
    parsed = lines.withColumn("raw_line", line).filter(F.col("raw_line") != "")
    parsed = parsed.withColumn("document", F.try_parse_json("raw_line"))
    return parsed.select(
        "file", "line_number", F.col("document").isNull().alias("is_bad"), *entry_columns(F.col("document"), F.col("raw_line"))
    )


def json_documents(documents: DataFrame) -> DataFrame:
    """One row per entry of documents that hold one object or a list of objects."""
    document = F.try_parse_json("content")
    entries = F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.array(document))
    rows = documents.select("file", F.posexplode(entries).alias("entry", "document"))
    rows = rows.withColumn("raw", F.to_json("document"))
    return rows.select(
        "file", "entry", F.col("document").isNull().alias("is_bad"), *entry_columns(F.col("document"), F.col("raw"))
    )


_STRING = r'"(?:[^"\\\\]++|\\\\.)*+"?'


def _depth_change(line: Column) -> Column:
    """Brackets that a line opens less those it closes; JSON strings do not go over lines."""
    bare = F.regexp_replace(line, _STRING, "")
    opened, closed = (F.length(bare) - F.length(F.translate(bare, marks, "")) for marks in ("[{", "]}"))
    return (opened - closed).cast("bigint")


_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"?')
_BRACKETS = np.zeros(256, dtype=np.int64)
_BRACKETS[[ord("["), ord("{")]], _BRACKETS[[ord("]"), ord("}")]] = 1, -1


def _sums(marks: np.ndarray) -> np.ndarray:
    """Marks before each place."""
    return np.concatenate(([0], np.cumsum(marks)))


def _cut_lines(lines: list[str], is_list: bool, depth: int, piece: int) -> tuple[list, int, int]:
    """Columns of the parts of consecutive lines, and the depth and the commas behind them. The lines are one array of bytes."""
    hidden = [_JSON_STRING.sub(lambda m: "x" * len(m[0].encode()), line).encode() for line in lines]
    bare = np.frombuffer(b"".join(hidden), dtype=np.uint8)
    ends = np.cumsum([len(h) for h in hidden])
    starts = np.concatenate(([0], ends[:-1]))
    after = depth + np.cumsum(_BRACKETS[bare])
    before = after - _BRACKETS[bare]
    blank, comma = np.isin(bare, (0x20, 0x09, 0x0D)), bare == ord(",")
    own = (np.minimum(before, after) == 0) & (before != after)
    bad = ((before <= 0) & (after <= 0) & ~blank) | (after < 0)
    cuts, text = np.zeros(0, np.int64), np.frombuffer("".join(lines).encode(), dtype=np.uint8).copy()
    if is_list:
        # The list's own brackets are no part of an element.
        cuts, text[own] = np.flatnonzero(comma & (before == 1)), 0x20
        bad |= own & ~np.isin(bare, (ord("["), ord("]")))
    # The part that a cut ends has as many parts before it as there are cuts and lines before the cut.
    owner = np.searchsorted(ends, cuts, side="right")
    counts = np.bincount(owner, minlength=len(lines))
    line = np.repeat(np.arange(len(lines)), counts + 1)
    first = np.arange(len(lines)) + np.cumsum(counts) - counts
    place = np.arange(len(line))
    begin, end = np.empty(len(line), np.int64), np.empty(len(line), np.int64)
    begin[first], end[first + counts] = starts, ends
    ended = np.arange(len(cuts)) + owner
    begin[ended + 1], end[ended] = cuts + 1, cuts
    part = place - first[line]
    bads, lists = _sums(bad), _sums(own & (after == 1))
    wrong, opened = bads[ends] > bads[starts], lists[ends] - lists[starts]
    values = np.zeros(len(line), np.int64)
    if is_list:
        inner, loose = _sums((before == 1) & (after == 2)), _sums((before == 1) & (after == 1) & ~blank & ~comma)
        values = inner[end] - inner[begin] + (loose[end] > loose[begin])
    whole = text.tobytes()
    content = [whole[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]
    columns = [line, part, piece + place - line, content, wrong[line], np.where(part == 0, opened[line], 0), values]
    return columns, int(after[-1]) if len(after) else depth, piece + len(cuts)


def _cut_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of runs at the commas of the outermost list; ``piece`` counts these commas in a run."""
    names = ["file", "run", "line_number", "part", "piece", "content", "wrong", "lists", "values"]
    at, depth, piece = None, 0, 0
    for batch in batches:
        rows = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        keys, stop = list(zip(rows["file"], rows["run"])), 0
        for key, same in groupby(keys):
            start, stop = stop, stop + len(list(same))
            if at != key:
                at, depth, piece = key, rows["depth"][start], 0
            (line, *columns), depth, piece = _cut_lines(rows["raw_line"][start:stop], rows["is_list"][start], depth, piece)
            numbers = np.asarray(rows["line_number"][start:stop])[line]
            columns = [[key[0]] * len(line), [key[1]] * len(line), numbers, *columns]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)


def json_file_entries(lines: DataFrame) -> DataFrame:
    """Entries (file, entry, and as in ``json_documents``) of the files that hold one JSON document, from their lines.

    A file is one document if its first line that is not blank is no JSON or the only one, and the whole of it is JSON; other files give no
    rows. A list of any length is cut into its elements by many tasks: the depth that a run of lines begins at is the sum of the
    brackets before it, so only elements are ever put together, and numbers of runs say which element of the file a run begins in.
    """
    used = T.strip(F.col("raw_line")) != ""
    first = F.min(F.when(used, F.struct("line_number", "raw_line")))
    facts = lines.groupBy("file").agg(first.alias("first"), F.count_if(used).alias("used"))
    alone = F.try_parse_json(T.strip(F.col("first.raw_line"))).isNotNull()
    facts = facts.filter((F.col("used") > 0) & ((F.col("used") == 1) | ~alone))
    facts = written(facts.select("file", T.strip(F.col("first.raw_line")).startswith("[").alias("is_list")), "documents")
    own = lines.withColumn("run", _run(F.col("line_number"))).join(facts, "file")

    runs = own.groupBy("file", "run").agg(F.sum(_depth_change(F.col("raw_line"))).alias("change"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))), "depths")
    dealt = own.join(runs.select("file", "run", "depth"), ["file", "run"]).repartition("file", "run")
    ordered = dealt.select("file", "run", "line_number", "raw_line", "is_list", "depth").sortWithinPartitions("file", "run", "line_number")
    parts = ordered.mapInArrow(
        _cut_elements, "file string, run bigint, line_number bigint, part bigint, piece bigint, content string, wrong boolean, lists bigint, values bigint"
    )
    parts = written(parts, "elements")
    offsets = parts.groupBy("file", "run").agg(F.max("piece").alias("cuts"))
    offsets = offsets.select("file", "run", F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("offset"))
    text = F.array_sort(F.collect_list(F.struct("line_number", "part", "content")))
    elements = (
        parts.join(offsets, ["file", "run"])
        .groupBy("file", (F.col("offset") + F.col("piece")).cast("int").alias("entry"))
        .agg(F.array_join(F.transform(text, lambda r: r["content"]), "\n").alias("content"), F.max("wrong").alias("wrong"), F.sum("lists").alias("lists"), F.sum("values").alias("values"))
    )
    # Two values without a comma between them are no element.
    elements = elements.withColumn("wrong", F.col("wrong") | (F.col("values") > 1))
    content = T.strip(F.col("content"))
    elements = written(elements.select("file", "entry", content.alias("content"), "wrong", "lists"), "entries")
    document = F.try_parse_json("content")
    blank = F.col("content") == ""
    whole = elements.groupBy("file").agg(
        F.max("entry").alias("last"), F.sum("lists").alias("lists"), F.max(F.col("wrong") | document.isNull()).alias("wrong"), F.max(blank).alias("blank")
    )
    depth = runs.groupBy("file").agg(F.sum("change").alias("depth"))
    empty = F.col("blank") & (F.col("last") == 0)  # a list without elements
    closed = (F.col("depth") == 0) & (F.col("lists") == 1)  # one list or object, and nothing left open
    good = written(whole.join(depth, "file").filter(closed & (~F.col("wrong") | empty)).select("file"), "sound")
    rows = elements.join(good, "file").select("file", "entry", F.when(~blank, document).alias("document"))
    # A file without entries leaves a row without a document.
    return rows.select(
        "file", "entry", F.col("document").isNull().alias("is_empty"), *entry_columns(F.col("document"), F.to_json("document"))
    )


# -- XML -------------------------------------------------------------------------

_NOTE = "STRUCT<_message STRING, _VALUE STRING>"
CASE = f"_name STRING, _classname STRING, _time DOUBLE, failure {_NOTE}, error {_NOTE}"
_LINE = "STRUCT<_number BIGINT, _hits BIGINT, _branch STRING>"
CLASS = f"_name STRING, _filename STRING, `_line-rate` DOUBLE, `_branch-rate` DOUBLE, lines STRUCT<line ARRAY<{_LINE}>>"

# Possessive, so that a tag of any length is read once, forward.
_ATTRIBUTES = r"""\b[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+"""
_PREFIX = r"(?:[\w.-]+:)?"


def well_formed(content: Column) -> Column:
    """Whether a text is one XML document."""
    read = F.from_xml(content, "_none STRING, _corrupt_record STRING")
    return F.coalesce(read.isNotNull() & read["_corrupt_record"].isNull(), F.lit(False))


def _inside(documents: DataFrame, outer: str, inner: str) -> DataFrame:
    """Each ``inner`` element of well-formed documents with the start tag of the ``outer`` element right around it.

    Elements may stand at any depth. Start and end tags of the outer element become rows; the running
    count of them is the depth, and the last start tag of an element's depth is the one around it.
    """
    start, end = f"<{_PREFIX}{outer}{_ATTRIBUTES}>", f"</{_PREFIX}{outer}\\s*+>"
    whole = f"<{_PREFIX}{inner}{_ATTRIBUTES}(?:(?<=/)>|>(?s:.*?)</{_PREFIX}{inner}\\s*+>)"
    bare = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(bare, F.lit(f"{start}|{end}|{whole}"), F.lit(0))
    sound = documents.filter(well_formed(F.col("content")))
    rows = sound.select("file", F.posexplode(tags).alias("at", "tag"))
    opens = F.col("tag").rlike(f"^<{_PREFIX}{outer}\\b") & ~F.col("tag").endswith("/>")
    closes = F.col("tag").startswith("</")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("opens", opens).withColumn(
        "depth", F.sum(F.when(F.col("opens"), 1).when(closes, -1).otherwise(0)).over(before)
    )
    level = Window.partitionBy("file", "depth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    around = F.last(F.when(F.col("opens"), F.col("tag")), ignorenulls=True).over(level)
    return rows.withColumn("around", around).filter(F.col("tag").rlike(f"^<{_PREFIX}{inner}\\b")).select("file", "around", "tag")


def _name_of(tag: Column) -> Column:
    return F.coalesce(F.from_xml(F.concat(F.substring(tag, F.lit(1), F.length(tag) - 1), F.lit("/>")), "_name STRING")["_name"], F.lit("unknown"))


def junit_cases(documents: DataFrame) -> DataFrame:
    """Test cases of JUnit documents with their suite, suites nested to any depth; malformed documents give none."""
    rows = _inside(documents, "testsuite", "testcase").filter("around is not null")
    rows = rows.select("file", _name_of(F.col("around")).alias("suite"), F.from_xml("tag", CASE).alias("c")).select("file", "suite", "c.*")
    failed, broken = F.col("failure").isNotNull(), F.col("error").isNotNull()
    return rows.select(
        "file",
        "suite",
        F.col("_name").alias("name"),
        F.col("_classname").alias("classname"),
        F.coalesce("_time", F.lit(0.0)).alias("time"),
        F.when(failed, "failed").when(broken, "error").otherwise("passed").alias("status"),
        F.when(failed, F.col("failure._message")).otherwise(F.col("error._message")).alias("problem_message"),
        F.when(failed, F.col("failure._VALUE")).otherwise(F.col("error._VALUE")).alias("problem_text"),
    )


def coverage_classes(documents: DataFrame) -> DataFrame:
    """Classes of coverage documents with their rates and line entries, packages at any depth."""
    rows = _inside(documents, "package", "class").filter("around is not null")
    classes = rows.select("file", _name_of(F.col("around")).alias("package"), F.from_xml("tag", CLASS).alias("c"))
    return classes.select(
        "file",
        "package",
        F.col("c._name").alias("class"),
        F.col("c._filename").alias("filename"),
        F.coalesce(F.col("c.`_line-rate`"), F.lit(0.0)).alias("line_rate"),
        F.coalesce(F.col("c.`_branch-rate`"), F.lit(0.0)).alias("branch_rate"),
        F.transform(
            "c.lines.line",
            lambda line: F.struct(
                line["_number"].alias("number"),
                F.coalesce(line["_hits"], F.lit(0)).alias("hits"),
                (F.coalesce(line["_branch"], F.lit("")) == "true").alias("branch"),
            ),
        ).alias("lines"),
    )


def xml_documents(documents: DataFrame) -> DataFrame:
    """Any other XML: its root name and a VARIANT of its content, NULL where it is not well formed."""
    sound, root = well_formed(F.col("content")), xml_root(F.col("content")).alias("root")
    read = documents.filter(sound).select("file", root, F.from_xml("content", "VARIANT").alias("data"))
    return read.unionByName(documents.filter(~sound).select("file", root, F.lit(None).cast("variant").alias("data")))


def xml_root(content: Column) -> Column:
    """Name of the root element, which decides how a document is read."""
    bare = F.regexp_replace(content, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", "")
    return F.regexp_extract(bare, r"<(?:[\w.-]+:)?([\w.-]+)", 1)


# -- CSV -------------------------------------------------------------------------

TIME_NAMES, LEVEL_NAMES = ["timestamp", "time", "date"], ["level", "severity", "type"]
SAMPLE_CHARS = 1024


def delimiter_of(sample: Column) -> Column:
    return F.when(sample.contains("\t"), "\t").when(sample.contains(";"), ";").otherwise(",")


#: What stands between the quotes of a cell: two quotes are one.
_QUOTED = '(?:[^"]++|"")*+'


def cells(line: Column, delimiter: Column) -> Column:
    """Cells of a CSV record. A cell that begins with a quote goes to the quote that ends it, delimiters and line
    breaks included; quotes elsewhere are as written. One forward pass, however many cells."""

    def cut(mark: str) -> Column:
        cell = f'{mark}("{_QUOTED}(?:"[^{mark}]*+)?+|[^{mark}]*+)'
        return F.regexp_extract_all(F.concat(F.lit(mark), line), F.lit(cell), F.lit(1))

    raw = F.when(delimiter == "\t", cut("\t")).when(delimiter == ";", cut(";")).otherwise(cut(","))
    whole = f'(?s)^"({_QUOTED})(?:"(.*+))?+\\z'
    return F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"'), F.concat(F.replace(F.regexp_extract(c, whole, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, whole, 2))
        ).otherwise(c),
    )


def _by_delimiter(test, delimiter: Column) -> Column:
    return F.when(delimiter == "\t", test("\t")).when(delimiter == ";", test(";")).otherwise(test(","))


def opens_cell(line: Column, delimiter: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell."""
    return _by_delimiter(lambda mark: line.rlike("^" + _left_open(mark)), delimiter)


def closes_record(line: Column, delimiter: Column) -> Column:
    """Whether a line that begins inside a quoted cell ends the record."""
    ended = line.rlike(f'^{_QUOTED}"')
    return ended & ~_by_delimiter(lambda mark: line.rlike(f'^{_QUOTED}"[^{mark}]*+{mark}{_left_open(mark)}'), delimiter)


def _left_open(mark: str) -> str:
    return f'(?:(?:"{_QUOTED}"[^{mark}]*+|(?!")[^{mark}]*+){mark})*+"{_QUOTED}\\z'


#: The longest record that is put together, in lines and characters. A longer one is a bad row.
RECORD_LINES, RECORD_CHARS = 100_000, 4_000_000
#: Lines that look for their record among the same few records.
BLOCK_LINES = 32


def _block(line_number: Column) -> Column:
    return F.floor((line_number - 1) / BLOCK_LINES).cast("bigint")


def _state(value: Column, flips: Column, last: Column) -> Column:
    """Inside a quoted cell or not: what the last line that decides alone said, turned by each flip since."""
    since = flips - F.coalesce(last["flips"], F.lit(0))
    return (F.coalesce(last["value"], value).cast("int") + since) % 2 == 1


def record_spans(lines: DataFrame) -> DataFrame:
    """(file, first_line, last_line) of the CSV records of several lines; ``lines`` has file, line_number, raw_line and delimiter.

    What a line does is a function of one bit, whether it begins inside a quoted cell, so lines compose like numbers add: inside a run
    of line numbers by a window, and between runs by one row each. Only numbers of lines with quotes are
    shuffled, so a file of any size is read by many tasks, and however it is split the borders are the same.
    """
    line, delimiter = F.col("raw_line"), F.col("delimiter")
    marks = lines.filter(line.contains('"')).select(
        "file", "line_number", opens_cell(line, delimiter).alias("opens"), closes_record(line, delimiter).alias("closes")
    )
    # Begins a record and ends open / begins open and ends the record: a line may do one, both (a flip), or none.
    marks = marks.filter("opens or closes").withColumn("run", _run(F.col("line_number")))
    marks = marks.withColumn("flip", (F.col("opens") & F.col("closes")).cast("int"))
    inside = Window.partitionBy("file", "run").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("flips", F.sum("flip").over(inside))
    alone = F.when(F.col("flip") == 0, F.struct(F.col("opens").alias("value"), "flips"))
    # Numbers only: written, so that the lines are read for them once.
    marks = written(marks.withColumn("last", F.last(alone, ignorenulls=True).over(inside)), "marks")

    whole = marks.groupBy("file", "run").agg(F.max_by(F.struct("flips", "last"), "line_number").alias("end"))
    between = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("end.last").isNull(), F.col("end.flips")).otherwise(0)
    whole = whole.withColumn("flips", F.sum(turns).over(between)).withColumn("own", turns)
    ended = _state(F.lit(False), F.col("end.flips"), F.col("end.last"))
    decided = F.when(F.col("end.last").isNotNull(), F.struct(ended.alias("value"), (F.coalesce("flips", F.lit(0))).alias("flips")))
    entered = whole.withColumn("last", F.last(decided, ignorenulls=True).over(between))
    entered = entered.select("file", "run", _state(F.lit(False), F.coalesce("flips", F.lit(0)), F.col("last")).alias("entered"))

    marks = marks.join(entered, ["file", "run"])
    after = _state(F.col("entered"), F.col("flips"), F.col("last"))
    earlier = Window.partitionBy("file", "run").orderBy("line_number")
    marks = marks.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(earlier), F.col("entered")))
    edges = written(marks.filter(F.col("before") != F.col("after")).select("file", "run", "line_number", F.col("after").alias("begins")), "edges")
    # Beginnings and ends take turns: an end belongs to the last beginning, in its run or in one before.
    begin = F.when(F.col("begins"), F.col("line_number"))
    carried = (
        edges.groupBy("file", "run").agg(F.max(begin).alias("latest")).select("file", "run", F.last("latest", ignorenulls=True).over(between).alias("carried"))
    )
    edges = edges.withColumn("latest", F.last(begin, ignorenulls=True).over(inside)).join(carried, ["file", "run"])
    first = F.coalesce("latest", "carried")
    spans = edges.filter("not begins").select("file", first.alias("first_line"), F.col("line_number").alias("last_line"))
    # A quote that nothing ends runs to the end of its file.
    begun = edges.filter("begins").groupBy("file").agg(F.max("line_number").alias("first_line"))
    done = edges.filter("not begins").groupBy("file").agg(F.max("line_number").alias("ended"))
    left = begun.join(done, "file", "left").filter(F.col("ended").isNull() | (F.col("ended") < F.col("first_line"))).select("file", "first_line")
    left = written(left, "left-open")
    if left.isEmpty():
        return spans
    length = lines.groupBy("file").agg(F.max("line_number").alias("last_line"))
    return spans.unionByName(left.join(length, "file").select("file", "first_line", "last_line"))


def csv_records(lines: DataFrame) -> DataFrame:
    """``lines`` (file, line_number, raw_line, delimiter and any others of the file) with one row per CSV record.

    ``line_number`` is the record's first line; ``is_bad`` marks records longer than RECORD_LINES or RECORD_CHARS, which are not
    put together. The lines are read for the quotes and for the records, so a caller writes what is dear to compute.
    """
    spans = written(record_spans(lines), "spans")
    span = F.struct("first_line", "last_line")
    blocks = F.explode(F.sequence(_block(F.col("first_line")), _block(F.col("last_line"))))
    by_block = spans.select("file", "first_line", "last_line", blocks.alias("block")).groupBy("file", "block").agg(F.collect_list(span).alias("spans"))
    number = F.col("line_number")
    mine = F.filter("spans", lambda s: (s["first_line"] <= number) & (number <= s["last_line"]))
    placed = lines.withColumn("block", _block(number)).join(by_block, ["file", "block"], "left")
    placed = placed.withColumn("span", F.get(mine, F.lit(0))).drop("block", "spans")
    placed = written(placed, "placed")
    whole = placed.filter("span is null").drop("span").withColumn("is_bad", F.lit(False))

    others = [c for c in lines.columns if c not in ("file", "line_number", "raw_line")]
    parts = placed.filter("span is not null").select("file", "span", "line_number", "raw_line", *others)
    sizes = parts.groupBy("file", "span").agg((F.sum(F.length("raw_line")) + F.count("*")).alias("chars"))
    too_long = (F.col("chars") > RECORD_CHARS) | (F.col("span.last_line") - F.col("span.first_line") >= RECORD_LINES)
    # Few or none: written, so that its size is known and the text is shuffled once.
    bad = written(sizes.filter(too_long).select("file", "span", F.lit(True).alias("is_bad")), "long-records")
    kept = parts.join(bad, ["file", "span"], "left").withColumn("is_bad", F.coalesce("is_bad", F.lit(False)))
    kept = kept.filter(~F.col("is_bad") | (number == F.col("span.first_line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "raw_line"))), lambda r: r["raw_line"]), "\n")
    joined = kept.groupBy("file", "span", "is_bad").agg(text.alias("raw_line"), *[F.first(c).alias(c) for c in others])
    return whole.unionByName(joined.withColumn("line_number", F.col("span.first_line")).drop("span"))


def top_lines() -> Column:
    """Aggregate: a file's first lines in order, the first one whole and of the others what the sample can use."""
    line = F.when(F.col("line_number") == 1, F.col("raw_line")).otherwise(F.substring("raw_line", 1, SAMPLE_CHARS))
    return F.array_sort(F.collect_list(F.struct("line_number", line.alias("raw_line"))))


def header_columns(top: Column) -> list[Column]:
    """Delimiter and column names from the first lines."""
    sample = F.substring(F.array_join(F.transform(top, lambda r: r["raw_line"]), "\n"), 1, SAMPLE_CHARS)
    delimiter = delimiter_of(sample)
    return [delimiter.alias("delimiter"), cells(F.get(top, F.lit(0))["raw_line"], delimiter).alias("names")]


def csv_delimiters(lines: DataFrame) -> DataFrame:
    """Delimiter per file. A line has a character or more, so the first ``SAMPLE_CHARS`` lines hold the sample."""
    top = lines.filter(F.col("line_number") <= SAMPLE_CHARS).groupBy("file").agg(top_lines().alias("top"))
    return top.select("file", header_columns(F.col("top"))[0])


def first_named(names: Column, values: Column, wanted: list[str]) -> Column:
    """Value of the first wanted column the header has."""
    out = F.lit(None).cast("string")
    for name in reversed(wanted):
        at = F.array_position(names, name)
        out = F.when(at > 0, F.get(values, (at - 1).cast("int"))).otherwise(out)
    return out


def csv_rows(lines: DataFrame) -> DataFrame:
    """Rows of CSV files as maps, with the first time-like and level-like column; ``line_number`` is a row's first line.

    Files differ in header and delimiter, so each line meets its file's in a join
    on the file with a table that is written, whose size says whether it is broadcast. A quoted cell may go over any number of lines.
    Records too long to be put together have null data.
    """
    delimiters = written(csv_delimiters(lines), "delimiters")
    delimited = written(lines.select("file", "line_number", "raw_line").join(delimiters, "file"), "lines")
    return csv_record_rows(csv_records(delimited)).select("file", "line_number", "data", "logged_at", "level")


def csv_record_rows(records: DataFrame) -> DataFrame:
    """``csv_records`` behind the first one of each file, with its cells under the names that stands for."""
    header = records.filter(F.col("line_number") == 1).select("file", cells(F.col("raw_line"), F.col("delimiter")).alias("names"))
    header = written(header, "headers")
    body = records.filter((F.col("line_number") > 1) & (F.col("raw_line") != "")).join(header, "file")
    joined = body.withColumn("values", F.when(~F.col("is_bad"), cells(F.col("raw_line"), F.col("delimiter"))))
    named = F.map_from_arrays("names", F.transform("names", lambda _, i: F.get("values", i)))
    names, values = F.col("names"), F.col("values")
    return joined.select(
        "file",
        "line_number",
        "raw_line",
        "is_bad",
        F.when(~F.col("is_bad"), named).alias("data"),
        first_named(names, values, TIME_NAMES).alias("logged_at"),
        first_named(names, values, LEVEL_NAMES).alias("level"),
    )
