from __future__ import annotations

import gzip
import json
import time

from pyspark.sql import functions as F

from trialscope.operators import projects
from trialscope.plans import log_analysis
from trialscope.sources import entities, structured, text


def lines(spark, **files):
    rows = [(f.replace("_", "."), i, t) for f, ts in files.items() for i, t in enumerate(ts, 1)]
    return spark.createDataFrame(rows, "file string, line_number bigint, raw_line string")


def test_formats(spark):
    df = lines(
        spark, a=["", '  {"x": 1}'], b=["<?xml?>"], c=["a,b,c,d"], d=["American Fuzzy Lop"], e=["plain"], f_csv=["x"], g_jsonl=["y"],
        h=["1", "2", "3", "4", "5", "{late"], i=["a,b,c"], j=["INFO: libFuzzer"],
    )
    got = {r["file"]: r["format"] for r in text.detect_formats(df).collect()}
    assert got == {"a": "json", "b": "xml", "c": "csv", "d": "afl", "e": "text", "f.csv": "csv", "g.jsonl": "json", "h": "text", "i": "text", "j": "libfuzzer"}


def test_json_entries(spark):
    df = lines(spark, f=['{"time":"t1","severity":"WARN","msg":"m","model":"x"}', "broken{", "", '{"timestamp":"t2","llm":1,"message":"segfault"}', '{"exec":1,"msg":"crash"}', '{"level":null}'])
    rows = {r["line_number"]: r for r in structured.json_lines(df).collect()}
    assert sorted(rows) == [1, 2, 4, 5, 6]
    assert (rows[1]["logged_at"], rows[1]["level"], rows[1]["message"], rows[1]["kind"]) == ("t1", "WARN", "m", "llm_interaction")
    assert rows[2]["is_bad"] and not rows[1]["is_bad"]
    assert [rows[i]["kind"] for i in (4, 5, 6)] == ["crash", "execution", None]
    assert rows[1]["model_data"]["model"] == "x"


def test_json_documents_keep_all_entries(spark):
    df = spark.createDataFrame([("a", '[{"msg":"1"},{"msg":"2"}]'), ("b", '{"msg":"3"}'), ("c", "nope")], "file string, content string")
    rows = structured.json_documents(df).orderBy("file", "entry").collect()
    assert [(r["file"], r["message"], r["is_bad"]) for r in rows] == [("a", "1", False), ("a", "2", False), ("b", "3", False), ("c", None, True)]


def test_junit(spark):
    nested = '<testsuites><testsuite name="o"><testcase name="a" time="1.5"/><testsuite name="i"><testcase name="b"><failure message="m">t</failure></testcase></testsuite></testsuite></testsuites>'
    root = '<testsuite><testcase name="c"><error message="e"/></testcase></testsuite>'
    df = spark.createDataFrame([("n", nested), ("r", root), ("bad", "<testsuite><oops")], "file string, content string")
    rows = structured.junit_cases(df).orderBy("name").collect()
    assert [(r["suite"], r["name"], r["time"], r["status"], r["problem_message"]) for r in rows] == [
        ("o", "a", 1.5, "passed", None), ("i", "b", 0.0, "failed", "m"), ("unknown", "c", 0.0, "error", "e"),
    ]


def test_junit_at_any_depth(spark):
    deep = "<testsuites>" + "".join(f'<t:testsuite name="s{i}&amp;" xmlns:t="u"><!-- <testcase name="no"/> --><testcase name="c{i}" note="a>b"/>' for i in range(6))
    deep += '</t:testsuite>' * 3 + '<testcase name="last"><error message="m"><![CDATA[<x>]]></error></testcase><testsuite name="e"/>' + "</t:testsuite>" * 3 + "</testsuites>"
    rows = structured.junit_cases(spark.createDataFrame([("f", deep)], "file string, content string")).collect()
    assert sorted((r["name"], r["suite"]) for r in rows) == [*((f"c{i}", f"s{i}&") for i in range(6)), ("last", "s2&")]


def test_csv_of_many_cells_is_linear(spark):
    line = ",".join('"a, ""b"""' for _ in range(50_000))
    df = spark.createDataFrame([(line,), (',"x,y",', ), ('"open, end',), ("",)], "line string")
    start = time.time()
    got = df.select(structured.cells(F.col("line"), F.lit(",")).alias("c")).collect()
    assert time.time() - start < 10
    assert got[0]["c"] == ['a, "b"'] * 50_000
    assert [r["c"] for r in got[1:]] == [["", "x,y", ""], ["open, end"], [""]]


def test_folder_with_documents(spark, tmp_path):
    """Every file gives a row: documents whole, broken ones an error."""
    (tmp_path / "a.xml").write_text('<testsuites>\n<testsuite name="s">\n<testcase name="t"/>\n</testsuite></testsuites>\n')
    (tmp_path / "b.xml").write_text('<coverage><x><package name="p"><classes><class name="C"/></classes></package></x></coverage>')
    (tmp_path / "c.xml").write_text("<other><a/>\n</other>")
    (tmp_path / "d.xml").write_text("<testsuite><oops\n")
    (tmp_path / "e.log").write_text("<?xml version='1.0'?>\n<top/>")
    (tmp_path / "f.json").write_text('[\n {"msg": "one"},\n {"msg": "two"}\n]\n')
    (tmp_path / "g.json").write_text('{"msg": "x"}\n{bad\n')
    (tmp_path / "h.jsonl").write_text('{"msg": "y"}\n')
    (tmp_path / "i.log").write_text("plain\n")
    got = {r["file"].rsplit("/", 1)[1]: (r["format"], r["parsed_entries"], r["errors"]) for r in log_analysis.file_totals(log_analysis.parse_folder(spark, str(tmp_path))).collect()}
    assert got == {
        "a.xml": ("xml", 1, 0), "b.xml": ("xml", 1, 0), "c.xml": ("xml", 1, 0), "d.xml": ("xml", 0, 1), "e.log": ("xml", 1, 0),
        "f.json": ("json", 2, 0), "g.json": ("json", 1, 1), "h.jsonl": ("json", 1, 0), "i.log": ("text", 1, 0),
    }


def test_numbering_moves_no_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = text.numbered_lines(spark, str(tmp_path))
        assert sorted(tuple(r)[1:] for r in lines.collect()) == [(i + 1, f"line {i}") for i in range(2000)]
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert not any("hashpartitioning" in part and "raw_line" in part for part in plan.split("\n"))


def test_coverage_lines(spark):
    doc = '<coverage><packages><package><classes><class name="C" line-rate="0.5"><lines><line number="3" hits="2" branch="true"/><line number="4"/></lines></class></classes></package></packages></coverage>'
    (row,) = structured.coverage_classes(spark.createDataFrame([("f", doc)], "file string, content string")).collect()
    assert (row["package"], row["class"], row["line_rate"], row["branch_rate"]) == ("unknown", "C", 0.5, 0.0)
    assert [tuple(x) for x in row["lines"]] == [(3, 2, True), (4, 0, False)]


def test_csv_delimiters_quotes_and_aliases(spark):
    df = lines(spark, tab=["date\tlevel", "d\tl"], semi=["time;severity;x", 't;s;"a;b"'], comma=["type,timestamp", 'k,"say ""hi"""', "", "short"])
    rows = {(r["file"], r["line_number"]): r for r in structured.csv_rows(df).collect()}
    assert sorted(rows) == [("comma", 2), ("comma", 4), ("semi", 2), ("tab", 2)]
    assert (rows["tab", 2]["logged_at"], rows["tab", 2]["level"]) == ("d", "l")
    assert rows["semi", 2]["data"] == {"time": "t", "severity": "s", "x": "a;b"}
    assert rows["comma", 2]["logged_at"] == 'say "hi"' and rows["comma", 4]["data"] == {"type": "short", "timestamp": None}


def test_folder_of_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_text("took 5 ms\n\ncrash\n")
    (tmp_path / "b.log").write_text('{"msg": "crash"}\n{bad\n')
    (tmp_path / "skip.txt").write_text("no")
    with gzip.open(tmp_path / "c.log.gz", "wt") as f:
        f.write("took 1 s\n")
    out = str(tmp_path / "totals")
    got = {r["format"]: tuple(r)[1:] for r in log_analysis.analyze_folder(spark, str(tmp_path), out).collect()}
    assert got == {"text": (1, 2, 0), "json": (1, 1, 1)}
    (row,) = log_analysis.parse_folder(spark, str(tmp_path), "*.gz").collect()
    assert row["message"] == "took 1 s"


def test_session_documents(spark, tmp_path):
    rows = [{"session_id": "a", "pid": 1, "start_time": "2024-01-01T10:00:00", "llm_provider": "OPENAI", "status": "completed"}, {"session_id": "b", "llm_provider": "strange", "status": "lost"}]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r["session_id"]: r for r in entities.read_sessions(spark, str(tmp_path)).collect()}
    assert got["a"]["llm_provider"] == "openai" and got["a"]["start_time"].hour == 10
    assert got["b"]["llm_provider"] == "unknown" and got["b"]["status"] == "initializing"


def test_archive_moves_old_days_only(spark, tmp_path):
    live, target = str(tmp_path / "live"), str(tmp_path / "old")
    rows = spark.createDataFrame([(f"2024-01-{d:02}", d) for d in range(1, 11)], "day string, v int")
    rows.repartition("day").write.partitionBy("day").parquet(live)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "live").glob("day=2024-01-0[89]/*.parquet")}
    (got,) = entities.archive_days(spark, live, target, "2024-01-10", 4).collect()
    assert got["files_archived"] == 5 and got["bytes_saved"] > 0 and got["errors"] == 0
    assert sorted(r["v"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["v"] for r in spark.read.parquet(live).collect()) == [6, 7, 8, 9, 10]
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items()) and kept
    (again,) = entities.archive_days(spark, live, target, "2024-01-10", 4).collect()
    assert tuple(again) == (0, 0, 0)


def test_surplus_backups(spark):
    df = spark.createDataFrame([("a", f"p{i}", i // 2) for i in range(9)] + [("b", "only", 1)], "base string, path string, mtime bigint")
    assert sorted(r["path"] for r in entities.surplus_backups(df, 5).collect()) == ["p0", "p1", "p2", "p3"]


def files(spark, *rows):
    return spark.createDataFrame([("p", path, content) for path, content in rows], "project string, path string, content string")


def test_manifests(spark):
    df = files(
        spark,
        ("pom.xml", '<project xmlns="x"><!-- <dependency><groupId>no</groupId><artifactId>no</artifactId></dependency> --><dependencies><dependency><groupId>g</groupId>\n<artifactId>a</artifactId></dependency><dependency><groupId>half</groupId></dependency></dependencies></project>'),
        ("requirements.txt", "# c\n-r x\n numpy >= 1\nscipy\n"),
        ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\n"serde" = "1"\n# c\n[dependencies.extra]\nv = 1\n[dev-dependencies]\nrand="0"'),
        ("go.mod", "require (\n  a/b v1\n // c\n)\n"),
        ("package.json", "not json"),
        ("sub/requirements.txt", "ignored"),
    )
    got = {(r["kind"], r["dependency"]) for r in projects.dependencies(df).collect()}
    assert got == {("dependencies", d) for d in ("g:a", "numpy", "scipy", "serde", "a/b")} | {("dev_dependencies", "rand")}


def test_project_profile(spark):
    df = files(spark, ("README.md", "x"), ("src/deep/a.py", "import hashlib\n\npassword = 1\n"), ("tests/test_a.py", "import pytest"), ("Makefile", ""), (".github/workflows/ci.yml", ""))
    (row,) = projects.profile(df).collect()
    assert (row["total_files"], row["total_directories"], row["total_loc"]) == (5, 5, 3)
    assert (row["primary_language"], row["supported_languages"], row["build_system"]) == ("python", ["c", "cpp", "python"], "make")
    assert (row["test_count"], row["distinct_test_files"], row["coverage_estimate"]) == (2, 1, 100.0)
    assert (row["hotspots"], row["security_frameworks"], row["annotations_count"]) == (["src/deep/a.py"], ["bcrypt"], 1)
    assert (row["quality_score"], row["maintainability_score"], row["technical_debt_ratio"]) == (7.5, 8.0, 0.0)


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime int")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "path string, mtime int")
    assert {(r["path"], r["change"]) for r in projects.snapshot_changes(old, new).collect()} == {("a", "deleted"), ("c", "modified"), ("d", "created")}


def test_settings(values):
    assert [tuple(v) for v in values(projects.command_settings, "run --llm-model=m --provider p", "x --ai-model y --model z claude")] == [("p", "m", ""), ("anthropic", "y", "")]
    assert values(projects.project_path, "-d /a --source /b", "none") == ["/b", None]
    assert [tuple(v) for v in values(projects.env_file_settings, "#model=no\nmodel=a=b\nprovider=x\nprovider=y", "")] == [("a=b", "y"), (None, None)]
    assert values(lambda c: F.sha2(c, 256).startswith(projects.key_prefix(c)), "secret") == [True]


def in_splits(spark, size, work):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        return work()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def random_csv(seed):
    import random

    draw = random.Random(seed)
    mark = draw.choice(",;\t")
    cells = ["x", 'a"b', '"q"', '"a""b"', '"l1\nl2"', f'"a\n\n""\nb{mark}c"', '""', '"x"y', f'"{mark}"', '5" y', '"m\n"n"', ""]
    rows = [mark.join(["time", "level", "note"] if seed % 3 else ["time", "level", '"no\nte"'])]
    for _ in range(draw.randint(1, 40)):
        rows.append(mark.join([draw.choice(cells) if draw.random() > 0.01 else f'"un{mark}', draw.choice(cells), "z" + draw.choice(cells)]))
    return "\n".join(rows) + "\n"


def test_csv_records_are_those_of_the_standard_reader(spark, tmp_path, monkeypatch):
    """Cells with line breaks, quotes inside cells, quotes that never end; runs of three lines, one split and many."""
    import csv
    import io

    monkeypatch.setattr(structured, "RUN_LINES", 3)
    want = {}
    for i in range(25):
        content = random_csv(i)
        (tmp_path / f"t{i:02d}.csv").write_text(content)
        sample = content[:1024]
        reader = csv.DictReader(io.StringIO(content), delimiter="\t" if "\t" in sample else ";" if ";" in sample else ",")
        want[f"t{i:02d}.csv"] = [{k: v for k, v in row.items() if k is not None} for row in reader]

    def read():
        rows = structured.csv_rows(text.numbered_lines(spark, str(tmp_path))).collect()
        got = {name: [] for name in want}
        for r in sorted(rows, key=lambda r: (r["file"], r["line_number"])):
            got[r["file"].rsplit("/", 1)[1]].append(r["data"])
        return got

    assert in_splits(spark, "10000000", read) == want
    assert in_splits(spark, "40", read) == want


def test_csv_records_that_are_too_long(spark, monkeypatch):
    monkeypatch.setattr(structured, "RECORD_LINES", 50)
    monkeypatch.setattr(structured, "RUN_LINES", 8)
    df = lines(spark, a=["level,x", 'one,"a', *["b"] * 30, 'c",d', 'two,"never', *["e"] * 100])
    rows = {r["line_number"]: r for r in structured.csv_records(df.withColumn("delimiter", F.lit(","))).collect()}
    assert sorted(rows) == [1, 2, 34]
    assert rows[2]["raw_line"] == "\n".join(['one,"a', *["b"] * 30, 'c",d']) and not rows[2]["is_bad"]
    assert rows[34]["is_bad"] and rows[34]["raw_line"] == 'two,"never'
    assert [r["data"] for r in structured.csv_rows(df).orderBy("line_number").collect()][1] is None


JSON_FILES = {
    "pretty.json": '[\n  {\n    "msg": "a, [b] {c} \\" ]",\n    "x": [1, [2, 3], {"k": []}]\n  },\n\n  {"msg": "two"}, {"msg":"three"},{\n"msg": "é,漢"\n}\n]\n',
    "one_line.json": '[{"msg": "p"}, {"msg": "q"}]',
    "object.json": '{\n "msg": "whole",\n "list": [1,\n 2]\n}\n',
    "nested.json": '[[1,\n2],\n{"msg": "n"}, 5, "s,t"]',
    "empty.json": "[\n]\n",
    "by_line.json": '{"msg": "l1"}\n{"msg": "l2"}\n[1]\n',
    "open.json": '[\n{"msg": "x"},\n',
    "comma.json": '[\n{"msg": "x"},\n]\n',
    "two.json": '[\n{"msg": "x"}\n]\n[\n{"msg": "y"}\n]\n',
    "text.json": '[\n{"msg": "x"}\n]\nend\n',
    "element.json": '[\n{"msg": "x"},\n{"msg": }\n]\n',
    "gap.json": '[\n{"msg": "x"}\n{"msg": "y"}\n]\n',
    "objects.json": '{\n"msg": "x"\n}\n{\n"msg": "y"\n}\n',
    "blank.json": "\n  \n",
}


def test_json_documents_are_cut_into_elements(spark, tmp_path, monkeypatch):
    """As the standard parser reads them, in any number of splits and runs; what is no document is left to the line reader."""
    import json

    monkeypatch.setattr(structured, "RUN_LINES", 2)
    for name, content in JSON_FILES.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "long.json").write_text(json.dumps([{"msg": str(i), "more": [i, {"deep": ["],["]}]} for i in range(300)], indent=1))
    want = {}
    for path in sorted(tmp_path.iterdir()):
        content = path.read_text()
        used = [line for line in content.split("\n") if line.strip()]
        try:
            data = json.loads(content)
        except ValueError:
            continue
        if used:
            data = data if isinstance(data, list) else [data]
            want[path.name] = [d.get("msg") if isinstance(d, dict) else None for d in data]

    def read():
        rows = structured.json_file_entries(text.numbered_lines(spark, str(tmp_path))).collect()
        got = {r["file"].rsplit("/", 1)[1]: [] for r in rows}
        for r in sorted(rows, key=lambda r: r["entry"]):
            if not r["is_empty"]:
                got[r["file"].rsplit("/", 1)[1]].append(r["message"])
        return got

    assert in_splits(spark, "10000000", read) == want
    assert in_splits(spark, "50", read) == want
    assert len(want["long.json"]) == 300 and "by_line.json" not in want


def test_no_list_of_all_lines_of_a_json_file(spark, tmp_path):
    """A long file of one entry per line goes line by line through the dispatch."""
    (tmp_path / "a.json").write_text("".join(f'{{"msg": "m{i}"}}\n' for i in range(5000)) + "{bad\n")
    (row,) = log_analysis.file_totals(log_analysis.parse_folder(spark, str(tmp_path))).collect()
    assert (row["parsed_entries"], row["errors"]) == (5000, 1)


def test_folder_totals(spark):
    """Folders with all below them; a name may begin like another, a root may end in a slash, a file may lie in it."""
    paths = {"a": 1, "x/b": 2, "x/c": 3, "x/y/d": 4, "x/y/z/e": 5, "xy/f": 6}
    rows = [(f"file:/r/{p}", f"file:/r/{p}".rsplit("/", 1)[0], n) for p, n in paths.items()]
    files = spark.createDataFrame(rows, "file string, directory string, size_bytes long")
    want = {("", 21, 10), ("x", 14, 6), ("x/y", 9, 3), ("x/y/z", 5, 1), ("xy", 6, 1)}
    for root in ("file:/r", "file:/r/"):
        assert set(map(tuple, text.folder_totals(files, root).collect())) == want
    assert text.folder_totals(files.limit(0), "file:/r").count() == 0


def test_a_session_has_one_metric_file_however_its_rows_are_dealt(spark, tmp_path, monkeypatch):
    rows = [(f"s{i % 3}", "2024-01-01T00:00:00", "c", "m", str(i), "{}") for i in range(90)]
    metrics = spark.createDataFrame(rows, "session_id string, " + entities.METRIC_SCHEMA).repartition(7)

    def files_of(df, name):
        entities.write_session_metrics(df, str(tmp_path / name))
        read = entities.read_metrics(spark, str(tmp_path / name)).select("session_id", "value").collect()
        return len(list((tmp_path / name).rglob("*.csv"))), sorted((r["session_id"], r["value"]) for r in read)

    every = sorted((r[0], r[4]) for r in rows)
    assert files_of(metrics, "whole") == (3, every)
    assert files_of(metrics.limit(0), "none")[1] == []
    monkeypatch.setattr(entities, "FILE_ROWS", 10)
    files, read = files_of(metrics, "cut")
    assert 3 < files <= 9 and read == every


def test_lines_of_csv_files_are_computed_few_times(spark):
    """What is dear in a line is done for the sample, and for the written copy; not for each step that reads lines."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("f", 1, "key,note,level")] + [("f", i, 'k,"a' if i % 2 == 0 else 'b",x') for i in range(2, 4002)]
    df = spark.createDataFrame(rows, "file string, line_number bigint, raw_line string")
    found = structured.csv_rows(df.mapInArrow(count, df.schema)).select("line_number", "data").collect()
    assert sorted(r["line_number"] for r in found) == list(range(2, 4002, 2))
    assert all(r["data"] == {"key": "k", "note": "a\nb", "level": "x"} for r in found)
    assert seen.value <= 2 * len(rows)


def test_lines_of_documents_are_computed_few_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = {"a.json": ["["] + ['{"message": "m",', '"level": "l"},'] * 2000 + ["{}", "]"], "b.csv": ["level,note"] + ['l,"x', 'y"'] * 500,
             "c.xml": ["<testsuite name='s'>"] + ["<testcase name='t'/>"] * 300 + ["</testsuite>"]}
    rows = [(file, i, line) for file, text in texts.items() for i, line in enumerate(text, 1)]
    df = spark.createDataFrame(rows, "file string, line_number bigint, raw_line string")
    found = log_analysis.parse_table(df.mapInArrow(count, df.schema)).groupBy("format").count().collect()
    assert {r["format"]: r["count"] for r in found} == {"json": 2001, "csv": 500, "xml": 300}
    assert seen.value <= 2 * len(rows)
