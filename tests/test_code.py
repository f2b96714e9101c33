from __future__ import annotations

import re

from pyspark.sql import functions as F

from trialscope.functions import text as T
from trialscope.operators import code


def table(spark, *rows):
    return spark.createDataFrame([(i, l, c) for i, (l, c) in enumerate(rows)], "doc_id bigint, language string, content string")


def functions(spark, language, content):
    rows = code.function_table(table(spark, (language, content))).orderBy("ordinal").collect()
    return [(r["name"], r["line_number"], r["body_lines"], r["complexity"], list(r["parameters"])) for r in rows]


def test_brace_depth(values):
    assert values(code.brace_depth, "a{b{c}}}{d", "", "}}{", "{{{") == [2, 0, 1, 3]


def test_strcpy_is_one_high_issue(spark):
    df = table(spark, ("c", "char* f(char* d, char* s) { return strcpy(d, s); }"))
    (row,) = code.score_code(df).collect()
    assert [(i["kind"], i["severity"], i["occurrences"]) for i in row["security_issues"]] == [("buffer_overflow", "high", 1)]
    # One security issue, and no doc comment for the one function.
    assert row["overall_score"] == 10.0 - 1.0 - 0.2


def test_c_bodies_end_at_the_first_inner_close(spark):
    content = "int main(void) {\n  if (a && b) {\n    x();\n  }\n  y();\n}\n"
    found = functions(spark, "c", content)
    # The scan starts behind the opening brace, so the inner block's brace ends the body.
    assert found[0] == ("main", 1, 4, 3, [])
    assert found[1][0] == "if" and found[1][1] == 2


def test_javascript_and_java_bodies(spark):
    assert functions(spark, "javascript", "function go(x, y) {\n  return x ? 1 : 2;\n}\n") == [("go", 1, 3, 2, ["x", "y"])]
    (row,) = functions(spark, "java", "class A {\n  int add(int a, int b) {\n    return a;\n  }\n}")
    assert row[0] == "add" and row[2] == 3 and row[4] == ["a", "b"]


def test_function_without_a_closing_brace(spark):
    assert functions(spark, "javascript", "function go() { if (x) {") == [("go", 1, 0, 1, [])]


def test_python_bodies(spark):
    content = (
        "def one(a):\n    if a:\n        return 1\n\n    return 2\nx = 1\n"
        "def two(): return 3\n"
        "class A:\n    def three(self, b):\n        for c in b:\n            pass\n"
    )
    found = functions(spark, "python", content)
    assert found[0] == ("one", 1, 5, 2, ["a"])
    # Code on the definition line itself leaves no body.
    assert found[1] == ("two", 7, 0, 1, [])
    # The margin is that of the definition's rest, so the body runs to the end of the text.
    assert found[2] == ("three", 9, 4, 2, ["self", "b"])


def python_body(content, end):
    """The rule for Python bodies, line by line."""
    rows = content[end:].split("\n")
    base = len(rows[0]) - len(rows[0].lstrip())
    body = []
    for row in rows:
        if row.strip() and len(row) - len(row.lstrip()) <= base:
            break
        body.append(row)
    return "\n".join(body)


def test_python_bodies_against_a_loop(spark):
    import random
    import re

    rng = random.Random(11)
    texts = []
    for _ in range(60):
        rows = []
        for i in range(rng.randrange(1, 25)):
            indent = " " * rng.choice([0, 0, 2, 4, 8])
            rows.append(rng.choice([f"{indent}def f{i}(a, b):", f"{indent}def g{i}():  ", f"{indent}def h{i}(): pass", "", "   ", f"{indent}if x and y:", f"{indent}z = 1 ? 2"]))
        texts.append("\n".join(rows))
    df = table(spark, *[("python", t) for t in texts])
    got = {}
    for r in code.function_table(df).collect():
        got.setdefault(r["doc_id"], {})[r["ordinal"]] = (r["name"], r["line_number"], r["body_lines"], r["complexity"])
    words = re.compile(r"\b(?:if|else|elif|while|for|switch|case)\b|&&|\|\||\?")
    for doc, content in enumerate(texts):
        expected = {}
        for n, match in enumerate(re.finditer(r"def\s+(\w+)\s*\([^)]*\):", content)):
            body = python_body(content, match.end())
            expected[n] = (
                match.group(1),
                content[: match.start()].count("\n") + 1,
                len(body.split("\n")) if body else 0,
                1 + len(words.findall(body)) if body else 1,
            )
        assert got.get(doc, {}) == expected


def test_brace_bodies_against_a_loop(spark):
    import random
    import re

    rng = random.Random(13)
    pieces = ["function f(a) ", "{", "}", "\n", "if (x) ", " x && y ", "z ? 1 : 2;", "function g() {"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    got = {}
    for r in code.function_table(table(spark, *[("javascript", t) for t in texts])).collect():
        got.setdefault(r["doc_id"], {})[r["ordinal"]] = (r["line_number"], r["body_lines"], r["complexity"])
    words = re.compile(r"\b(?:if|else|elif|while|for|switch|case)\b|&&|\|\||\?")
    for doc, content in enumerate(texts):
        expected = {}
        for n, match in enumerate(re.finditer(r"function\s+(\w+)\s*\([^)]*\)", content)):
            depth, body = 0, ""
            for i in range(match.end(), len(content)):
                depth += {"{": 1, "}": -1}.get(content[i], 0)
                if content[i] == "}" and depth == 0:
                    body = content[match.end() : i + 1]
                    break
            expected[n] = (
                content[: match.start()].count("\n") + 1,
                len(body.split("\n")) if body else 0,
                1 + len(words.findall(body)) if body else 1,
            )
        assert got.get(doc, {}) == expected


def test_long_prose_does_not_overflow(spark):
    prose = " ".join(["word"] * 20000)
    df = table(spark, ("c", prose), ("java", prose), ("c", prose + " main(void) { }"))
    assert [r["doc_id"] for r in code.function_table(df).collect()] == [2]
    assert code.score_code(df).count() == 3


def test_located_matches_know_their_line(values):
    (hits,) = values(lambda c: T.located(c, r"strcpy\s*\("), "a\nstrcpy(b) strcpy\n(c)\nx")
    assert [(h["line"], h["match"]) for h in hits] == [(2, "strcpy("), (2, "strcpy\n(")]


def test_rule_context_is_two_lines_each_way(spark):
    df = table(spark, ("python", "1\n2\n3\n4 eval(x)\n5\n6\n7"), ("python", "exec(y)"))
    rows = {r["doc_id"]: r for r in code.located_rules(df, "doc_id").collect()}
    assert rows[0]["line_number"] == 4 and rows[0]["context"] == "2\n3\n4 eval(x)\n5\n6"
    assert rows[1]["context"] == "exec(y)"


def test_duplicate_lines_in_order_of_first_sight(values):
    text = "\n".join(["second duplicate"] + ["first of them all"] * 2 + ["short"] * 5 + ["second duplicate"] * 2 + ["first of them all"])
    (found,) = values(lambda c: code.duplicate_lines(T.lines(c)), text)
    assert list(found) == ["second duplicate", "first of them all"]


def test_python_counts(spark):
    df = table(
        spark,
        ("python", "import os\nfrom x import *\nclass A:\n    def f(self):\n        try:\n            return [a for a in b]\n        except:\n            pass\n"),
        ("python", "def broken(:"),
        ("c", "int x;"),
    )
    rows = {r["doc_id"]: r for r in code.with_python_facts(df, "content").collect()}
    facts = rows[0]["py"]
    assert (facts["functions"], facts["classes"], facts["imports"], facts["comprehensions"]) == (1, 1, 1, 1)
    assert not rows[1]["py"]["parses"] and rows[2]["py"]["parses"] is None
    smells = {r["doc_id"]: [i["kind"] for i in r["code_smells"]] for r in code.score_code(df).collect()}
    assert "wildcard_import" in smells[0] and "bare_except" in smells[0] and smells[1] == ["syntax_error"]


def test_quality_bounds(spark, sf_dir):
    from trialscope.fixtures import view

    scored = code.score_code(view(spark, sf_dir, "source_files"))
    low, high = scored.agg(F.min("overall_score"), F.max("overall_score")).first()
    assert 0.0 <= low <= high <= 10.0


def test_language_of_path(values):
    assert values(code.language_of_path, "a/b.C", "x.hpp", ".env", "dir.py/file", "y.kt") == ["c", "cpp", "unknown", "unknown", "kotlin"]


def test_cut_and_guarded_counts_equal_the_plain_patterns(spark):
    import random

    draw = random.Random(5)
    words = ["def", "function", "undef", "f", "für", "x1", "if", "elif", "elifs", "_if", "for", "?", "&&", "|", "(", "(", ")", " ", " ", "\n", "\t ", "123", "12", "1234a", "TODO", "hack", "𝒳"]
    texts = ["", "(", "a b(", "def a b(", "a b\n(", "function function x(", "def f(g h(", "x ( y (", "a b", "def x", "((", None]
    texts += ["".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(400)]
    text = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {
        "functions": (code.function_marks(text), T.hits(text, code.ANY_FUNCTION)),
        "decisions": (code.cyclomatic(text), T.hits(text, code.DECISIONS) + 1),
        "numbers": (code.magic_numbers(text), F.array_distinct(T.matches(text, code.MAGIC_NUMBER))),
        "todos": (code.todo_comments(text), T.matches(text, code.TODO)),
        "guarded": (T.guarded_hits(text, "if", T.whole("if")), T.hits(text, T.whole("if"))),
    }
    for name, (cut, plain) in pairs.items():
        assert df.filter(~cut.eqNullSafe(plain)).count() == 0, name


def test_tokens_start_only_where_the_look_ahead_allows():
    """A token pattern without the look ahead would try every character; each kind of token passes it."""
    assert code.TOKEN.startswith(code.TOKEN_STARTS)
    kinds = [code.OPENS, code.CLOSES, code.FULL, "{", "}", "\n", *code.BRANCH_WORDS.split("|"), "&&", "||", "?"]
    assert all(re.match(code.TOKEN_STARTS, kind) for kind in kinds)
    assert not any(re.match(code.TOKEN_STARTS, other) for other in "abdghjk xyz_0(;")
