from __future__ import annotations

import ast

import pytest
from pyspark.sql import functions as F

from trialscope.functions.python_source import KNOWN_NAMES, _facts
from trialscope.operators import interactions as ix


def scored(spark, prompt, reply):
    df = spark.createDataFrame([("i", "s", prompt, reply)], "interaction_id string, session_id string, prompt_text string, response_text string")
    return ix.score_replies(df).first()


def test_strcpy_reply(spark):
    row = scored(spark, "Write a C function to copy strings", "char* copy(char* d, char* s) { return strcpy(d, s); }")
    assert row["language"] == "unknown" and row["issues"] == []
    # No compiler for the language: 0.3. One of four prompt words comes back: coherence one half.
    assert row["coherence"] == 0.5 and row["confidence"] == pytest.approx(0.3)
    assert row["severity"] == "low" and not row["hallucination_detected"]
    # Confidence, severity and details: three findings.
    assert row["analysis_confidence"] == pytest.approx(0.3)


def test_coherence_edges(spark):
    rows = [("", "text", 0.0), ("text", "", 0.0), ("a an", "words here", 0.5), ("copy these strings", "copy strings", 1.0), ("copy these strings now", "copy", 2 / 3)]
    df = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(rows)], "i int, p string, r string")
    got = [r["c"] for r in df.select("i", ix.coherence(F.col("p"), F.col("r")).alias("c")).orderBy("i").collect()]
    assert got == pytest.approx([c for _, _, c in rows])


def test_language_ties_go_to_the_earlier_one(values):
    texts = ["import x", "package y\nimport x", "let mut a", "#include <iostream>\nint main() {}", "", "def f():\n  print (1)"]
    assert values(ix.language_of, *texts) == ["python", "go", "javascript", "c", "unknown", "python"]


def test_issues_of_each_kind(values):
    assert values(ix.invented_issues, "malloc(-4); x = y / 0; z = w / 0.5", "import fake_lib", "for (;true;) { a } more break", "for (; true ;) { a }") == [
        ["Impossible construct: Negative malloc size", "Impossible construct: Division by zero"],
        ["Potential hallucination: import fake_lib"],
        [],
        ["Impossible construct: Infinite loop without break"],
    ]
    assert values(lambda c: ix.unknown_api_issues(c, F.lit("python")), "import os\nfrom torch import x\nimport _hidden") == [["Unknown module: torch"]]
    assert values(lambda c: ix.unknown_api_issues(c, F.lit("cpp")), "#include <nope.h>") == [[]]
    assert values(lambda c: ix.c_issues(c), "int main() { malloc(3);") == [
        ["Main function without includes", "Unmatched braces: 1 open, 0 close", "malloc without corresponding free"]
    ]


def visitor(source):
    """Names a plain recursive walk finds undefined."""
    found, stored = [], set(KNOWN_NAMES)

    def walk(node):
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Store):
                stored.add(node.id)
            elif node.id not in stored and not node.id.startswith("_"):
                found.append(node.id)
        for child in ast.iter_child_nodes(node):
            walk(child)

    walk(ast.parse(source))
    return sorted(set(found[:5]))


@pytest.mark.parametrize(
    "source",
    ["x = x + 1", "print(a)\na = 2\nprint(a)", "y = [i for i in z]", "def f(p):\n  return p + q\n", "a; b; a; c; d; e; f; g", "_x; len(w)"],
)
def test_undefined_names(source):
    assert _facts(source)["undefined"] == visitor(source)


def test_python_that_parses_but_does_not_compile():
    facts = _facts("return 1")
    assert facts["parses"] and not facts["compiles"]
    assert not _facts("def (")["parses"] and not _facts("a\x00b")["parses"]


def test_prices(spark):
    rows = [("openai", "GPT-4", 0.03), ("openai", "new", 0.01), ("ollama", "any", 0.0), ("nobody", "x", 0.005), ("huggingface", "default", 0.001)]
    df = spark.createDataFrame([(p, m, 2000) for p, m, _ in rows], "llm_provider string, llm_model string, total_tokens bigint")
    got = {(r["llm_provider"], r["llm_model"]): r["cost_usd"] for r in ix.with_cost(df).collect()}
    assert len(got) == len(rows)
    for provider, model, price in rows:
        assert got[provider, model] == pytest.approx(2 * price)


def test_error_rate_overall(spark):
    df = spark.createDataFrame([("a", 1, 0.5, True), ("a", 2, 0.5, False), ("b", 3, 0.0, True)], "llm_provider string, total_tokens bigint, cost_usd double, success boolean")
    got = {r["provider"]: (r["requests"], r["tokens"], r["errors"], r["error_rate"]) for r in ix.provider_usage(df).collect()}
    assert got == {"a": (2, 3, 1, 0.5), "b": (1, 3, 0, 0.0), "ALL": (3, 6, 1, 1 / 3)}


def test_provider_selection(spark):
    health = spark.createDataFrame([("a", 1, 1, "healthy"), ("b", 1, 2, "healthy"), ("b", 2, 3, "unhealthy"), ("c", 1, 4, "healthy")], "provider string, ts bigint, event_id bigint, status string")
    usage = spark.createDataFrame([("a", 9), ("c", 3)], "provider string, requests bigint")
    assert ix.select_provider(health, usage, []).first()["provider"] == "c"
    assert ix.select_provider(health, usage, ["b", "a"]).first()["provider"] == "a"


def test_scores_stay_in_range(spark, sf_dir):
    from trialscope.fixtures import view

    low, high = ix.score_replies(view(spark, sf_dir, "code_replies")).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.0 <= low <= high <= 1.0
