"""Prompt/reply pairs: pairing, hallucination scoring, token and cost accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.numbers import flag
from ..functions.python_source import python_facts

TURNS_PER_RUN = 4096


def pair_turns(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that directly follows.

    A conversation is cut into runs of turn numbers, so a window never holds more than
    one run. Only the last row of a run and the first row of a later run meet again, in
    a second and much smaller window, to pair turns across the cut.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "run", F.floor(F.col("turn") / TURNS_PER_RUN)
    )
    in_run = Window.partitionBy("conv_id", "run").orderBy("turn")
    seen = rows.select(
        "*",
        F.lead("turn").over(in_run).isNull().alias("ends_run"),
        F.lead("role").over(in_run).alias("next_role"),
        F.lead("text").over(in_run).alias("next_text"),
        (F.lag("turn").over(in_run).isNull() & (F.col("run") > 0)).alias("opens_run"),
    )
    inner = seen.filter("role = 'user' and next_role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("prompt_text"), F.col("next_text").alias("response_text")
    )
    across = Window.partitionBy("conv_id").orderBy("turn")
    seams = (
        seen.filter("opens_run or (ends_run and role = 'user')")
        .select(
            "conv_id",
            "turn",
            "role",
            "ends_run",
            F.col("text").alias("prompt_text"),
            F.lead("role").over(across).alias("next_role"),
            F.lead("text").over(across).alias("response_text"),
        )
        .filter("ends_run and role = 'user' and next_role = 'assistant'")
    )
    return inner.unionByName(seams.select("conv_id", "turn", "prompt_text", "response_text"))


# -- language --------------------------------------------------------------------

# Indicators per language; on equal hits the earlier language wins.
LANGUAGE_HINTS = {
    "python": [r"def\s+", r"import\s+", r"print\s*\(", r"if\s+__name__"],
    "c": [r"#include\s*<", r"int\s+main\s*\(", r"printf\s*\("],
    "cpp": [r"#include\s*<iostream>", r"std::", r"cout\s*<<"],
    "java": [r"public\s+class", r"System\.out\.print", r"public\s+static\s+void\s+main"],
    "javascript": [r"function\s+", r"console\.log", r"var\s+", r"let\s+", r"const\s+"],
    "rust": [r"fn\s+", r"let\s+mut", r"println!", r"use\s+"],
    "go": [r"package\s+", r"func\s+", r"import\s+", r"fmt\.Print"],
}
# A literal part of every match of the hint in the same place.
HINT_WORDS = {
    "python": ["def", "import", "print", "__name__"],
    "c": ["#include", "main", "printf"],
    "cpp": ["<iostream>", "std::", "cout"],
    "java": ["public", "System.out.print", "public"],
    "javascript": ["function", "console.log", "var", "let", "const"],
    "rust": ["fn", "let", "println!", "use"],
    "go": ["package", "func", "import", "fmt.Print"],
}
FOREIGN_HINTS = {
    "python": [r"#include", r"public\s+class", r"cout\s*<<"],
    "c": [r"import\s+", r"println!", r"console\.log"],
    "java": [r"#include", r"def\s+", r"fn\s+"],
    "javascript": [r"#include", r"def\s+", r"public\s+class"],
}
KNOWN_MODULES = ["os", "sys", "json", "time", "datetime", "math", "random", "re"]
KNOWN_HEADERS = ["stdio.h", "stdlib.h", "string.h", "math.h", "time.h"]
# A lower-case word every match holds, and the pattern.
INVENTED_NAMES = [
    ("undefined_function", r"(?i)undefined_function\s*\("),
    ("nonexistent_", r"(?i)nonexistent_(?:library|module|package)"),
    ("fictional_", r"(?i)fictional_(?:method|function|class)"),
    ("import", rf"(?i)import\s+(?:nonexistent|fake|dummy)_{T.WORD}+"),
    ("#include", r"(?i)#include\s*<(?:nonexistent|fake|dummy)\.h>"),
]
# Every match of an invented name holds one of these, too.
INVENTED_STEMS = ["undefined_", "nonexistent", "fictional_", "fake", "dummy"]
# A word every match holds, the pattern, the label, and a sign every match holds.
IMPOSSIBLE = [
    ("malloc", r"malloc\s*\(\s*-\d+\s*\)", "Negative malloc size", "("),
    ("array[", r"array\[\s*-\d+\s*\]", "Negative array index", "]"),
    ("/", rf"{T.WORD}\s*=\s*{T.WORD}+\s*/\s*0(?!\.\d)", "Division by zero", "="),
    ("for", r"for\s*\(\s*;\s*true\s*;\s*\)\s*\{[^{}]*\}(?![^{}]*break)", "Infinite loop without break", "("),
]
PYTHON_IMPORT = rf"import\s+{T.WORD}+|from\s+{T.WORD}+\s+import"
INCLUDE = r"#include\s*<([^>]+)>"
MALLOC = T.WORD_START + r"malloc\s*\("
FREE = T.WORD_START + r"free\s*\("


def hint_count(code: Column, patterns: list[str], words: list[str]) -> Column:
    hints = [flag(T.found(code, word, pattern)) for word, pattern in zip(words, patterns, strict=True)]
    total = hints[0]
    for hint in hints[1:]:
        total = total + hint
    return total


def language_of(code: Column) -> Column:
    """The language with most indicator hits (``unknown`` without any).

    Hits and precedence share one number per language, so that every indicator is
    evaluated once wherever the optimizer copies this expression.
    """
    # Behind on equal hits: the later language; without any hit, all of them.
    by_rank = [*reversed(LANGUAGE_HINTS), "unknown"]
    base = len(by_rank)
    ranked = [
        hint_count(code, LANGUAGE_HINTS[name], HINT_WORDS[name]) * base + rank for rank, name in enumerate(by_rank[:-1])
    ]
    best = F.greatest(*ranked, F.lit(base - 1))
    return F.element_at(F.array(*[F.lit(name) for name in by_rank]), best % base + 1)


def detect_language(df: DataFrame, code: str, out: str = "language") -> DataFrame:
    """Add the language. The explode of one value keeps filters on it from pulling copies
    of all indicators below this step."""
    return df.select("*", F.explode(F.array(language_of(F.col(code)))).alias(out))


# -- single checks ---------------------------------------------------------------


def invented_issues(code: Column) -> Column:
    """Invented names (one issue per hit) and impossible constructs (one per kind)."""

    def found(low: Column) -> Column:
        return F.flatten(
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            low.contains(word) & T.has(low, *INVENTED_STEMS),
                            F.transform(T.matches(code, p), lambda m: F.concat(F.lit("Potential hallucination: "), m)),
                        )
                        for word, p in INVENTED_NAMES
                    ]
                )
            )
        )

    impossible = T.present(
        *[(code.contains(sign) & T.found(code, word, p), "Impossible construct: " + text) for word, p, text, sign in IMPOSSIBLE]
    )
    return F.concat(T.let(F.lower(code), found), impossible)


def imported_modules(code: Column) -> Column:
    return F.transform(T.matches(code, PYTHON_IMPORT), lambda m: F.regexp_extract(m, rf"^(?:import|from)\s+({T.WORD}+)", 1))


def unknown_api_issues(code: Column, language: Column) -> Column:
    modules = F.filter(imported_modules(code), lambda m: ~m.isin(*KNOWN_MODULES) & ~m.startswith("_"))
    headers = F.filter(T.matches(code, INCLUDE, 1), lambda h: ~h.isin(*KNOWN_HEADERS))
    return (
        F.when(language == "python", F.transform(modules, lambda m: F.concat(F.lit("Unknown module: "), m)))
        .when(language == "c", F.transform(headers, lambda h: F.concat(F.lit("Unknown header: "), h)))
        .otherwise(F.array().cast("array<string>"))
    )


def mixes_languages(code: Column, language: Column) -> Column:
    out = F.lit(False)
    for name, patterns in FOREIGN_HINTS.items():
        out = F.when(language == name, code.rlike("|".join(patterns))).otherwise(out)
    return out


def overlap_ratio(prompt: Column, reply: Column, shortest: int) -> Column:
    return shared_part(T.vocabulary(prompt, shortest), T.vocabulary(reply, shortest))


def shared_part(asked: Column, said: Column) -> Column:
    """Words of ``asked`` that are also in ``said``, as a part of ``asked``."""
    return F.size(F.array_intersect(asked, said)) / F.greatest(F.size(asked), F.lit(1))


def consistency_issues(prompt: Column, code: Column, language: Column, overlap: Column | None = None) -> Column:
    overlap = overlap_ratio(prompt, code, 3) if overlap is None else overlap
    return T.present(
        (
            mixes_languages(code, language),
            F.concat(F.lit("Mixed language syntax: "), language, F.lit(" code contains other language patterns")),
        ),
        (overlap < 0.1, "Low semantic overlap between prompt and response"),
    )


def c_issues(code: Column) -> Column:
    opened, closed = T.literal_count(code, "{"), T.literal_count(code, "}")
    return T.present(
        (code.contains("main") & ~code.contains("#include"), "Main function without includes"),
        (
            opened != closed,
            F.concat(F.lit("Unmatched braces: "), opened.cast("string"), F.lit(" open, "), closed.cast("string"), F.lit(" close")),
        ),
        (T.found(code, "malloc", MALLOC) & ~T.found(code, "free", FREE), "malloc without corresponding free"),
    )


def cpp_issues(code: Column) -> Column:
    missing = code.contains("std::") & ~code.contains("#include <iostream>")
    return T.present((missing, "Using std:: without iostream include"))


def java_issues(code: Column) -> Column:
    return T.present(
        (code.contains("main") & ~code.contains("public static void main"), "main method should be 'public static void main'"),
        (code.contains("class") & ~code.contains("public class"), "Classes should typically be public"),
    )


def javascript_issues(code: Column) -> Column:
    return T.present(
        (T.literal_count(code, "(") != T.literal_count(code, ")"), "Unmatched parentheses"),
        (T.literal_count(code, "[") != T.literal_count(code, "]"), "Unmatched square brackets"),
    )


def rust_issues(code: Column) -> Column:
    silent = code.contains("fn main") & ~code.contains("println!") & ~code.contains("print!")
    return T.present((silent, "Main function without output"))


def go_issues(code: Column) -> Column:
    return T.present((code.contains("func main") & ~code.contains("package main"), "Main function without package main"))


# Languages -> issues of a reply; a reply gets the issues of every entry that names its
# language, in this order. Callers may add entries.
VALIDATORS = [
    (("c", "cpp"), c_issues),
    (("cpp",), cpp_issues),
    (("java",), java_issues),
    (("javascript",), javascript_issues),
    (("rust",), rust_issues),
    (("go",), go_issues),
]


def language_issues(code: Column, language: Column, validators: list | None = None) -> Column:
    """The issues of the language's own checks; ``python`` is added by ``score_replies``."""
    nothing = F.array().cast("array<string>")
    found = [F.when(language.isin(*names), check(code)).otherwise(nothing) for names, check in validators or VALIDATORS]
    return F.concat(*found)


def python_issues(facts: Column) -> Column:
    undefined = F.transform(facts["undefined"], lambda n: F.concat(F.lit("Potentially undefined name: "), n))
    return F.when(~facts["parses"], F.array(F.lit("Python syntax error"))).otherwise(undefined)


def coherence(prompt: Column, reply: Column, asked: Column | None = None, shared: Column | None = None) -> Column:
    """How much of the prompt's words of four letters or more the reply takes up; the numbers of them and of those
    that are in both may be given."""
    if asked is None or shared is None:
        words = T.vocabulary(prompt, 4)
        asked, shared = F.size(words), F.size(F.array_intersect(words, T.vocabulary(reply, 4)))
    return (
        F.when(F.coalesce(prompt, F.lit("")) == "", 0.0)
        .when(F.coalesce(reply, F.lit("")) == "", 0.0)
        .when(asked == 0, 0.5)
        .otherwise(F.least(shared / asked * 2, F.lit(1.0)))
    )


# -- whole score -----------------------------------------------------------------


def with_python_facts(df: DataFrame, code: str = "response_text", language: str = "language") -> DataFrame:
    """Add ``py``: parser facts for Python rows, NULL for the rest (their text is not sent)."""
    return df.withColumn("py", python_facts(F.when(F.col(language) == "python", F.col(code))))


def score_replies(df: DataFrame, prompt: str = "prompt_text", reply: str = "response_text") -> DataFrame:
    """Hallucination issues, confidence and severity of every reply.

    A projection only: no row leaves its partition.
    """
    language, asked, said = F.col("language"), F.col(prompt), F.col(reply)
    checked = with_python_facts(detect_language(df, reply), reply)
    # Both texts are cut into words and met once: words of four letters or more are among those of three or more.
    words = {"_asked": T.vocabulary(asked, 3), "_said": T.vocabulary(said, 3)}
    shared = {"_shared": F.array_intersect("_asked", "_said")}
    numbers = {f"{name}_4": F.size(F.filter(name, lambda w: F.length(w) > 3)) for name in ("_asked", "_shared")}
    numbers |= {f"{name}_3": F.size(name) for name in ("_asked", "_shared")}
    given = [F.col(name) for name in checked.columns]
    checked = checked.withColumns(words).withColumns(shared).withColumns(numbers).select(
        *given,
        invented_issues(said).alias("invented"),
        unknown_api_issues(said, language).alias("unknown_api"),
        consistency_issues(asked, said, language, F.col("_shared_3") / F.greatest("_asked_3", F.lit(1))).alias("inconsistent"),
        F.when(language == "python", python_issues(F.col("py")))
        .otherwise(language_issues(said, language))
        .alias("language_issues"),
        F.when(language == "python", F.col("py.compiles"))
        .when(language.isin("c", "cpp"), said.contains("{") & said.contains("}"))
        .otherwise(False)
        .alias("compiles"),
        coherence(asked, said, F.col("_asked_4"), F.col("_shared_4")).alias("coherence"),
    )

    def part(condition: Column, weight: float) -> Column:
        return F.when(condition, weight).otherwise(0.0)

    # The order of the additions is part of the result.
    raw = (
        part(F.size("invented") > 0, 0.3)
        + part(F.size("unknown_api") > 0, 0.4)
        + part(F.size("inconsistent") > 0, 0.3)
        + part(F.size("language_issues") > 0, 0.4)
        + part(~F.col("compiles"), 0.3)
        + part(F.col("coherence") < 0.5, 0.2)
    )
    capped = F.least(F.col("raw"), F.lit(1.0))
    return (
        checked.withColumn("raw", raw)
        .withColumn("hallucination_detected", F.col("raw") > 0.3)
        .withColumn("confidence", capped)
        .withColumn(
            "severity",
            F.when(F.col("confidence") > 0.7, "high").when(F.col("confidence") > 0.4, "medium").otherwise("low"),
        )
        .withColumn("issues", F.concat("invented", "unknown_api", "inconsistent", "language_issues"))
        .withColumn(
            # Four scalar findings next to the issue list; severity and details always count.
            "analysis_confidence",
            F.least(
                (F.size("issues") + flag(F.col("hallucination_detected")) + flag(F.col("confidence") > 0) + 2) * 0.1,
                F.lit(1.0),
            ),
        )
        .drop("raw", "py")
    )


# -- tokens and cost -------------------------------------------------------------


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def total_tokens(total: Column, prompt: Column, reply: Column) -> Column:
    """The reported total, or the sum of the parts when it is missing."""
    return F.when((total == 0) & ((prompt > 0) | (reply > 0)), prompt + reply).otherwise(total)


def with_cost(df: DataFrame, tokens: str = "total_tokens") -> DataFrame:
    """Price by (provider, model), else the provider's default, else the general one."""
    spark = df.sparkSession
    prices = rules.dim(spark, rules.PRICES, "p_provider string, p_model string, price double")
    exact = F.broadcast(prices.filter("p_model <> 'default'"))
    default = F.broadcast(
        prices.filter("p_model = 'default'").select(F.col("p_provider").alias("d_provider"), F.col("price").alias("default_price"))
    )
    return (
        df.join(exact, (F.col("llm_provider") == F.col("p_provider")) & (F.lower("llm_model") == F.col("p_model")), "left")
        .join(default, F.col("llm_provider") == F.col("d_provider"), "left")
        .withColumn("price_per_1k", F.coalesce("price", "default_price", F.lit(rules.UNKNOWN_PRICE)))
        .withColumn("cost_usd", F.col(tokens) / 1000.0 * F.col("price_per_1k"))
        .drop("p_provider", "p_model", "price", "d_provider", "default_price")
    )


def session_usage(priced: DataFrame) -> DataFrame:
    """Interactions, tokens and cost per session."""
    return priced.groupBy("session_id").agg(
        F.count("*").alias("total_llm_interactions"),
        F.sum("total_tokens").alias("total_tokens_consumed"),
        F.sum("cost_usd").alias("estimated_cost_usd"),
    )


def provider_usage(priced: DataFrame) -> DataFrame:
    """Requests, tokens, errors, cost and error rate per provider and overall (``ALL``)."""
    return (
        priced.rollup("llm_provider")
        .agg(
            F.grouping("llm_provider").alias("overall"),
            F.count("*").alias("requests"),
            F.sum("total_tokens").alias("tokens"),
            F.count_if(~F.col("success")).alias("errors"),
            F.sum("cost_usd").alias("total_cost"),
        )
        .select(
            F.when(F.col("overall") == 1, "ALL").otherwise(F.col("llm_provider")).alias("provider"),
            "requests",
            "tokens",
            "errors",
            "total_cost",
            F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0).alias("error_rate"),
        )
    )


def minute_limits(df: DataFrame, limit: int = 60) -> DataFrame:
    """Requests per provider and minute, flagged at ``limit`` (calendar minutes)."""
    return (
        df.groupBy("llm_provider", F.window(F.col("ts").cast("timestamp"), "60 seconds").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select("llm_provider", F.col("w.start").alias("minute"), "requests", (F.col("requests") >= limit).alias("limited"))
    )


def latest_health(health: DataFrame) -> DataFrame:
    """Last reported status per provider."""
    return health.groupBy("provider").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("checked_at")
    )


def available_providers(health: DataFrame) -> DataFrame:
    return latest_health(health).filter(F.col("status") == "healthy")


def select_provider(health: DataFrame, usage: DataFrame, preferences: list[str]) -> DataFrame:
    """The first healthy preferred provider, else the healthy one with fewest requests."""
    preference = rules.lookup(F.col("provider"), [(name, i) for i, name in enumerate(preferences)] or [("", 0)])
    return (
        available_providers(health)
        .join(usage.select("provider", "requests"), "provider", "left")
        .select("provider", "status", F.coalesce("requests", F.lit(0)).alias("requests"), preference.alias("preference"))
        .orderBy(F.col("preference").asc_nulls_last(), "requests", "provider")
        .limit(1)
    )
