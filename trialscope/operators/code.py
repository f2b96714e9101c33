"""Source texts: line metrics, issues, scores, functions, imports.

Everything but the function table is a projection: a text never leaves its partition.
The function table moves short tokens only, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.numbers import clamp
from .interactions import FREE, MALLOC, with_python_facts

W = T.WORD
BRANCH_WORDS = "if|else|elif|while|for|switch|case"
BRANCH_SIGNS = r"&&|\|\||\?"
DECISIONS = T.whole(BRANCH_WORDS + "|catch") + "|" + BRANCH_SIGNS
# What a decision can start with: one look ahead spares most characters the whole pattern.
DECISION_STARTS = "(?=[cefisw&|?])"
FUNCTION_DECISIONS = T.whole(BRANCH_WORDS) + "|" + BRANCH_SIGNS
BRACE_LANGUAGES = ("c", "cpp", "java", "javascript")


# -- line metrics ----------------------------------------------------------------


def with_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """Split once; the other line expressions read this column."""
    return df.withColumn("lines", T.lines(F.col(content)))


def count_lines(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test)).cast("bigint")


def is_comment(line: Column) -> Column:
    stripped = F.ltrim(line, F.lit(T.BLANKS))
    return stripped.startswith("#") | stripped.startswith("//") | stripped.startswith("/*")


def is_blank(line: Column) -> Column:
    return T.strip(line) == ""


def total_lines(lines: Column) -> Column:
    return F.size(lines).cast("bigint")


def mean_line_length(content: Column, lines: Column) -> Column:
    """All characters but the line breaks, over the lines."""
    return (F.length(content) - (F.size(lines) - 1)) / F.size(lines)


def max_line_length(lines: Column) -> Column:
    return F.array_max(F.transform(lines, lambda x: F.length(x))).cast("bigint")


def line_metrics(content: Column, lines: Column) -> list[Column]:
    comments = count_lines(lines, is_comment)
    blanks = count_lines(lines, is_blank)
    return [
        total_lines(lines).alias("total_lines"),
        (total_lines(lines) - blanks).alias("lines_of_code"),
        comments.alias("comment_lines"),
        blanks.alias("blank_lines"),
        mean_line_length(content, lines).alias("average_line_length"),
        max_line_length(lines).alias("max_line_length"),
        (comments / total_lines(lines)).alias("comment_ratio"),
    ]


def cyclomatic(content: Column, pattern: str = DECISIONS) -> Column:
    return T.hits(content, f"{DECISION_STARTS}(?:{pattern})") + 1


def brace_depth(content: Column) -> Column:
    """Deepest nesting of braces; a surplus closing brace does not go below zero."""
    braces = F.split(F.regexp_replace(content, r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).cast("bigint").alias("now"), F.lit(0).cast("bigint").alias("most"))

    def step(acc: Column, brace: Column) -> Column:
        now = (
            F.when(brace == "{", acc["now"] + 1).when(brace == "}", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        )
        return F.struct(now.cast("bigint").alias("now"), F.greatest(acc["most"], now).cast("bigint").alias("most"))

    return F.aggregate(braces, start, step, lambda acc: acc["most"])


def indent_depth(lines: Column) -> Column:
    """Deepest indentation of a non-blank line, in steps of four."""
    used = F.filter(lines, lambda x: ~is_blank(x))
    deepest = F.array_max(F.transform(used, lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(T.BLANKS)))))
    return F.floor(F.coalesce(deepest, F.lit(0)) / 4)


def nesting_depth(content: Column, lines: Column, language: Column) -> Column:
    return (
        F.when(language.isin(*BRACE_LANGUAGES), brace_depth(content))
        .when(language == "python", indent_depth(lines))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


# Two words and an opening parenthesis, from the last letter of the first word on. With
# possessive repeats every start fails within one word, so prose is searched in one pass.
WORD_AND_CALL = rf"{W}\s++{W}++\s*+\("

# -- issues ----------------------------------------------------------------------

MAGIC_NUMBER = T.whole(r"\d{3,}")
TODO = r"(?id)(?:TODO|FIXME|HACK|XXX).*"
TODO_WORDS = ("todo", "fixme", "hack", "xxx")
LONG_LINE = 120
UNCHECKED_MALLOC = r"malloc\s*\([^)]*\)(?!\s*;?\s*if)"
NESTED_LOOPS = r"for\s*\([^}]*for\s*\(|while\s*\([^}]*while\s*\("
LIST_BUILDING = rf"(?d)for\s+{W}+\s+in.*:\s*{W}+\.append\("
PARAMETER_LISTS = {
    "python": rf"def\s+{W}+\s*\(([^)]*)\)",
    "c": WORD_AND_CALL + r"([^)]*)\)",
    "java": WORD_AND_CALL + r"([^)]*)\)",
}
DOCUMENTATION = {"python": r'(?s)""".*?"""', "c": r"(?s)/\*\*.*?\*/", "java": r"(?s)/\*\*.*?\*/"}
DOCUMENTATION_MARKS = {"python": '"""', "c": "/**", "java": "/**"}
ANY_FUNCTION = rf"def\s+{W}+|function\s+{W}+|{WORD_AND_CALL}"


def issue(kind: str, severity: str, occurrences: Column | None = None, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        (F.lit(1) if occurrences is None else occurrences).cast("bigint").alias("occurrences"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


NO_ISSUES = "array<struct<kind:string,severity:string,occurrences:bigint,detail:string>>"


def no_issues() -> Column:
    return F.array().cast(NO_ISSUES)


def duplicate_lines(lines: Column) -> Column:
    """Stripped lines of more than ten characters seen more than twice, in order of first sight.

    Sorted, a line seen three times equals the one two places on.
    """

    def repeated(ordered: Column) -> Column:
        later = F.slice(ordered, F.lit(3), F.greatest(F.size(ordered), F.lit(1)))
        return F.array_compact(F.zip_with(ordered, later, lambda a, b: F.when(a == b, a)))

    used = F.filter(F.transform(lines, T.strip), lambda x: F.length(x) > 10)
    return T.let(used, lambda kept: F.array_intersect(kept, T.let(F.array_sort(kept), repeated)))


def magic_numbers(content: Column) -> Column:
    return F.array_distinct(T.matches(content, rf"(?=\d){MAGIC_NUMBER}"))


def long_line_numbers(lines: Column) -> Column:
    numbered = F.transform(lines, lambda x, i: F.when(F.length(x) > LONG_LINE, i + 1))
    return F.array_compact(numbered)


def todo_comments(content: Column) -> Column:
    marked = T.let(F.lower(content), lambda low: T.has(low, *TODO_WORDS))
    return F.when(~marked, F.array().cast("array<string>")).otherwise(T.matches(content, TODO))


def smell_issues(lines: Column, numbers: Column, todos: Column, duplicates: Column) -> Column:
    long_lines = long_line_numbers(lines)
    return T.present(
        (F.size(lines) > 50, issue("long_method", "medium", F.size(lines))),
        (
            F.size(numbers) > 5,
            issue("magic_numbers", "low", F.size(numbers), T.joined(F.slice(F.array_sort(numbers), 1, 10), ",")),
        ),
        (
            F.size(long_lines) > 3,
            issue("long_lines", "low", F.size(long_lines), T.joined(F.slice(long_lines, 1, 10).cast("array<string>"), ",")),
        ),
        (F.size(todos) > 0, issue("todo_comments", "low", F.size(todos), T.joined(F.slice(todos, 1, 5), "|"))),
        (
            F.size(duplicates) > 0,
            issue("duplicate_code", "medium", F.size(duplicates), T.joined(F.slice(duplicates, 1, 5), "|")),
        ),
    )


def security_severity(kind: str) -> str:
    return "high" if kind in ("buffer_overflow", "command_injection") else "medium"


def security_issues(content: Column, language: Column, extra_rules: list[tuple[str, str]] = ()) -> Column:
    """One issue per rule that matches, with its number of hits. Callers may add rules."""
    c_like, python = language.isin("c", "cpp"), language == "python"
    table = rules.rule_array([*rules.SECURITY_RULES, *extra_rules])
    severe = [kind for kind, _ in rules.SECURITY_RULES if security_severity(kind) == "high"]

    def count(rule: Column) -> Column:
        return F.struct(
            rule["category"].alias("kind"),
            F.when(rule["category"].isin(*dict.fromkeys(severe)), "high").otherwise("medium").alias("severity"),
            T.hits(content, rule["pattern"]).alias("occurrences"),
            rule["pattern"].alias("detail"),
        )

    matched = T.let(
        F.lower(content), lambda low: F.transform(F.filter(table, lambda rule: rules.may_match(rule, low)), count)
    )
    special = F.array(
        issue("unchecked_malloc", "medium", c_like & T.found(content, "malloc", UNCHECKED_MALLOC)),
        issue("dangerous_eval", "high", python & content.contains("eval(")),
        issue("unsafe_deserialization", "high", python & content.contains("pickle.loads")),
    )
    return F.filter(F.concat(matched, special), lambda i: i["occurrences"] > 0)


def performance_issues(content: Column, language: Column) -> Column:
    return T.present(
        (T.has(content, "for", "while") & content.contains("(") & content.rlike(NESTED_LOOPS), issue("nested_loops", "medium")),
        (content.contains("for") & T.has(content, "+=", ".append("), issue("inefficient_string_ops", "low")),
        ((language == "python") & T.found(content, ".append(", LIST_BUILDING), issue("inefficient_list_building", "low")),
    )


def parameter_counts(content: Column, language: Column) -> Column:
    """Number of parameters of every function signature found."""
    lists = F.array().cast("array<string>")
    for name, pattern in PARAMETER_LISTS.items():
        lists = F.when(language == name, T.matches(content, pattern, 1)).otherwise(lists)
    return F.transform(lists, lambda p: F.size(F.filter(F.split(p, ","), lambda x: ~is_blank(x))))


def function_marks(content: Column) -> Column:
    """Matches of ANY_FUNCTION.

    No match goes over an opening parenthesis, so the text is cut there. A piece without the two words has a match
    only at its end, which is read backwards from there; prose between calls is never searched.
    """
    backwards = rf"^\s*+{W}++\s++{W}"

    def named(piece: Column) -> Column:
        return T.has(piece, "def", "function")

    def before_call(piece: Column) -> Column:
        call = F.reverse(piece).rlike(backwards).cast("bigint")
        return F.when(named(piece), T.hits(F.concat(piece, F.lit("(")), ANY_FUNCTION)).otherwise(call)

    def counted(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        rest = F.when(named(last), T.hits(last, ANY_FUNCTION)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), rest, lambda total, piece: total + before_call(piece))

    return T.let(F.split(content, r"\("), counted)


def documentation_ratio(content: Column, language: Column) -> Column:
    """Doc comments per function; NULL without functions or for other languages."""
    docs = F.lit(None).cast("bigint")
    for name, pattern in DOCUMENTATION.items():
        docs = F.when(language == name, T.guarded_hits(content, DOCUMENTATION_MARKS[name], pattern)).otherwise(docs)
    return F.when(language.isin(*DOCUMENTATION), F.try_divide(docs, function_marks(content)))


def maintainability_issues(content: Column, language: Column) -> Column:
    crowded = F.filter(parameter_counts(content, language), lambda n: n > 5)
    crowded_issues = F.transform(crowded, lambda n: issue("too_many_parameters", "medium", n))
    undocumented = T.present((documentation_ratio(content, language) < 0.5, issue("missing_documentation", "low")))
    return F.concat(crowded_issues, undocumented)


# -- per-language counts ---------------------------------------------------------

C_FUNCTION = WORD_AND_CALL + r"[^)]*\)\s*\{"
JAVA_METHOD = WORD_AND_CALL
HAS_MAIN = r"int\s+main\s*\("


def c_counts(content: Column) -> dict[str, Column]:
    return {
        "function_count": T.hits(content, C_FUNCTION),
        "include_count": T.hits(content, "#include"),
        "has_main": content.rlike(HAS_MAIN),
    }


def cpp_counts(content: Column) -> dict[str, Column]:
    return {
        **c_counts(content),
        "uses_std_namespace": content.contains("using namespace std"),
        "class_count": T.hits(content, rf"class\s+{W}+"),
        "template_count": T.hits(content, r"template\s*<"),
    }


def java_counts(content: Column) -> dict[str, Column]:
    return {
        "class_count": T.hits(content, rf"class\s+{W}+"),
        "method_count": T.hits(content, JAVA_METHOD),
        "interface_count": T.hits(content, rf"interface\s+{W}+"),
        "package_declared": content.contains("package "),
    }


def javascript_counts(content: Column) -> dict[str, Column]:
    return {
        "function_count": T.hits(content, rf"function\s+{W}+"),
        "arrow_function_count": T.hits(content, "=>"),
        "var_declarations": T.guarded_hits(content, "var", T.WORD_START + r"var\s+"),
        "let_declarations": T.guarded_hits(content, "let", T.WORD_START + r"let\s+"),
        "const_declarations": T.guarded_hits(content, "const", T.WORD_START + r"const\s+"),
    }


def python_counts(facts: Column) -> dict[str, Column]:
    return {
        "function_count": facts["functions"],
        "class_count": facts["classes"],
        "import_count": facts["imports"],
        "comprehension_count": facts["comprehensions"],
    }


# Language -> counts. Callers may add entries.
LANGUAGE_COUNTS = {"c": c_counts, "cpp": cpp_counts, "java": java_counts, "javascript": javascript_counts}


def language_count_columns(content: Column, language: Column, counters: dict | None = None) -> list[Column]:
    """One nullable column per count, filled for the languages that have it."""
    arms: dict[str, Column] = {}
    for name, counter in (counters or LANGUAGE_COUNTS).items():
        for key, value in counter(content).items():
            arms[key] = F.when(language == name, value) if key not in arms else arms[key].when(language == name, value)
    return [column.alias(key) for key, column in arms.items()]


def python_smells(content: Column, facts: Column) -> Column:
    valid = facts["parses"]
    return T.present(
        (valid & content.contains("import *"), issue("wildcard_import", "medium")),
        (valid & content.rlike(r"except\s*:"), issue("bare_except", "medium")),
        (~valid, issue("syntax_error", "high")),
    )


# -- whole score -----------------------------------------------------------------


def score_code(df: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """Metrics, issue lists, overall score (0-10) and recommendations of every text."""
    text, lang = F.col(content), F.col(language)
    base = with_python_facts(with_lines(df, content), content, language)
    base = base.withColumn("numbers", magic_numbers(text)).withColumn("todos", todo_comments(text))
    base = base.withColumn("duplicates", duplicate_lines(F.col("lines")))
    found = base.select(
        "*",
        *line_metrics(text, F.col("lines")),
        cyclomatic(text).alias("cyclomatic_complexity"),
        brace_depth(text).alias("max_nesting_depth"),
        F.concat(
            smell_issues(F.col("lines"), F.col("numbers"), F.col("todos"), F.col("duplicates")),
            F.when(lang == "python", python_smells(text, F.col("py"))).otherwise(no_issues()),
            T.present(
                ((lang == "javascript") & T.found(text, "var", T.WORD_START + r"var\s+"), issue("var_usage", "low")),
            ),
        ).alias("code_smells"),
        F.concat(
            security_issues(text, lang),
            T.present(
                (lang.isin("c", "cpp") & (T.guarded_hits(text, "malloc", MALLOC) > T.guarded_hits(text, "free", FREE)), issue("memory_leak", "medium")),
            ),
        ).alias("security_issues"),
        performance_issues(text, lang).alias("performance_issues"),
        maintainability_issues(text, lang).alias("maintainability_issues"),
    )
    raw = (
        F.lit(10.0)
        - F.size("code_smells") * 0.3
        - F.size("security_issues") * 1.0
        - F.size("performance_issues") * 0.5
        - F.size("maintainability_issues") * 0.2
    )
    complexity = F.col("cyclomatic_complexity")
    raw = raw - F.when(complexity > 20, 2.0).when(complexity > 10, 1.0).otherwise(0.0)
    raw = raw + F.when(F.col("comment_ratio") > 0.2, 0.5).otherwise(0.0)
    return found.withColumn("overall_score", clamp(raw, 0.0, 10.0)).withColumn("recommendations", recommendations()).drop(
        "lines", "numbers", "todos", "duplicates", "py"
    )


def recommendations() -> Column:
    security, slow = F.size("security_issues") > 0, F.size("performance_issues") > 0
    smelly = F.size("code_smells") > 3
    return T.present(
        (security, "Review and fix security vulnerabilities"),
        (security, "Enable static analysis tools for security scanning"),
        (slow, "Optimize performance-critical sections"),
        (slow, "Consider algorithmic improvements"),
        (smelly, "Refactor code to reduce complexity"),
        (smelly, "Break down large functions into smaller ones"),
        (F.col("cyclomatic_complexity") > 15, "Reduce cyclomatic complexity through refactoring"),
        (F.col("comment_ratio") < 0.1, "Add more documentation and comments"),
    )


ISSUE_LISTS = ("code_smells", "security_issues", "performance_issues", "maintainability_issues")


def issue_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """The four issue lists as rows."""

    def tagged(name: str) -> Column:
        return F.transform(name, lambda x: F.struct(F.lit(name).alias("category"), x.alias("issue")))

    return scored.select(*keys, F.explode(F.concat(*[tagged(name) for name in ISSUE_LISTS])).alias("i")).select(*keys, "i.category", "i.issue.*")


def corpus_quality(content: Column, lines: Column) -> Column:
    """Struct of the corpus-level quality figures and score (0-10)."""
    total, code = total_lines(lines), count_lines(lines, lambda x: ~is_blank(x))
    comments, long_lines = count_lines(lines, is_comment), count_lines(lines, lambda x: F.length(x) > LONG_LINE)
    share = comments / F.greatest(code, F.lit(1))
    length = mean_line_length(content, lines)
    score = (
        F.lit(10.0)
        - F.when(long_lines > total * 0.1, 1.0).otherwise(0.0)
        + F.when(share > 0.2, 0.5).when(share < 0.05, -1.0).otherwise(0.0)
        - F.when((length > 100) | (length < 10), 0.5).otherwise(0.0)
    )
    return F.struct(
        total.alias("total_lines"),
        code.alias("code_lines"),
        comments.alias("comment_lines"),
        share.alias("comment_ratio"),
        length.alias("average_line_length"),
        long_lines.alias("long_lines"),
        (total - code - comments).alias("empty_lines"),
        clamp(score, 0.0, 10.0).alias("quality_score"),
    )


def language_of_path(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return rules.lookup(extension, rules.LANGUAGE_OF_EXTENSION, "unknown")


# -- imports ---------------------------------------------------------------------

IMPORTS = {
    "c": r"""#include\s*[<"]([^>"]+)[>"]""",
    "cpp": r"""#include\s*[<"]([^>"]+)[>"]""",
    "python": rf"import\s+{W}+|from\s+{W}+\s+import",
    "java": r"import\s+([^;]+);",
    "javascript": r"""(?d)import.*?from\s+['"][^'"]+['"]|require\(['"][^'"]+['"]\)""",
}


def imports(content: Column, language: Column) -> Column:
    """Distinct imported names, sorted."""
    python = F.transform(T.matches(content, IMPORTS["python"]), lambda m: F.regexp_extract(m, rf"^(?:import|from)\s+({W}+)", 1))
    script = F.transform(T.matches(content, IMPORTS["javascript"]), lambda m: F.regexp_extract(m, r"""['"]([^'"]+)['"]\)?$""", 1))
    found = (
        F.when(language.isin("c", "cpp"), T.matches(content, IMPORTS["c"], 1))
        .when(language == "python", python)
        .when(language == "java", T.matches(content, IMPORTS["java"], 1))
        .when(language == "javascript", script)
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_sort(F.array_distinct(found))


# -- functions -------------------------------------------------------------------

# Words and blanks up to an opening parenthesis, started only where such a run starts: one
# pass over any text. The definition is the second group, after the blanks of the run.
RUN = r"[\p{L}\p{N}_\s]"
C_DEFINITION = rf"(?<!{RUN})(\s*+)({W}{RUN}*+\([^)]*+\)\s*+\{{)"
C_NAME = rf"{T.WORD_START}({W}++\s++)?({W}++)\s*+\("
DEFINITIONS = {
    "c": C_DEFINITION,
    "cpp": C_DEFINITION,
    "python": rf"def\s+({W}+)\s*\([^)]*\):",
    "java": rf"(?:(?=\s)|{T.WORD_START})(?:public|private|protected)?\s*(?:static\s+)?({W}++)\s++({W}++)\s*+\([^)]*\)",
    "javascript": rf"function\s+({W}+)\s*\([^)]*\)",
}
# Private-use characters: definition start, definition end, first text of a line, and a
# definition end with more text on its line.
OPENS, CLOSES, FILLED, FULL = "\ue000", "\ue001", "\ue002", "\ue003"
# One look at what a token can start with spares most characters the alternatives.
TOKEN_STARTS = rf"(?=[{OPENS}{CLOSES}{FULL}{{}}\ncefisw&|?])"
TOKEN = rf"{TOKEN_STARTS}(?:{OPENS}(?=([^{CLOSES}{FULL}]*))|{CLOSES}[^\S\n]*|{FULL}|[{{}}]|\n[^\S\n]*{FILLED}?|{FUNCTION_DECISIONS})"


def by_language(language: Column, value, otherwise: Column) -> Column:
    """CASE over the languages with a definition pattern."""
    out = F.when(language.isin("c", "cpp"), value(DEFINITIONS["c"], True))
    for name in ("python", "java", "javascript"):
        out = out.when(language == name, value(DEFINITIONS[name], False))
    return out.otherwise(otherwise)


def parameters(signature: Column) -> Column:
    """Last word of every comma-separated part between the outer parentheses."""
    inside = T.strip(F.regexp_extract(signature, r"(?s)\((.*)\)", 1))
    parts = F.filter(F.transform(F.split(inside, ","), T.strip), lambda p: p != "")
    names = F.transform(parts, lambda p: F.regexp_extract(p, r"(\S+)$", 1))
    return F.when(inside == "void", F.array().cast("array<string>")).otherwise(names)


def definitions(content: Column, language: Column) -> Column:
    return by_language(language, lambda p, c: T.matches(content, p, 2 if c else 0), F.array().cast("array<string>"))


def signature_columns(sig: Column, lang: Column) -> list[Column]:
    """Name, return type and parameter names of a definition text."""
    return [
        F.when(lang.isin("c", "cpp"), F.regexp_extract(sig, C_NAME, 2))
        .when(lang == "java", F.regexp_extract(sig, DEFINITIONS["java"], 2))
        .when(lang == "python", F.regexp_extract(sig, DEFINITIONS["python"], 1))
        .otherwise(F.regexp_extract(sig, DEFINITIONS["javascript"], 1))
        .alias("name"),
        F.when(lang.isin("c", "cpp"), F.coalesce(T.first(sig, C_NAME, 1), F.lit("void")))
        .when(lang == "java", F.regexp_extract(sig, DEFINITIONS["java"], 1))
        .otherwise("unknown")
        .alias("return_type"),
        parameters(sig).alias("parameters"),
    ]


def definition_rows(df: DataFrame, key: str, content: str = "content", language: str = "language") -> DataFrame:
    """One row per function definition, without its body."""
    lang = F.col(language)
    rows = df.select(key, language, F.posexplode(definitions(F.col(content), lang)).alias("ordinal", "signature"))
    return rows.select(key, language, "ordinal", *signature_columns(F.col("signature"), lang))


def function_tokens(df: DataFrame, key: str, content: str = "content", language: str = "language") -> DataFrame:
    """Marks, braces, line starts and branch words of texts that define functions, in order.

    A definition's opening mark carries the definition text.
    """
    lang = F.col("language")
    text = F.translate(F.col(content), OPENS + CLOSES + FILLED + FULL, "")

    def mark(pattern: str, led: bool) -> Column:
        if led:
            return F.regexp_replace(text, pattern, f"$1{OPENS}$2{CLOSES}")
        return F.regexp_replace(text, f"({pattern})", f"{OPENS}$1{CLOSES}")

    marked = by_language(F.col(language), mark, F.lit(None))
    marked = F.regexp_replace(marked, rf"\n([^\S\n]*)(?=\S)", f"\n$1{FILLED}")
    marked = F.regexp_replace(marked, rf"{CLOSES}(?=[^\S\n]*\S)", FULL)
    rows = df.select(key, F.col(language).alias("language"), marked.alias("marked"))
    defines = F.col("marked").contains(OPENS)
    rows = rows.select(
        key,
        "language",
        F.when(defines, T.matches(F.col("marked"), TOKEN)).alias("tokens"),
        F.when(defines, T.matches(F.col("marked"), TOKEN, 1)).alias("signatures"),
    )
    margins = F.array_distinct(
        F.transform(F.filter("tokens", lambda t: t.startswith(CLOSES)), lambda t: F.length(t) - 1)
    )
    return rows.select(
        key,
        "language",
        F.when(lang == "python", margins).alias("margins"),
        F.posexplode(F.arrays_zip("tokens", "signatures")).alias("pos", "t"),
    ).select(
        key, "language", "margins", "pos", F.col("t.tokens").alias("token"),
        F.translate("t.signatures", FILLED, "").alias("signature"),
    )


def function_table(df: DataFrame, key: str = "doc_id", content: str = "content", language: str = "language") -> DataFrame:
    """Every function with its line, body length, complexity and parameters.

    A body in braces runs from the end of the definition to the first closing brace that
    brings the depth back to where it was; a Python body to the first line that is not
    indented beyond the rest of the definition line. Both are "the next row with my key":
    one ordered window per (text, key) instead of pairing functions with braces. One
    shuffle by text serves all windows and the final grouping.
    """
    token, python = F.col("token"), F.col("language") == "python"
    starts, ends = token == OPENS, token.startswith(CLOSES) | (token == FULL)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)

    def running(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).over(order)

    is_line = token.startswith("\n")
    is_branch = ~(starts | ends | is_line | token.isin("{", "}"))
    # The text is dealt by its key before it is cut: smaller than its tokens, and the windows need no shuffle after it.
    dealt = df.select(key, content, language).repartition(key)
    numbered = function_tokens(dealt, key, content, language).select(
        "*",
        F.sum(F.when(token == "{", 1).when(token == "}", -1).otherwise(0)).over(order).alias("depth"),
        running(is_line).alias("line"),
        running(is_branch).alias("branches"),
        F.when(starts, running(starts) - 1).when(ends, running(ends) - 1).cast("int").alias("ordinal"),
        F.sum(F.when(is_line, 1).otherwise(0)).over(whole).alias("all_lines"),
        F.sum(F.when(is_branch, 1).otherwise(0)).over(whole).alias("all_branches"),
    )
    margin = F.length(token) - 1
    no_stop = F.array(F.lit(-1))
    keys = (
        F.when(starts | (token == FULL) & python, no_stop)
        .when(python & is_line & token.endswith(FILLED), F.filter("margins", lambda m: m >= F.length(token) - 2))
        .when(python & ends, F.array(margin))
        .when(~python & ((token == "}") | ends), F.array(F.col("depth").cast("int")))
    )
    stop = F.when(~ends & ~starts, F.struct("line", "branches"))
    onward = Window.partitionBy(key, "k").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    ranged = (
        numbered.withColumn("k", F.explode(keys))
        .withColumn("stop", F.last(stop, ignorenulls=True).over(onward))
        .filter(starts | ends)
    )
    # Lines of a Python body: up to the line before the stop, or to the end of the text.
    python_lines = F.coalesce(F.col("stop.line"), F.col("all_lines") + 1) - F.col("line")
    empty = F.when(python, (token == FULL) | ((python_lines == 1) & (margin == 0))).otherwise(F.col("stop").isNull())
    python_branches = F.coalesce(F.col("stop.branches"), F.col("all_branches")) - F.col("branches")
    body_lines = F.when(empty, 0).when(python, python_lines).otherwise(F.col("stop.line") - F.col("line") + 1)
    complexity = F.when(empty, 1).otherwise(
        F.when(python, python_branches).otherwise(F.col("stop.branches") - F.col("branches")) + 1
    )
    functions = ranged.groupBy(key, "language", "ordinal").agg(
        F.max(F.when(starts, F.col("signature"))).alias("signature"),
        F.max(F.when(starts, F.col("line") + 1)).alias("line_number"),
        F.max(F.when(ends, body_lines)).cast("bigint").alias("body_lines"),
        F.max(F.when(ends, complexity)).cast("bigint").alias("complexity"),
    )
    return functions.select(
        key,
        "language",
        "ordinal",
        *signature_columns(F.col("signature"), F.col("language")),
        "line_number",
        "body_lines",
        "complexity",
    )


# -- located rules ---------------------------------------------------------------


def located_rules(df: DataFrame, key: str, content: str = "content", language: str = "language") -> DataFrame:
    """Hits of the per-language rules with line number and two lines of context on each side.

    The context is cut out before the hits become rows, so no row carries the text.
    """
    text, lang = F.col(content), F.col(language)
    table = F.filter(rules.rule_array(rules.SOURCE_RULES), lambda rule: rule["label"] == lang)

    def describe(rule: Column, hit: Column, lines: Column) -> Column:
        first = F.greatest(hit["line"] - 3, F.lit(0))
        around = F.slice(lines, (first + 1).cast("int"), (hit["line"] + 2 - first).cast("int"))
        return F.struct(
            rule["category"].alias("category"),
            rule["pattern"].alias("pattern"),
            hit["line"].alias("line_number"),
            hit["match"].alias("match"),
            T.joined(around, "\n").alias("context"),
        )

    used = T.let(F.lower(text), lambda low: F.filter(table, lambda rule: rules.may_match(rule, low)))
    hits = T.let(
        T.lines(text),
        lambda lines: F.transform(
            used, lambda rule: F.transform(T.located(text, rule["pattern"]), lambda hit: describe(rule, hit, lines))
        ),
    )
    return df.select(key, F.explode(F.flatten(hits)).alias("hit")).select(key, "hit.*")


def finding_type(category: Column) -> Column:
    """The category when it is a known vulnerability type, else ``unknown``."""
    return F.when(category.isin(*rules.VULNERABILITY_TYPES), category).otherwise("unknown")


# -- generated files -------------------------------------------------------------


def is_generated(path: Column) -> Column:
    """C or C++ files whose name says fuzz, or says test before a ``.c`` extension."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return name.rlike(r"\.(c|cpp|cc)$") & (name.contains("fuzz") | name.rlike(r"test.*\.c"))


def file_metrics(content: Column) -> list[Column]:
    return [
        total_lines(T.lines(content)).alias("lines"),
        F.length(content).cast("bigint").alias("size_chars"),
        content.contains("int main").alias("has_main"),
        content.contains("LLVMFuzzerTestOneInput").alias("has_fuzz_target"),
        T.literal_count(content, "#include").alias("includes_count"),
    ]
