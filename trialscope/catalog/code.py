"""Queries over source texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..functions import text as T
from ..operators import code
from . import sql as S
from .registry import query

C = "content"
ORIGINAL = {
    code.PARAMETER_LISTS["c"]: rf"{T.WORD}+\s+{T.WORD}+\s*\(([^)]*)\)",
    code.ANY_FUNCTION: rf"def\s+{T.WORD}+|function\s+{T.WORD}+|{T.WORD}+\s+{T.WORD}+\s*\(",
    code.C_FUNCTION: rf"{T.WORD}+\s+{T.WORD}+\s*\([^)]*\)\s*\{{",
    code.JAVA_METHOD: rf"(public|private|protected)?\s*(static\s+)?{T.WORD}+\s+{T.WORD}+\s*\(",
    code.DEFINITIONS["c"]: rf"({T.WORD}+\s+)*({T.WORD}+)\s*\([^)]*\)\s*\{{",
    code.DEFINITIONS["java"]: rf"(?:public|private|protected)?\s*(?:static\s+)?({T.WORD}+)\s+({T.WORD}+)\s*\([^)]*\)",
}


def original(pattern: str) -> str:
    """The pattern without the anchors and possessive repeats that only the JVM knows."""
    return ORIGINAL.get(pattern, pattern)


W = T.WORD
LINES = f"string_split({C}, chr(10))"
STRIPPED = S.strip("x")
LEFT = f"ltrim(x, {S.BLANKS})"
COMMENT = f"(starts_with({LEFT}, '#') or starts_with({LEFT}, '//') or starts_with({LEFT}, '/*'))"
BASE = (
    f"b as (select *, {LINES} as lines, {S.spaced(C)} as spaced from source_files), "
    f"m as (select *, cast(len(lines) as bigint) as total_lines, cast(len([x for x in lines if {STRIPPED} <> '']) as bigint) as lines_of_code, "
    f"cast(len([x for x in lines if {COMMENT}]) as bigint) as comment_lines, "
    f"cast(len([x for x in lines if {STRIPPED} = '']) as bigint) as blank_lines, "
    "list_avg([length(x) for x in lines]) as average_line_length, list_max([length(x) for x in lines]) as max_line_length, "
    f"{S.wc('spaced', code.BRANCH_WORDS + '|catch')} + {S.rc(C, code.BRANCH_SIGNS)} + 1 as cyclomatic_complexity from b)"
)


def src(select: str, ctes: str = "") -> str:
    return oracle("source_files", f"with {BASE}{', ' + ctes if ctes else ''} {select}")


def files(spark, sf):
    return view(spark, sf, "source_files")


@query(
    "sc40_line_metrics",
    src(
        "select doc_id, total_lines, lines_of_code, comment_lines, blank_lines, round(average_line_length, 6) as average_line_length, "
        "max_line_length, round(comment_lines / cast(total_lines as double), 9) as comment_ratio from m"
    ),
)
def _(spark, sf):
    df = code.with_lines(files(spark, sf))
    return (
        df.select("doc_id", *code.line_metrics(F.col(C), F.col("lines")))
        .withColumn("average_line_length", F.round("average_line_length", 6))
        .withColumn("comment_ratio", F.round("comment_ratio", 9))
    )


@query("sc41_cyclomatic_complexity", src("select doc_id, cyclomatic_complexity from m"))
def _(spark, sf):
    return files(spark, sf).select("doc_id", code.cyclomatic(F.col(C)).alias("cyclomatic_complexity"))


DEPTH = (
    "br as (select doc_id, regexp_replace(content, '[^{}]+', '', 'g') as t from source_files), "
    "st as (select doc_id, i, case when substr(t, i, 1) = '{' then 1 else -1 end as d from (select doc_id, t, unnest(range(1, length(t) + 1)) as i from br) u), "
    "rs as (select doc_id, i, sum(d) over (partition by doc_id order by i) as s from st), "
    "fl as (select doc_id, s - least(0, min(s) over (partition by doc_id order by i)) as depth from rs), "
    "dp as (select doc_id, cast(coalesce(max(depth), 0) as bigint) as depth from br left join fl using (doc_id) group by doc_id)"
)


@query("sc42_brace_depth", src("select doc_id, depth from dp", DEPTH))
def _(spark, sf):
    return files(spark, sf).select("doc_id", code.brace_depth(F.col(C)).alias("depth"))


@query(
    "sc43_python_nesting",
    src(
        f"select doc_id, language, cast(case when language = 'python' then coalesce(list_max([length(x) - length({LEFT}) for x in lines if {STRIPPED} <> '']), 0) // 4 "
        "else depth end as bigint) as nesting_depth from m join dp using (doc_id)",
        DEPTH,
    ),
)
def _(spark, sf):
    df = code.with_lines(files(spark, sf))
    return df.select(
        "doc_id", "language", code.nesting_depth(F.col(C), F.col("lines"), F.col("language")).alias("nesting_depth")
    )


TODO_SQL = S.rall(C, code.TODO)
NUMBERS_SQL = rf"list_distinct([x for x in regexp_extract_all(content, '{W}+') if regexp_full_match(x, '\d{{3,}}')])"
DUP = (
    f"dl as (select doc_id, x, min(i) as first_at, count(*) as n from (select doc_id, {STRIPPED.replace('(x,', '(lines[i],')} as x, i from "
    "(select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from b) u) v where length(x) > 10 group by doc_id, x having count(*) > 2), "
    "dd as (select doc_id, count(*) as n, string_agg(x, '|' order by first_at) filter (where r <= 5) as first_five from "
    "(select *, row_number() over (partition by doc_id order by first_at) as r from dl) w group by doc_id)"
)


@query(
    "ag22_duplicate_lines",
    oracle(
        "text_files",
        "with b as (select *, string_split(content, chr(10)) as lines from text_files), " + DUP + " select doc_id, n as duplicates, first_five from dd",
    ),
)
def _(spark, sf):
    df = code.with_lines(view(spark, sf, "text_files"))
    found = df.select("doc_id", code.duplicate_lines(F.col("lines")).alias("d"))
    return found.filter(F.size("d") > 0).select(
        "doc_id", F.size("d").cast("bigint").alias("duplicates"), T.joined(F.slice("d", 1, 5)).alias("first_five")
    )


@query(
    "ag31_distinct_magic_numbers",
    oracle(
        "text_files",
        f"select doc_id, cast(len(n) as bigint) as numbers, array_to_string(list_sort(n)[1:10], ',') as first_ten from (select doc_id, {NUMBERS_SQL} as n from text_files) t",
    ),
)
def _(spark, sf):
    numbers = code.magic_numbers(F.col(C))
    return view(spark, sf, "text_files").select(
        "doc_id", F.size(numbers).cast("bigint").alias("numbers"), T.joined(F.slice(F.array_sort(numbers), 1, 10), ",").alias("first_ten")
    )


LONG = "[i for i in range(1, len(lines) + 1) if length(lines[i]) > 120]"
SMELLS = (
    DUP
    + f", q as (select m.*, {NUMBERS_SQL} as numbers, {TODO_SQL} as todos, {LONG} as longs, coalesce(dd.n, 0) as dups, dd.first_five from m left join dd using (doc_id)), "
    "sm as ("
    "select doc_id, 'long_method' as kind, 'medium' as severity, total_lines as occurrences, cast(null as varchar) as detail from q where total_lines > 50 union all "
    "select doc_id, 'magic_numbers', 'low', len(numbers), array_to_string(list_sort(numbers)[1:10], ',') from q where len(numbers) > 5 union all "
    "select doc_id, 'long_lines', 'low', len(longs), array_to_string(longs[1:10], ',') from q where len(longs) > 3 union all "
    "select doc_id, 'todo_comments', 'low', len(todos), array_to_string(todos[1:5], '|') from q where len(todos) > 0 union all "
    "select doc_id, 'duplicate_code', 'medium', dups, first_five from q where dups > 0)"
)


@query("sc44_code_smells", src("select doc_id, kind, severity, cast(occurrences as bigint) as occurrences, detail from sm", SMELLS))
def _(spark, sf):
    df = code.with_lines(files(spark, sf))
    smells = code.smell_issues(
        F.col("lines"), code.magic_numbers(F.col(C)), code.todo_comments(F.col(C)), code.duplicate_lines(F.col("lines"))
    )
    return df.select("doc_id", F.explode(smells).alias("i")).select("doc_id", "i.*")


def rule_union(rule_rows, source: str) -> str:
    return " union all ".join(
        f"select doc_id, '{kind}' as kind, '{code.security_severity(kind)}' as severity, cast({S.rc(C, pattern)} as bigint) as occurrences "
        f"from {source} where {S.rl(C, pattern)}"
        for kind, pattern in rule_rows
    )


# Without lookahead: a malloc call counts when what follows is not an if.
MALLOC_CALL = r"malloc\s*\([^)]*\)(\s*;?\s*)(if)?"
SECURITY = (
    "se as ("
    + rule_union(rules.SECURITY_RULES, "source_files")
    + f" union all select doc_id, 'unchecked_malloc', 'medium', 1 from source_files where language in ('c','cpp') and "
    f"len([x for x in {S.rall(C, MALLOC_CALL, 2)} if x = '']) > 0"
    f" union all select doc_id, 'dangerous_eval', 'high', 1 from source_files where language = 'python' and contains(content, 'eval(')"
    f" union all select doc_id, 'unsafe_deserialization', 'high', 1 from source_files where language = 'python' and contains(content, 'pickle.loads'))"
)


@query("sc45_security_rules", src("select doc_id, kind, severity, cast(occurrences as bigint) as occurrences from se", SECURITY))
def _(spark, sf):
    issues = code.security_issues(F.col(C), F.col("language"))
    return files(spark, sf).select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.kind", "i.severity", "i.occurrences")


@query(
    "jn2_text_rule_hits",
    oracle(
        "source_files",
        "with r as ("
        + rule_union(rules.SECURITY_RULES, "source_files")
        + ") select kind, severity, count(*) as texts, cast(sum(occurrences) as bigint) as hits from r group by kind, severity",
    ),
)
def _(spark, sf):
    issues = code.security_issues(F.col(C), F.lit("any"))
    rows = files(spark, sf).select(F.explode(issues).alias("i")).select("i.*")
    return rows.groupBy("kind", "severity").agg(F.count("*").alias("texts"), F.sum("occurrences").alias("hits"))


PERFORMANCE = (
    "pf as ("
    f"select doc_id, 'nested_loops' as kind, 'medium' as severity from source_files where {S.rl(C, code.NESTED_LOOPS)} union all "
    f"select doc_id, 'inefficient_string_ops', 'low' from source_files where contains(content, 'for') and {S.has(C, '+=', '.append(')} union all "
    f"select doc_id, 'inefficient_list_building', 'low' from source_files where language = 'python' and {S.rl(C, code.LIST_BUILDING)})"
)


@query("sc46_performance_issues", src("select doc_id, kind, severity from pf", PERFORMANCE))
def _(spark, sf):
    issues = code.performance_issues(F.col(C), F.col("language"))
    return files(spark, sf).select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.kind", "i.severity")


def case_lang(rows: dict, value) -> str:
    return "case language " + " ".join(f"when '{k}' then {value(p)}" for k, p in rows.items()) + " end"


PARAMS = case_lang(code.PARAMETER_LISTS, lambda p: S.rall(C, original(p), 1))
DOCS = case_lang(code.DOCUMENTATION, lambda p: S.rc(C, p))
MAINTAIN = (
    f"pc as (select doc_id, unnest([len([y for y in string_split(x, ',') if trim(y, {S.BLANKS}) <> '']) for x in {PARAMS}]) as n from source_files), "
    f"dr as (select doc_id, {DOCS} / cast(nullif({S.rc(C, original(code.ANY_FUNCTION))}, 0) as double) as ratio from source_files), "
    "mt as (select doc_id, 'too_many_parameters' as kind, 'medium' as severity, n as occurrences from pc where n > 5 union all "
    "select doc_id, 'missing_documentation', 'low', 1 from dr where ratio < 0.5)"
)


@query("sc47_maintainability_issues", src("select doc_id, kind, severity, cast(occurrences as bigint) as occurrences from mt", MAINTAIN))
def _(spark, sf):
    issues = code.maintainability_issues(F.col(C), F.col("language"))
    return files(spark, sf).select("doc_id", F.explode(issues).alias("i")).select("doc_id", "i.kind", "i.severity", "i.occurrences")


def decl(word: str) -> str:
    return rf"len(regexp_extract_all(spaced, '(?:^|{S.NOT_WORD}){word}\s'))"


def only(languages: str, value: str) -> str:
    return f"case when language in ({languages}) then {value} end"


CLASS = S.rc(C, rf"class\s+{W}+")
COUNTS = (
    f"case language when 'c' then {S.rc(C, original(code.C_FUNCTION))} when 'cpp' then {S.rc(C, original(code.C_FUNCTION))} when 'javascript' then {S.rc(C, rf'function\s+{W}+')} end as function_count, "
    f"{only(chr(39) + 'c' + chr(39) + ',' + chr(39) + 'cpp' + chr(39), S.rc(C, '#include'))} as include_count, "
    f"case when language in ('c','cpp') then {S.rl(C, code.HAS_MAIN)} end as has_main, "
    f"case when language = 'cpp' then contains(content, 'using namespace std') end as uses_std_namespace, "
    f"case when language in ('cpp','java') then {CLASS} end as class_count, "
    f"case when language = 'cpp' then {S.rc(C, r'template\s*<')} end as template_count, "
    f"case when language = 'java' then {S.rc(C, original(code.JAVA_METHOD))} end as method_count, "
    f"case when language = 'java' then {S.rc(C, rf'interface\s+{W}+')} end as interface_count, "
    f"case when language = 'java' then contains(content, 'package ') end as package_declared, "
    f"case when language = 'javascript' then {S.rc(C, '=>')} end as arrow_function_count, "
    f"case when language = 'javascript' then {decl('var')} end as var_declarations, "
    f"case when language = 'javascript' then {decl('let')} end as let_declarations, "
    f"case when language = 'javascript' then {decl('const')} end as const_declarations"
)


@query("sc48_language_counts", src(f"select doc_id, language, {COUNTS} from m where language <> 'python'"))
def _(spark, sf):
    df = files(spark, sf)
    counts = code.language_count_columns(F.col(C), F.col("language"))
    return df.filter("language <> 'python'").select("doc_id", "language", *counts)


# The registry with a caller's entry in place of one of its own: it fills a count that others have and adds one.
@query(
    "ud3_added_counter",
    src(
        f"select doc_id, language, case language when 'java' then {S.rc(C, 'public static')} when 'javascript' then {S.rc(C, rf'function\s+{W}+')} end as function_count, "
        f"case when language = 'java' then contains(content, 'executeQuery') end as queries from m where language in ('java', 'javascript')"
    ),
)
def _(spark, sf):
    added = {
        "javascript": code.javascript_counts,
        "java": lambda content: {"function_count": T.hits(content, "public static"), "queries": content.contains("executeQuery")},
    }
    counts = code.language_count_columns(F.col(C), F.col("language"), added)
    rows = files(spark, sf).filter(F.col("language").isin("java", "javascript"))
    return rows.select("doc_id", "language", *counts).select("doc_id", "language", "function_count", "queries")


SCORES = (
    f"{SMELLS}, {SECURITY}, {PERFORMANCE}, {MAINTAIN}, {DEPTH}, "
    f"ex as (select doc_id, {S.rc(C, code.MALLOC)} > {S.rc(C, code.FREE)} as leaks, {decl('var')} > 0 as vars from b), "
    "cn as (select m.*, depth, (select count(*) from sm where sm.doc_id = m.doc_id) + cast(language = 'javascript' and vars as int) as smells, "
    "(select count(*) from se where se.doc_id = m.doc_id) + cast(language in ('c','cpp') and leaks as int) as risks, "
    "(select count(*) from pf where pf.doc_id = m.doc_id) as slow, (select count(*) from mt where mt.doc_id = m.doc_id) as upkeep "
    "from m join ex using (doc_id) join dp using (doc_id)), "
    "sc as (select *, 10.0::double - smells * 0.3::double - risks * 1.0::double - slow * 0.5::double - upkeep * 0.2::double "
    "- (case when cyclomatic_complexity > 20 then 2.0::double when cyclomatic_complexity > 10 then 1.0::double else 0.0::double end) "
    "+ (case when comment_lines / cast(total_lines as double) > 0.2 then 0.5::double else 0.0::double end) as raw from cn where language <> 'python')"
)
RECOMMEND = (
    "array_to_string([x for x in [case when risks > 0 then 'Review and fix security vulnerabilities' end, "
    "case when risks > 0 then 'Enable static analysis tools for security scanning' end, "
    "case when slow > 0 then 'Optimize performance-critical sections' end, case when slow > 0 then 'Consider algorithmic improvements' end, "
    "case when smells > 3 then 'Refactor code to reduce complexity' end, case when smells > 3 then 'Break down large functions into smaller ones' end, "
    "case when cyclomatic_complexity > 15 then 'Reduce cyclomatic complexity through refactoring' end, "
    "case when comment_lines / cast(total_lines as double) < 0.1 then 'Add more documentation and comments' end] if x is not null], '|')"
)


def counted(df):
    return df.select("*", *[F.size(name).cast("bigint").alias(f"n_{name}") for name in code.ISSUE_LISTS])


@query(
    "sc50_overall_score",
    src(
        "select doc_id, smells as n_code_smells, risks as n_security_issues, slow as n_performance_issues, upkeep as n_maintainability_issues, "
        "cyclomatic_complexity, depth as max_nesting_depth, round(least(greatest(raw, 0.0::double), 10.0::double), 6) as overall_score from sc",
        SCORES,
    ),
)
def _(spark, sf):
    scored = counted(code.score_code(files(spark, sf))).filter("language <> 'python'")
    return scored.select(
        "doc_id",
        *[f"n_{name}" for name in code.ISSUE_LISTS],
        "cyclomatic_complexity",
        "max_nesting_depth",
        F.round("overall_score", 6).alias("overall_score"),
    )


@query("sc50_overall_score_python")
def _(spark, sf):
    scored = counted(code.score_code(files(spark, sf))).filter("language = 'python'")
    return scored.select("doc_id", *[f"n_{name}" for name in code.ISSUE_LISTS], F.round("overall_score", 6).alias("overall_score"))


@query("sc51_recommendations", src(f"select doc_id, {RECOMMEND} as recommendations from sc", SCORES))
def _(spark, sf):
    scored = code.score_code(files(spark, sf)).filter("language <> 'python'")
    return scored.select("doc_id", T.joined(F.col("recommendations")).alias("recommendations"))


@query(
    "set1_issue_union",
    src(
        "select category, kind, severity, count(*) as issues, count(distinct doc_id) as texts from ("
        "select doc_id, 'code_smells' as category, kind, severity from sm union all select doc_id, 'security_issues', kind, severity from se union all "
        "select doc_id, 'performance_issues', kind, severity from pf union all select doc_id, 'maintainability_issues', kind, severity from mt union all "
        "select doc_id, 'code_smells', 'var_usage', 'low' from cn where language = 'javascript' and doc_id in (select doc_id from ex where vars) union all "
        "select doc_id, 'security_issues', 'memory_leak', 'medium' from cn where language in ('c','cpp') and doc_id in (select doc_id from ex where leaks)"
        ") u where doc_id in (select doc_id from m where language <> 'python') group by category, kind, severity",
        SCORES,
    ),
)
def _(spark, sf):
    scored = code.score_code(files(spark, sf)).filter("language <> 'python'")
    return code.issue_rows(scored, "doc_id").groupBy("category", "kind", "severity").agg(
        F.count("*").alias("issues"), F.countDistinct("doc_id").alias("texts")
    )


LONGS = "len([x for x in lines if length(x) > 120])"
SHARE = "comment_lines / cast(greatest(lines_of_code, 1) as double)"


@query(
    "sc52_corpus_quality",
    src(
        f"select doc_id, total_lines, lines_of_code as code_lines, comment_lines, round({SHARE}, 9) as comment_ratio, "
        f"round(average_line_length, 6) as average_line_length, {LONGS} as long_lines, total_lines - lines_of_code - comment_lines as empty_lines, "
        f"round(least(greatest(10.0::double - (case when {LONGS} > total_lines * 0.1::double then 1.0 else 0.0 end) "
        f"+ (case when {SHARE} > 0.2 then 0.5 when {SHARE} < 0.05 then -1.0 else 0.0 end) "
        "- (case when average_line_length > 100 or average_line_length < 10 then 0.5 else 0.0 end), 0.0::double), 10.0::double), 6) as quality_score from m"
    ),
)
def _(spark, sf):
    df = code.with_lines(files(spark, sf))
    quality = df.select("doc_id", code.corpus_quality(F.col(C), F.col("lines")).alias("q")).select("doc_id", "q.*")
    for name in ("comment_ratio", "average_line_length", "quality_score"):
        quality = quality.withColumn(name, F.round(name, 9 if name == "comment_ratio" else 6))
    return quality


EXT = "lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1))"


@query(
    "sc53_language_of_path",
    oracle(
        "source_files text_files",
        f"select file_path, case {EXT} "
        + " ".join(f"when '{k}' then '{v}'" for k, v in rules.LANGUAGE_OF_EXTENSION.items())
        + " else 'unknown' end as language from (select file_path from source_files union all select file_path from text_files) f",
    ),
)
def _(spark, sf):
    paths = files(spark, sf).select("file_path").unionByName(view(spark, sf, "text_files").select("file_path"))
    return paths.select("file_path", code.language_of_path(F.col("file_path")).alias("language"))


IMPORT_LIST = (
    f"list_sort(list_distinct(case language when 'c' then {S.rall(C, code.IMPORTS['c'], 1)} when 'cpp' then {S.rall(C, code.IMPORTS['c'], 1)} "
    rf"when 'python' then [regexp_extract(x, '^(?:import|from)\s+({W}+)', 1) for x in {S.rall(C, code.IMPORTS['python'])}] "
    f"when 'java' then {S.rall(C, code.IMPORTS['java'], 1)} "
    f"""when 'javascript' then [regexp_extract(x, '[''"]([^''"]+)[''"]\\)?$', 1) for x in {S.rall(C, code.IMPORTS['javascript'])}] end))"""
)


@query("sc57_imports", src(f"select doc_id, array_to_string({IMPORT_LIST}, '|') as imports from m"))
def _(spark, sf):
    return files(spark, sf).select("doc_id", T.joined(code.imports(F.col(C), F.col("language"))).alias("imports"))


KNOWN = "('stdio.h','stdlib.h','string.h','math.h','time.h')"


@query(
    "jn5_unknown_headers",
    src(f"select doc_id, h as header from (select doc_id, unnest({IMPORT_LIST}) as h from m where language in ('c','cpp')) t where h not in {KNOWN}"),
)
def _(spark, sf):
    from ..operators.interactions import KNOWN_HEADERS

    known = rules.dim(spark, [(h,) for h in KNOWN_HEADERS], "header string")
    used = files(spark, sf).filter(F.col("language").isin("c", "cpp")).select(
        "doc_id", F.explode(code.imports(F.col(C), F.col("language"))).alias("header")
    )
    return used.join(F.broadcast(known), "header", "left_anti")


@query(
    "set2_set3_term_sets",
    src(
        f"select doc_id, array_to_string(list_sort(list_intersect(w, k)), '|') as known, cast(len([x for x in w if not list_contains(k, x)]) as bigint) as unknown "
        f"from (select doc_id, list_distinct(regexp_extract_all(lower(content), '{W}{{4,}}')) as w, ['printf','scanf','malloc','free','strlen','strcpy','strcmp','main','import'] as k from m) t"
    ),
)
def _(spark, sf):
    terms = T.vocabulary(F.col(C), 4)
    known = F.array(*[F.lit(x) for x in ("printf", "scanf", "malloc", "free", "strlen", "strcpy", "strcmp", "main", "import")])
    return files(spark, sf).select(
        "doc_id",
        T.joined(F.array_sort(F.array_intersect(terms, known))).alias("known"),
        F.size(F.array_except(terms, known)).cast("bigint").alias("unknown"),
    )


# -- functions -------------------------------------------------------------------

O_, C_, F_, X_ = code.OPENS, code.CLOSES, code.FILLED, code.FULL
KEYWORDS = ", ".join(f"'{w}'" for w in code.BRANCH_WORDS.split("|"))


DEFS = {name: original(pattern) for name, pattern in code.DEFINITIONS.items()}


def deflang(value) -> str:
    return "case language " + " ".join(f"when '{k}' then {value(p)}" for k, p in DEFS.items()) + " end"


PARAM_TEXT = rf"trim(regexp_extract(signature, '(?s)\((.*)\)', 1), {S.BLANKS})"
FUNCTIONS = rf"""d as (select doc_id, language, {deflang(lambda p: S.rall(C, p))} as sigs, content from source_files),
 sg as (select doc_id, language, i - 1 as ordinal, sigs[i] as signature from (select doc_id, language, sigs, unnest(range(1, len(sigs) + 1)) as i from d) u),
 df as (select doc_id, language, ordinal,
   case when language in ('c','cpp') then regexp_extract(signature, {S.lit(DEFS['c'])}, 2) when language = 'java' then regexp_extract(signature, {S.lit(DEFS['java'])}, 2)
     when language = 'python' then regexp_extract(signature, {S.lit(DEFS['python'])}, 1) else regexp_extract(signature, {S.lit(DEFS['javascript'])}, 1) end as name,
   case when language in ('c','cpp') then coalesce(nullif(regexp_extract(signature, {S.lit(DEFS['c'])}, 1), ''), 'void')
     when language = 'java' then regexp_extract(signature, {S.lit(DEFS['java'])}, 1) else 'unknown' end as return_type,
   case when {PARAM_TEXT} = 'void' then cast([] as varchar[]) else
     [regexp_extract(trim(y, {S.BLANKS}), '(\S+)$', 1) for y in string_split({PARAM_TEXT}, ',') if trim(y, {S.BLANKS}) <> ''] end as parameters from sg),
 mk as (select doc_id, language, {deflang(lambda p: f"regexp_replace(content, {S.lit('(' + p + ')')}, '{O_}' || chr(92) || '1{C_}', 'g')")} as t from d where len(sigs) > 0),
 mf as (select doc_id, language, regexp_replace(t, chr(10) || '([^\S\n]*)([^\s])', chr(10) || '\1{F_}\2', 'g') as t from mk),
 mx as (select doc_id, language, regexp_replace(t, '{C_}([^\S\n]*)([^\s])', '{X_}\1\2', 'g') as t from mf),
 tk as (select doc_id, language, i, toks[i] as tok from (select doc_id, language, toks, unnest(range(1, len(toks) + 1)) as i from
   (select doc_id, language, regexp_extract_all(t, '{O_}|{C_}[^\S\n]*|{X_}|[{{}}]|\n[^\S\n]*{F_}?|{W}+|&&|\|\||\?') as toks from mx) v) w
   where not regexp_matches(tok, '^{W}') or tok in ({KEYWORDS})),
 fl as (select *, tok = '{O_}' as isopen, (starts_with(tok, '{C_}') or tok = '{X_}') as isend, starts_with(tok, chr(10)) as isline,
   not (tok = '{O_}' or starts_with(tok, '{C_}') or tok = '{X_}' or starts_with(tok, chr(10)) or tok in ('{{', '}}')) as isbranch from tk),
 nb as (select *, sum(case tok when '{{' then 1 when '}}' then -1 else 0 end) over w as depth, sum(cast(isline as int)) over w as line,
   sum(cast(isbranch as int)) over w as branches, sum(cast(isopen as int)) over w - 1 as opened, sum(cast(isend as int)) over w - 1 as closed,
   sum(cast(isline as int)) over (partition by doc_id) as all_lines, sum(cast(isbranch as int)) over (partition by doc_id) as all_branches
   from fl window w as (partition by doc_id order by i)),
 en as (select * from nb where isend),
 braces as (select e.doc_id, e.i, arg_min(s.line, s.i) as s_line, arg_min(s.branches, s.i) as s_branches from en e join nb s
   on s.doc_id = e.doc_id and s.i > e.i and s.tok = '}}' and s.depth = e.depth where e.language <> 'python' group by e.doc_id, e.i),
 margins as (select e.doc_id, e.i, arg_min(s.line, s.i) as s_line, arg_min(s.branches, s.i) as s_branches from en e join nb s
   on s.doc_id = e.doc_id and s.i > e.i and s.isline and ends_with(s.tok, '{F_}') and length(s.tok) - 2 <= length(e.tok) - 1
   where e.language = 'python' and e.tok <> '{X_}' group by e.doc_id, e.i),
 bd as (select e.*, coalesce(b.s_line, m.s_line) as s_line, coalesce(b.s_branches, m.s_branches) as s_branches,
   coalesce(m.s_line, e.all_lines + 1) - e.line as py_lines from en e left join braces b using (doc_id, i) left join margins m using (doc_id, i)),
 body as (select doc_id, closed as ordinal,
   cast(case when language = 'python' then case when tok = '{X_}' or (py_lines = 1 and length(tok) = 1) then 0 else py_lines end
     when s_line is null then 0 else s_line - line + 1 end as bigint) as body_lines,
   cast(case when language = 'python' then case when tok = '{X_}' or (py_lines = 1 and length(tok) = 1) then 1 else coalesce(s_branches, all_branches) - branches + 1 end
     when s_line is null then 1 else s_branches - branches + 1 end as bigint) as complexity from bd),
 fn as (select df.doc_id, df.language, cast(df.ordinal as int) as ordinal, name, return_type, parameters, cast(nb.line + 1 as bigint) as line_number, body_lines, complexity
   from df join nb on nb.doc_id = df.doc_id and nb.isopen and nb.opened = df.ordinal join body on body.doc_id = df.doc_id and body.ordinal = df.ordinal)"""


def fsql(select: str) -> str:
    return oracle("source_files", f"with {FUNCTIONS} {select}")


@query("sc54_functions", fsql("select doc_id, language, ordinal, name, return_type, line_number from fn"))
def _(spark, sf):
    return code.function_table(files(spark, sf)).select(
        "doc_id", "language", "ordinal", "name", "return_type", F.col("line_number").cast("bigint").alias("line_number")
    )


@query("sc55_function_bodies", fsql("select doc_id, ordinal, name, body_lines from fn"))
def _(spark, sf):
    return code.function_table(files(spark, sf)).select("doc_id", "ordinal", "name", "body_lines")


@query("sc58_function_complexity", fsql("select doc_id, ordinal, name, complexity from fn"))
def _(spark, sf):
    return code.function_table(files(spark, sf)).select("doc_id", "ordinal", "name", "complexity")


@query("sc56_function_parameters", fsql("select doc_id, cast(ordinal as int) as ordinal, name, cast(len(parameters) as bigint) as n, array_to_string(parameters, '|') as parameters from df"))
def _(spark, sf):
    return code.definition_rows(files(spark, sf), "doc_id").select(
        "doc_id", "ordinal", "name", F.size("parameters").cast("bigint").alias("n"), T.joined(F.col("parameters")).alias("parameters")
    )


@query(
    "ud7_functions_per_language",
    fsql("select language, count(*) as functions, count(distinct doc_id) as texts, cast(sum(body_lines) as bigint) as body_lines, max(complexity) as most_complex from fn group by language"),
)
def _(spark, sf):
    return code.function_table(files(spark, sf)).groupBy("language").agg(
        F.count("*").alias("functions"),
        F.countDistinct("doc_id").alias("texts"),
        F.sum("body_lines").alias("body_lines"),
        F.max("complexity").alias("most_complex"),
    )


LOCATED = " union all ".join(
    f"select doc_id, '{category}' as category, i as line_number, x as match, "
    f"array_to_string(lines[greatest(i - 2, 1):i + 2], chr(10)) as context from (select doc_id, lines, i, unnest({S.rall('lines[i]', pattern)}) as x from "
    f"(select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from b where language = '{language}') u) v"
    for language, category, pattern in rules.SOURCE_RULES
)


@query("sc59_located_security_rules", src(f"select doc_id, category, line_number, match, md5(context) as context_hash from ({LOCATED}) t"))
def _(spark, sf):
    return code.located_rules(files(spark, sf), "doc_id").select(
        "doc_id", "category", "line_number", "match", F.md5("context").alias("context_hash")
    )


@query(
    "sc75_rule_to_finding_type",
    src(
        "select category, case when category in ("
        + ", ".join(f"'{v}'" for v in rules.VULNERABILITY_TYPES)
        + f") then category else 'unknown' end as vulnerability_type, 'medium' as severity, count(*) as findings from ({LOCATED}) t group by category"
    ),
)
def _(spark, sf):
    located = code.located_rules(files(spark, sf), "doc_id")
    return located.groupBy("category").agg(F.count("*").alias("findings")).select(
        "category", code.finding_type(F.col("category")).alias("vulnerability_type"), F.lit("medium").alias("severity"), "findings"
    )


@query(
    "flt5_sc60_generated_files",
    oracle(
        "source_files",
        r"""with f as (select replace(file_path, '/f', case doc_id % 3 when 0 then '/fuzz_' when 1 then '/my_test_' else '/f' end) as path, content from source_files),
        g as (select *, regexp_extract(path, '([^/]+)$', 1) as name from f)
        select path, cast(len(string_split(content, chr(10))) as bigint) as lines, length(content) as size_chars, contains(content, 'int main') as has_main,
          contains(content, 'LLVMFuzzerTestOneInput') as has_fuzz_target, (length(content) - length(replace(content, '#include', ''))) // 8 as includes_count
        from g where regexp_matches(name, '\.(c|cpp|cc)$') and (contains(name, 'fuzz') or regexp_matches(name, 'test.*\.c'))""",
    ),
)
def _(spark, sf):
    part = F.when(F.col("doc_id") % 3 == 0, "/fuzz_").when(F.col("doc_id") % 3 == 1, "/my_test_").otherwise("/f")
    df = files(spark, sf).withColumn("path", F.replace("file_path", F.lit("/f"), part))
    return df.filter(code.is_generated(F.col("path"))).select("path", *code.file_metrics(F.col(C)))


@query("sc61_source_hash", oracle("source_files", "select doc_id, sha256(content) as source_hash from source_files"))
def _(spark, sf):
    return files(spark, sf).select("doc_id", F.sha2(C, 256).alias("source_hash"))


@query(
    "flt7_line_predicates",
    oracle(
        "text_files",
        f"""select kind, count(*) as lines from (select case when {STRIPPED} = '' then 'blank' when {COMMENT} then 'comment' else 'text' end as kind
        from (select unnest(string_split(content, chr(10))) as x from text_files) l) t group by kind""",
    ),
)
def _(spark, sf):
    rows = view(spark, sf, "text_files").select(F.explode(T.lines(F.col(C))).alias("x"))
    kind = F.when(code.is_blank(F.col("x")), "blank").when(code.is_comment(F.col("x")), "comment").otherwise("text")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))
