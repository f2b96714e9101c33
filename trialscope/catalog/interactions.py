"""Queries over prompt/reply pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..functions import text as T
from ..operators import interactions as ix
from . import sql as S
from .registry import query

R = "response_text"
P = "prompt_text"


def any_of(col: str, patterns) -> str:
    return "(" + " or ".join(S.rl(col, p) for p in patterns) + ")"


def hits(col: str, patterns) -> str:
    return "(" + " + ".join(f"cast({S.rl(col, p)} as int)" for p in patterns) + ")"


LANG_CTES = (
    "h as (select *, " + ", ".join(f"{hits(R, p)} as h_{k}" for k, p in ix.LANGUAGE_HINTS.items()) + " from {src}), "
    "l as (select *, case greatest(" + ", ".join(f"h_{k}" for k in ix.LANGUAGE_HINTS) + ") when 0 then 'unknown' "
    + " ".join(f"when h_{k} then '{k}'" for k in ix.LANGUAGE_HINTS)
    + " end as language from h)"
)

DIV0 = rf"{T.WORD}\s*=\s*{T.WORD}+\s*/\s*0(?:$|[^.]|\.$|\.[^0-9])"
LOOP = r"for\s*\(\s*;\s*true\s*;\s*\)\s*\{[^{}]*\}([^{}]*)"
INVENTED = (
    "list_concat("
    + ", ".join(f"[concat('Potential hallucination: ', m) for m in {S.rall(R, p)}]" for _, p in ix.INVENTED_NAMES[:2])
    + ")"
)
for _, pattern in ix.INVENTED_NAMES[2:]:
    INVENTED = f"list_concat({INVENTED}, [concat('Potential hallucination: ', m) for m in {S.rall(R, pattern)}])"
IMPOSSIBLE = (
    "[x for x in ["
    f"case when {S.rl(R, ix.IMPOSSIBLE[0][1])} then 'Impossible construct: Negative malloc size' end, "
    f"case when {S.rl(R, ix.IMPOSSIBLE[1][1])} then 'Impossible construct: Negative array index' end, "
    f"case when {S.rl(R, DIV0)} then 'Impossible construct: Division by zero' end, "
    f"case when len([t for t in {S.rall(R, LOOP, 1)} if not contains(t, 'break')]) > 0 then 'Impossible construct: Infinite loop without break' end"
    "] if x is not null]"
)
INVENTED_ALL = f"list_concat({INVENTED}, {IMPOSSIBLE})"
MODULES = rf"[regexp_extract(m, '^(?:import|from)\s+({T.WORD}+)', 1) for m in {S.rall(R, ix.PYTHON_IMPORT)}]"
UNKNOWN_API = (
    f"case language when 'python' then [concat('Unknown module: ', m) for m in {MODULES} "
    f"if m not in ({', '.join(S.lit(m) for m in ix.KNOWN_MODULES)}) and not starts_with(m, '_')] "
    f"when 'c' then [concat('Unknown header: ', m) for m in {S.rall(R, ix.INCLUDE, 1)} "
    f"if m not in ({', '.join(S.lit(m) for m in ix.KNOWN_HEADERS)})] else cast([] as varchar[]) end"
)
MIXED = "case language " + " ".join(f"when '{k}' then {any_of(R, p)}" for k, p in ix.FOREIGN_HINTS.items()) + " else false end"


def words(col: str, n: int) -> str:
    return f"list_distinct(regexp_extract_all(lower({col}), '{T.WORD}{{{n},}}'))"


def overlap(n: int) -> str:
    return f"(len(list_intersect({words(P, n)}, {words(R, n)})) / cast(greatest(len({words(P, n)}), 1) as double))"


INCONSISTENT = (
    f"[x for x in [case when {MIXED} then concat('Mixed language syntax: ', language, ' code contains other language patterns') end, "
    f"case when {overlap(3)} < 0.1 then 'Low semantic overlap between prompt and response' end] if x is not null]"
)
OPEN, CLOSE = S.lc(R, "{"), S.lc(R, "}")


def c_list(extra: str = "") -> str:
    return (
        f"[x for x in [case when {S.has(R, 'main')} and not {S.has(R, '#include')} then 'Main function without includes' end, "
        f"case when {OPEN} <> {CLOSE} then concat('Unmatched braces: ', {OPEN}, ' open, ', {CLOSE}, ' close') end, "
        f"case when {S.rc(R, ix.MALLOC)} > 0 and {S.rc(R, ix.FREE)} = 0 then 'malloc without corresponding free' end{extra}] if x is not null]"
    )


CPP_EXTRA = f", case when {S.has(R, 'std::')} and not {S.has(R, '#include <iostream>')} then 'Using std:: without iostream include' end"
OTHER_LISTS = f"""
 when 'java' then [x for x in [case when {S.has(R, 'main')} and not {S.has(R, 'public static void main')} then 'main method should be ''public static void main''' end,
   case when {S.has(R, 'class')} and not {S.has(R, 'public class')} then 'Classes should typically be public' end] if x is not null]
 when 'javascript' then [x for x in [case when {S.lc(R, '(')} <> {S.lc(R, ')')} then 'Unmatched parentheses' end,
   case when {S.lc(R, '[')} <> {S.lc(R, ']')} then 'Unmatched square brackets' end] if x is not null]
 when 'rust' then [x for x in [case when {S.has(R, 'fn main')} and not {S.has(R, 'println!', 'print!')} then 'Main function without output' end] if x is not null]
 when 'go' then [x for x in [case when {S.has(R, 'func main')} and not {S.has(R, 'package main')} then 'Main function without package main' end] if x is not null]
"""
LANGUAGE_LISTS = (
    f"case language when 'c' then {c_list()} when 'cpp' then {c_list(CPP_EXTRA)} {OTHER_LISTS} else cast([] as varchar[]) end"
)
COHERENCE = (
    f"case when coalesce({P}, '') = '' or coalesce({R}, '') = '' then 0.0::double when len({words(P, 4)}) = 0 then 0.5::double "
    f"else least(len(list_intersect({words(P, 4)}, {words(R, 4)})) / cast(len({words(P, 4)}) as double) * 2, 1.0::double) end"
)


def coded(select: str, src: str = "code_replies", views: str | None = None) -> str:
    return oracle(views or src, "with " + LANG_CTES.replace("{src}", src) + " " + select)


def replies(spark, sf, name="code_replies"):
    return ix.detect_language(view(spark, sf, name), R)


@query("sc21_language_detection", coded("select interaction_id, language from l"))
def _(spark, sf):
    return replies(spark, sf).select("interaction_id", "language")


@query(
    "sc22_invented_and_impossible",
    coded(f"select interaction_id, len(x) as issues, array_to_string(x, '|') as found from (select interaction_id, {INVENTED_ALL} as x from l) t"),
)
def _(spark, sf):
    x = ix.invented_issues(F.col(R))
    return view(spark, sf, "code_replies").select(
        "interaction_id", F.size(x).cast("bigint").alias("issues"), T.joined(x).alias("found")
    )


@query(
    "sc23_unknown_imports",
    coded(f"select interaction_id, language, len(x) as issues, array_to_string(x, '|') as found from (select *, {UNKNOWN_API} as x from l) t"),
)
def _(spark, sf):
    x = ix.unknown_api_issues(F.col(R), F.col("language"))
    return replies(spark, sf).select(
        "interaction_id", "language", F.size(x).cast("bigint").alias("issues"), T.joined(x).alias("found")
    )


@query(
    "sc24_consistency",
    coded(f"select interaction_id, language, {MIXED} as mixed, round({overlap(3)}, 9) as overlap, array_to_string({INCONSISTENT}, '|') as found from l"),
)
def _(spark, sf):
    language = F.col("language")
    return replies(spark, sf).select(
        "interaction_id",
        "language",
        ix.mixes_languages(F.col(R), language).alias("mixed"),
        F.round(ix.overlap_ratio(F.col(P), F.col(R), 3), 9).alias("overlap"),
        T.joined(ix.consistency_issues(F.col(P), F.col(R), language)).alias("found"),
    )


@query(
    "sc25_c_and_cpp_checks",
    coded(f"select interaction_id, language, array_to_string({LANGUAGE_LISTS}, '|') as found from l where language in ('c', 'cpp')"),
)
def _(spark, sf):
    language = F.col("language")
    return replies(spark, sf).filter(language.isin("c", "cpp")).select(
        "interaction_id", "language", T.joined(ix.language_issues(F.col(R), language)).alias("found")
    )


# The registry with a caller's entry: two languages share a check, one has none of its own.
@query(
    "ud2_added_validator",
    coded(
        f"select interaction_id, language, case when language in ('go', 'rust') and contains({R}, 'fn main') then 'Entry point'"
        f" when language = 'go' and contains({R}, 'func main') then 'Entry point' else '' end as found from l"
    ),
)
def _(spark, sf):
    def entry_point(text):
        return T.present((text.contains("fn main"), "Entry point"))

    def go_entry_point(text):
        return T.present((text.contains("func main") & ~text.contains("fn main"), "Entry point"))

    added = [(("go", "rust"), entry_point), (("go",), go_entry_point)]
    found = ix.language_issues(F.col(R), F.col("language"), added)
    return replies(spark, sf).select("interaction_id", "language", T.joined(found).alias("found"))


@query(
    "sc26_other_language_checks",
    coded(f"select interaction_id, language, array_to_string({LANGUAGE_LISTS}, '|') as found from l where language in ('java','javascript','rust','go')"),
)
def _(spark, sf):
    language = F.col("language")
    return replies(spark, sf).filter(language.isin("java", "javascript", "rust", "go")).select(
        "interaction_id", "language", T.joined(ix.language_issues(F.col(R), language)).alias("found")
    )


@query(
    "sc28_compile_proxy_c",
    coded(
        # A Python reply parses if it comes from the template that does; its comment holds no line end.
        f"select interaction_id, language, case when language = 'python' then cast(substr(interaction_id, 2) as bigint) % 10 = 0 and not regexp_matches({R}, '[\\r\\f\\x00]') "
        f"else language in ('c','cpp') and {S.has(R, '{')} and {S.has(R, '}')} end as compiles from l"
    ),
)
def _(spark, sf):
    scored = ix.score_replies(view(spark, sf, "code_replies"))
    return scored.select("interaction_id", "language", "compiles")


@query("sc29_coherence", oracle("interactions", f"select interaction_id, round({COHERENCE}, 9) as coherence from interactions"))
def _(spark, sf):
    return view(spark, sf, "interactions").select(
        "interaction_id", F.round(ix.coherence(F.col(P), F.col(R)), 9).alias("coherence")
    )


# Replies of the conversations are prose: where one looks like Python it cannot parse.
SCORE = (
    f"s as (select *, {INVENTED_ALL} as a, {UNKNOWN_API} as b, {INCONSISTENT} as c, "
    f"case when language = 'python' then ['Python syntax error'] else {LANGUAGE_LISTS} end as d, "
    f"language in ('c','cpp') and {S.has(R, '{')} and {S.has(R, '}')} as compiles, {COHERENCE} as coherence from l), "
    "t as (select *, (((((case when len(a) > 0 then 0.3::double else 0.0::double end) + (case when len(b) > 0 then 0.4::double else 0.0::double end)) "
    "+ (case when len(c) > 0 then 0.3::double else 0.0::double end)) + (case when len(d) > 0 then 0.4::double else 0.0::double end)) "
    "+ (case when not compiles then 0.3::double else 0.0::double end)) + (case when coherence < 0.5 then 0.2::double else 0.0::double end) as raw from s), "
    "u as (select *, raw > 0.3::double as hallucination_detected, least(raw, 1.0::double) as confidence, "
    "len(a) + len(b) + len(c) + len(d) as n from t) "
)
SCORE_COLUMNS = (
    "interaction_id, language, n as issues, hallucination_detected, round(confidence, 9) as confidence, "
    "case when confidence > 0.7::double then 'high' when confidence > 0.4::double then 'medium' else 'low' end as severity, "
    "round(least((n + cast(hallucination_detected as int) + cast(confidence > 0 as int) + 2) * 0.1::double, 1.0::double), 9) as analysis_confidence"
)


def score_columns(df):
    return df.select(
        "interaction_id",
        "language",
        F.size("issues").cast("bigint").alias("issues"),
        "hallucination_detected",
        F.round("confidence", 9).alias("confidence"),
        "severity",
        F.round("analysis_confidence", 9).alias("analysis_confidence"),
    )


SCORE_ORACLE = coded(f", {SCORE} select {SCORE_COLUMNS} from u", "interactions")


@query("sc20_hallucination_score", SCORE_ORACLE)
def _(spark, sf):
    return score_columns(ix.score_replies(view(spark, sf, "interactions")))


@query("sc20_hallucination_score_of_code")
def _(spark, sf):
    return score_columns(ix.score_replies(view(spark, sf, "code_replies")))


@query(
    "sc33_analyzer_confidence",
    coded(f", {SCORE} select language, count(*) as analyses, round(avg(least((n + cast(hallucination_detected as int) + cast(confidence > 0 as int) + 2) * 0.1::double, 1.0::double)), 6) as average_confidence from u group by language", "interactions"),
)
def _(spark, sf):
    return (
        ix.score_replies(view(spark, sf, "interactions"))
        .groupBy("language")
        .agg(F.count("*").alias("analyses"), F.round(F.avg("analysis_confidence"), 6).alias("average_confidence"))
    )


@query(
    "ag15_running_confidence_mean",
    coded(f", {SCORE} select llm_provider, count(*) as analyses, round(avg(confidence), 6) as average_confidence, count(case when hallucination_detected then 1 end) as detected from u group by llm_provider", "interactions"),
)
def _(spark, sf):
    return (
        ix.score_replies(view(spark, sf, "interactions"))
        .groupBy("llm_provider")
        .agg(
            F.count("*").alias("analyses"),
            F.round(F.avg("confidence"), 6).alias("average_confidence"),
            F.count_if("hallucination_detected").alias("detected"),
        )
    )


@query(
    "jn13_prompt_response_pairs",
    oracle(
        "turn_pairs",
        "select conv_id, turn, md5(prompt_text) as prompt_hash, md5(response_text) as response_hash from turn_pairs",
    ),
)
def _(spark, sf):
    return view(spark, sf, "turn_pairs").select(
        "conv_id", "turn", F.md5("prompt_text").alias("prompt_hash"), F.md5("response_text").alias("response_hash")
    )


@query(
    "sc30_token_estimate",
    oracle(
        "interactions",
        "select interaction_id, cast(coalesce(case when success then prompt_tokens end, length(prompt_text) // 4) as bigint) as prompt_tokens, "
        "cast(length(response_text) // 4 as bigint) as estimated_reply_tokens from interactions",
    ),
)
def _(spark, sf):
    return view(spark, sf, "interactions").select(
        "interaction_id",
        F.coalesce(F.when(F.col("success"), F.col("prompt_tokens")), ix.estimate_tokens(F.col(P))).alias("prompt_tokens"),
        ix.estimate_tokens(F.col(R)).alias("estimated_reply_tokens"),
    )


def totals(spark, sf):
    total = ix.total_tokens(F.lit(0), F.col("prompt_tokens"), F.col("response_tokens"))
    return view(spark, sf, "interactions").withColumn("total_tokens", total)


@query(
    "sc32_total_tokens",
    oracle(
        "interactions",
        "select interaction_id, case when prompt_tokens > 0 or response_tokens > 0 then prompt_tokens + response_tokens else 0 end as total_tokens from interactions",
    ),
)
def _(spark, sf):
    return totals(spark, sf).select("interaction_id", "total_tokens")


PRICE_ROWS = ", ".join(f"('{p}', '{m}', {v}::double)" for p, m, v in rules.PRICES)
PRICED = f"""with prices as (select * from (values {PRICE_ROWS}) v(p, m, price)),
 priced as (select i.*, prompt_tokens + response_tokens as total_tokens,
   coalesce(a.price, b.price, 0.005::double) as price_per_1k,
   (prompt_tokens + response_tokens) / 1000.0::double * coalesce(a.price, b.price, 0.005::double) as cost_usd
   from interactions i left join prices a on a.p = i.llm_provider and a.m = lower(i.llm_model) and a.m <> 'default'
   left join prices b on b.p = i.llm_provider and b.m = 'default')"""


def priced(spark, sf):
    return ix.with_cost(totals(spark, sf))


@query(
    "jn10_model_price",
    oracle("interactions", PRICED + " select interaction_id, llm_provider, llm_model, price_per_1k from priced"),
)
def _(spark, sf):
    return priced(spark, sf).select("interaction_id", "llm_provider", "llm_model", "price_per_1k")


@query(
    "sc31_interaction_cost",
    oracle("interactions", PRICED + " select interaction_id, total_tokens, round(cost_usd, 9) as cost_usd from priced"),
)
def _(spark, sf):
    return priced(spark, sf).select("interaction_id", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "ag1_session_usage",
    oracle(
        "interactions",
        PRICED
        + " select session_id, count(*) as total_llm_interactions, cast(sum(total_tokens) as bigint) as total_tokens_consumed, "
        "round(sum(cost_usd), 6) as estimated_cost_usd from priced group by session_id",
    ),
)
def _(spark, sf):
    return ix.session_usage(priced(spark, sf)).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 6))


USAGE = (
    "select coalesce(llm_provider, 'ALL') as provider, count(*) as requests, cast(sum(total_tokens) as bigint) as tokens, "
    "count(case when not success then 1 end) as errors, round(sum(cost_usd), 6) as total_cost, "
    "count(case when not success then 1 end) / cast(count(*) as double) as error_rate from priced group by rollup(llm_provider)"
)


@query("ag7_provider_usage", oracle("interactions", PRICED + " " + USAGE))
def _(spark, sf):
    return ix.provider_usage(priced(spark, sf)).withColumn("total_cost", F.round("total_cost", 6))


@query(
    "wn5_minute_rate_limit",
    oracle(
        "interactions",
        "select llm_provider, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute, count(*) as requests, "
        "count(*) >= 60 as limited from interactions group by llm_provider, date_trunc('minute', ts)",
    ),
)
def _(spark, sf):
    return ix.minute_limits(view(spark, sf, "interactions")).withColumn(
        "minute", F.date_format("minute", "yyyy-MM-dd HH:mm:ss")
    )


HEALTH = (
    "with latest as (select provider, arg_max(status, event_id) as status, max(ts) as checked_at from "
    "(select *, max(ts) over (partition by provider) as newest from provider_health) h where ts = newest group by provider)"
)


@query(
    "flt6_available_providers",
    oracle(
        "provider_health",
        HEALTH + " select provider, status, strftime(checked_at, '%Y-%m-%d %H:%M:%S') as checked_at from latest where status = 'healthy'",
    ),
)
def _(spark, sf):
    return ix.available_providers(view(spark, sf, "provider_health")).withColumn(
        "checked_at", F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "wn8_provider_selection",
    oracle(
        "provider_health interactions",
        HEALTH
        + ", usage as (select llm_provider as provider, count(*) as requests from interactions group by 1), "
        "c as (select provider, status, coalesce(requests, 0) as requests, case provider when 'cohere' then 0 when 'together' then 1 end as preference "
        "from latest left join usage using (provider) where status = 'healthy') "
        "select provider, status, requests, cast(preference as int) as preference from c order by preference nulls last, requests, provider limit 1",
    ),
)
def _(spark, sf):
    usage = ix.provider_usage(priced(spark, sf))
    return ix.select_provider(view(spark, sf, "provider_health"), usage, ["cohere", "together"])
