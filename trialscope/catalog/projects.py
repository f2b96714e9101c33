"""Queries over project trees, manifests, settings and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..functions import text as T
from ..operators import projects as px
from . import sql as S
from .registry import query

LOW = "lower(content)"
NAME = "regexp_extract(path, '([^/]+)$', 1)"
EXT = r"regexp_extract(path, '[^/]\.([^./]+)$', 1)"
LANG = f"case lower({EXT}) " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.LANGUAGE_OF_EXTENSION.items()) + " else 'unknown' end"


def in_list(values) -> str:
    return "(" + ", ".join(S.lit(v) for v in values) + ")"


CODE = f"lower({EXT}) in {in_list(rules.LANGUAGE_OF_EXTENSION)}"
TESTED, SECURED = f"{EXT} in {in_list(px.TEST_EXTENSIONS)}", f"{EXT} in {in_list(px.SECURITY_EXTENSIONS)}"
TEST_HITS = " + ".join(f"cast({S.rl(NAME, p)} as int)" for p in px.TEST_NAMES)
WORD_HITS = " + ".join(S.lc(LOW, w) for w in px.SECURITY_WORDS)
PROVIDER = S.ordered_case([(v, k) for k, v in px.CI_FILES], lambda p: S.rl("path", p))
DEPLOY = S.rl("path", "|".join(px.DEPLOYMENT_FILES))
FACTS = f"""f as (select project, path, content, {LANG} as language,
  case when {CODE} then len([x for x in string_split(content, chr(10)) if {S.strip('x')} <> '']) else 0 end as loc,
  {TEST_HITS} as test_hits, {EXT} in ('py','java','js') as countable, {TESTED} as tested, {SECURED} as secured,
  case when {SECURED} then {WORD_HITS} else 0 end as words, {SECURED} and {S.has(LOW, *px.HOTSPOT_WORDS)} as hot,
  {PROVIDER} as ci_provider, {DEPLOY} as deploy from project_files)"""


def sql(select: str, ctes: str = "") -> str:
    return oracle("project_files", f"with {FACTS}{', ' + ctes if ctes else ''} {select}")


def files(spark, sf):
    return view(spark, sf, "project_files")


def facts(spark, sf):
    return px.file_facts(files(spark, sf))


def flat(df, *names: str):
    for name in names:
        df = df.withColumn(name, T.joined(F.col(name)))
    return df


def label_list(labels, test) -> str:
    """Ordered list of the labels whose test holds for any row of the group, joined."""
    arms = ", ".join(f"case when bool_or({test(label)}) then {S.lit(label)} end" for label in labels)
    return f"array_to_string([x for x in [{arms}] if x is not null], '|')"


DIRS = """dr as (select project, count(*) as total_directories from (select distinct project, array_to_string(p[1:i], '/') as d from
   (select project, p, unnest(range(1, len(p))) as i from (select project, string_split(path, '/') as p from f) s) u) v group by project)"""
SIZE = (
    "sz as (select project, count(*) as total_files, coalesce(max(total_directories), 0) as total_directories, cast(sum(loc) as bigint) as total_loc "
    "from f left join dr using (project) group by project)"
)
COMPLEXITY = "least(total_files / 100 + total_directories / 10 + total_loc / 10000, 10.0::double)"


@query(
    "ag23_project_size",
    sql(f"select project, total_files, total_directories, total_loc, round({COMPLEXITY}, 9) as complexity_score from sz", f"{DIRS}, {SIZE}"),
)
def _(spark, sf):
    sized = px.aggregate_facts(facts(spark, sf)).join(px.directories(files(spark, sf)), "project", "left")
    sized = sized.na.fill(0, ["total_directories"])
    return sized.select(
        "project", "total_files", "total_directories", "total_loc", F.round(px.complexity_score(), 9).alias("complexity_score")
    )


NAMES = [n for n in px.LANGUAGES if n != "multiple"]
ORDER = "case language " + " ".join(f"when '{n}' then {i}" for i, n in enumerate(NAMES)) + " end"
PRIMARY = (
    f"pl as (select project, language as primary_language from (select project, language, row_number() over (partition by project order by count(*) desc, {ORDER}) as r "
    "from f where language <> 'unknown' group by project, language) t where r = 1)"
)


@query(
    "ag24_primary_language",
    sql("select distinct f.project, coalesce(primary_language, 'unknown') as primary_language from f left join pl using (project)", PRIMARY),
)
def _(spark, sf):
    return px.aggregate_facts(facts(spark, sf)).select("project", "primary_language")


def has_language(language: str) -> str:
    builds = [name for name, (_, langs) in px.BUILD_FILES.items() if language in langs]
    return f"language = '{language}'" + (f" or path in {in_list(builds)}" if builds else "")


SYSTEM = "case " + " ".join(f"when bool_or(path = '{n}') then '{s}'" for n, (s, _) in reversed(px.BUILD_FILES.items())) + " else 'unknown' end"
BUILD_LIST = label_list(px.BUILD_FILES, lambda n: f"path = '{n}'")


@query(
    "ag25_languages_and_build_files",
    sql(
        f"select project, {label_list(px.LANGUAGES, has_language)} as supported_languages, {SYSTEM} as build_system, {BUILD_LIST} as build_files from f group by project"
    ),
)
def _(spark, sf):
    out = px.aggregate_facts(facts(spark, sf)).select("project", "supported_languages", "build_system", "build_files")
    return flat(out, "supported_languages", "build_files")


TESTS = label_list(px.TEST_FRAMEWORKS, lambda n: f"tested and {S.has('content', *px.TEST_FRAMEWORKS[n])}")
COVERAGE = "case when sum(cast(countable as int)) > 0 then least(sum(test_hits) / cast(sum(cast(countable as int)) as double) * 100, 100.0::double) else 0.0::double end"


@query(
    "ag26_testing_infrastructure",
    sql(
        f"select project, cast(sum(test_hits) as bigint) as test_count, count(case when test_hits > 0 then 1 end) as distinct_test_files, {TESTS} as test_frameworks, round({COVERAGE}, 6) as coverage_estimate from f group by project"
    ),
)
def _(spark, sf):
    out = px.aggregate_facts(facts(spark, sf)).select(
        "project", "test_count", "distinct_test_files", "test_frameworks", F.round(px.coverage_estimate(), 6).alias("coverage_estimate")
    )
    return flat(out, "test_frameworks")


GUARDS = label_list(px.SECURITY_FRAMEWORKS, lambda n: f"secured and {S.has(LOW, *px.SECURITY_FRAMEWORKS[n])}")
HOT = "hs as (select project, string_agg(path, '|' order by path) as hotspots from (select project, path, row_number() over (partition by project order by path) as r from f where hot) t where r <= 20 group by project)"


@query(
    "ag27_security_features",
    sql(
        f"select f.project, least(cast(sum(words) as bigint), 1000) as annotations_count, {GUARDS} as security_frameworks, coalesce(max(hotspots), '') as hotspots from f left join hs on hs.project = f.project group by f.project",
        HOT,
    ),
)
def _(spark, sf):
    base = facts(spark, sf)
    out = px.aggregate_facts(base).join(px.hotspots(base), "project", "left").select(
        "project", "annotations_count", "security_frameworks", F.coalesce("hotspots", F.array().cast("array<string>")).alias("hotspots")
    )
    return flat(out, "security_frameworks", "hotspots")


@query(
    "ag28_delivery_files",
    sql("select project, path, ci_provider as provider, case when ci_provider is not null then 'ci' else 'deployment' end as kind from f where ci_provider is not null or deploy"),
)
def _(spark, sf):
    return px.delivery_files(files(spark, sf))


# -- manifests -------------------------------------------------------------------

QUOTED = S.lit(px.QUOTED)


def manifest(name: str, kind: str, listed: str) -> str:
    return f"select project, '{kind}' as kind, unnest({listed}) as dependency from project_files where path = '{name}'"


LINES = f"[{S.strip('x')} for x in string_split(content, chr(10)) if {S.strip('x')} <> '']"
REQ_NAME = "regexp_extract(y, '^([^><=!]*)', 1)"
REQUIREMENTS = manifest(
    "requirements.txt",
    "dependencies",
    f"[z for z in [{S.strip(REQ_NAME)} for y in {LINES} if not starts_with(y, '#') and not starts_with(y, '-')] if z <> '']",
)
PACKAGE = manifest("package.json", "dependencies", "json_keys(content, '$.dependencies')") + " union all " + manifest(
    "package.json", "dev_dependencies", "json_keys(content, '$.devDependencies')"
)
POM = manifest(
    "pom.xml",
    "dependencies",
    r"[concat(regexp_extract(b, '(?s)<(?:\w+:)?groupId>(.*?)</', 1), ':', regexp_extract(b, '(?s)<(?:\w+:)?artifactId>(.*?)</', 1)) for b in regexp_extract_all(content, '(?s)<(?:\w+:)?dependency>(.*?)</(?:\w+:)?dependency>', 1)]",
)
GO = manifest(
    "go.mod",
    "dependencies",
    rf"[regexp_extract(y, '^(\S+)', 1) for y in [{S.strip('x')} for x in string_split(regexp_extract(content, '(?s)require\s*\((.*?)\)', 1), chr(10)) if {S.strip('x')} <> ''] if not starts_with(y, '//')]",
)
SETUP = manifest("setup.py", "dependencies", rf"regexp_extract_all(regexp_extract(content, '(?s)install_requires\s*=\s*\[(.*?)\]', 1), {QUOTED}, 1)")
PYPROJECT = manifest(
    "pyproject.toml", "dependencies", rf"regexp_extract_all(regexp_extract(content, '(?s)dependencies\s*=\s*\[(.*?)\]', 1), {QUOTED}, 1)"
) + " union all " + manifest(
    "pyproject.toml", "dev_dependencies", rf"regexp_extract_all(regexp_extract(content, '(?s)\[project\.optional-dependencies\]([^\[]*)', 1), {QUOTED}, 1)"
)
CARGO = f"""select project, case s when '[dependencies]' then 'dependencies' else 'dev_dependencies' end as kind, trim({S.strip("split_part(y, '=', 1)")}, '"') as dependency from (
  select project, y, last_value(case when starts_with(y, '[') then y end ignore nulls) over (partition by project order by i) as s from (
    select project, i, {S.strip('l[i]')} as y from (select project, l, unnest(range(1, len(l) + 1)) as i from
      (select project, string_split(content, chr(10)) as l from project_files where path = 'Cargo.toml') a) b) c) d
  where s in ('[dependencies]', '[dev-dependencies]') and not starts_with(y, '[') and contains(y, '=')"""
ALL_DEPS = " union all ".join([REQUIREMENTS, PACKAGE, POM, GO, SETUP, PYPROJECT, CARGO])


def manifest_query(name: str, path: str, text: str) -> None:
    @query(name, oracle("project_files", f"select distinct project, kind, dependency from ({text}) t"))
    def _(spark, sf):
        only = {path: px.MANIFESTS[path]}
        return px.dependencies(files(spark, sf).filter(F.col("path") == path), only)


manifest_query("sc95_requirements_txt", "requirements.txt", REQUIREMENTS)
manifest_query("sc96_package_json", "package.json", PACKAGE)
manifest_query("sc97_pom_xml", "pom.xml", POM)
manifest_query("sc99_go_mod", "go.mod", GO)
manifest_query("sc100_setup_py", "setup.py", SETUP)
manifest_query("sc100_pyproject_toml", "pyproject.toml", PYPROJECT)


@query("wn7_sc98_cargo_sections", oracle("project_files", CARGO))
def _(spark, sf):
    return px.cargo_dependencies(files(spark, sf)).drop("path")


@query("set4_dependency_union", oracle("project_files", f"select distinct project, kind, dependency from ({ALL_DEPS}) t"))
def _(spark, sf):
    return px.dependencies(files(spark, sf))


@query(
    "tk4_capped_dependencies",
    oracle(
        "project_files",
        f"select project, kind, dependency from (select *, row_number() over (partition by project, kind order by dependency) as r from (select distinct project, kind, dependency from ({ALL_DEPS}) t) u) v "
        "where r <= case kind when 'dependencies' then 100 else 50 end",
    ),
)
def _(spark, sf):
    return px.capped_dependencies(px.dependencies(files(spark, sf)))


@query(
    "ud5_manifest_registry",
    oracle("project_files", f"select kind, dependency, count(*) as projects from (select distinct project, kind, dependency from ({ALL_DEPS}) t) u group by kind, dependency"),
)
def _(spark, sf):
    return px.dependencies(files(spark, sf)).groupBy("kind", "dependency").agg(F.count("*").alias("projects"))


QUALITY = f"""dp as (select project, least(count(case when kind = 'dependencies' then 1 end), 100) as deps, least(count(case when kind = 'dev_dependencies' then 1 end), 50) as devs
    from (select distinct project, kind, dependency from ({ALL_DEPS}) t) u group by project),
  pf as (select f.project, cast(sum(test_hits) as bigint) as test_count, {COVERAGE} as coverage, count(ci_provider) as ci, {GUARDS} as guards, {SYSTEM} as build_system,
    least(count(case when hot then 1 end), 20) as hots, bool_or(path in {in_list(px.README_FILES)}) as readme from f group by f.project),
  q as (select pf.*, total_files, total_directories, total_loc, {COMPLEXITY} as complexity, coalesce(deps, 0) as deps, coalesce(devs, 0) as devs from pf join sz using (project) left join dp using (project)),
  q1 as (select *, 5.0::double + (case when coverage > 80 then 1.0 when coverage > 50 then 0.5 else 0.0 end) + (case when ci > 0 then 0.5 else 0.0 end) + (case when guards <> '' then 0.5 else 0.0 end)
    + (case when build_system <> 'unknown' then 0.5 else 0.0 end) - (case when complexity > 8 then 1.0 else 0.0 end) - (case when hots > 10 then 0.5 else 0.0 end) - (case when test_count = 0 then 1.0 else 0.0 end) as raw,
    (case when complexity > 8 then 0.2 else 0.0 end) + (case when hots > 10 then 0.1 else 0.0 end) + (case when test_count = 0 then 0.3 else 0.0 end) + (case when deps > 50 then 0.1 else 0.0 end) + (case when readme then 0.0 else 0.1 end) as debt from q)"""
SCORES = (
    "round(least(greatest(raw, 0.0::double), 10.0::double), 6) as quality_score, "
    "round(least(greatest(raw - (case when deps > 50 then 0.5 else 0.0 end) + (case when readme then 0.5 else 0.0 end), 0.0::double), 10.0::double), 6) as maintainability_score, "
    "round(cast(least(debt, 1.0) as double), 6) as technical_debt_ratio"
)


def scored(spark, sf):
    out = px.profile(files(spark, sf))
    for name in ("quality_score", "maintainability_score", "technical_debt_ratio"):
        out = out.withColumn(name, F.round(name, 6))
    return out


@query("sc62_project_quality", sql(f"select project, {SCORES} from q1", f"{DIRS}, {SIZE}, {QUALITY}"))
def _(spark, sf):
    return scored(spark, sf).select("project", "quality_score", "maintainability_score", "technical_debt_ratio")


@query(
    "ag33_project_profile",
    sql(
        f"select q1.project, total_files, total_directories, total_loc, coalesce(primary_language, 'unknown') as primary_language, build_system, test_count, ci as ci_config_files, guards as security_frameworks, deps as dependencies, devs as dev_dependencies, {SCORES} from q1 left join pl on pl.project = q1.project",
        f"{DIRS}, {SIZE}, {QUALITY}, {PRIMARY}",
    ),
)
def _(spark, sf):
    out = scored(spark, sf).select(
        "project", "total_files", "total_directories", "total_loc", "primary_language", "build_system", "test_count",
        "ci_config_files", "security_frameworks", "dependencies", "dev_dependencies",
        "quality_score", "maintainability_score", "technical_debt_ratio",
    )
    return flat(out, "security_frameworks")


# -- snapshots and settings ------------------------------------------------------


@query(
    "jn8_snapshot_changes",
    oracle(
        "file_snapshots",
        "select * from (select coalesce(o.path, n.path) as path, case when o.path is null then 'created' when n.path is null then 'deleted' when o.mtime <> n.mtime then 'modified' end as change, o.mtime as old, n.mtime as new "
        "from (select * from file_snapshots where snap = 'prev') o full join (select * from file_snapshots where snap = 'cur') n on o.path = n.path) t where change is not null",
    ),
)
def _(spark, sf):
    both = view(spark, sf, "file_snapshots")
    return px.snapshot_changes(both.filter("snap = 'prev'"), both.filter("snap = 'cur'"))


HINTS = "case " + " ".join(f"when {S.has('lower(cmdline)', *h)} then '{n}'" for n, h in px.PROVIDER_HINTS.items())


@query(
    "sc90_command_settings",
    oracle(
        "proc_snapshot",
        rf"""select pid, {HINTS} else coalesce({S.rx('cmdline', r'(?i)--(?:llm-)?provider[=\s]+([^\s]+)', 1)}, 'unknown') end as provider,
        coalesce({S.rx('cmdline', r'(?i)--ai-model[=\s]+([^\s]+)', 1)}, {S.rx('cmdline', r'(?i)--(?:llm-)?model[=\s]+([^\s]+)', 1)}, 'unknown') as model,
        coalesce({S.rx('cmdline', r'(?i)--(?:llm-)?endpoint[=\s]+([^\s]+)', 1)}, '') as endpoint from proc_snapshot""",
    ),
)
def _(spark, sf):
    return view(spark, sf, "proc_snapshot").select("pid", px.command_settings(F.col("cmdline")).alias("s")).select("pid", "s.*")


@query(
    "sc91_project_path",
    oracle("proc_snapshot", "select pid, coalesce(" + ", ".join(S.rx("cmdline", p, 1) for p in px.PROJECT_PATHS) + ") as project_path from proc_snapshot"),
)
def _(spark, sf):
    return view(spark, sf, "proc_snapshot").select("pid", px.project_path(F.col("cmdline")).alias("project_path"))


@query(
    "sc92_ci_context",
    oracle(
        "proc_snapshot",
        "select pid, case env_key when 'GITHUB_RUN_ID' then 'github-actions' when 'CI_PIPELINE_ID' then 'gitlab-ci' end as provider, "
        "case when env_key in ('GITHUB_RUN_ID','CI_PIPELINE_ID') then env_value end as pipeline_id, cast(null as varchar) as job_id from proc_snapshot",
    ),
)
def _(spark, sf):
    env = F.create_map("env_key", "env_value")
    return view(spark, sf, "proc_snapshot").select("pid", px.ci_context(env).alias("c")).select(
        "pid", "c.provider", "c.pipeline_id", "c.job_id"
    )


@query(
    "sc93_file_settings",
    oracle(
        "proc_snapshot",
        "select pid, case when pid % 2 = 0 then concat('m', cast(pid as varchar)) else name end as json_model, concat('p', cast(pid % 3 as varchar)) as json_provider, 'gpt-4' as env_model, concat('q', cast(pid % 4 as varchar)) as env_provider from proc_snapshot",
    ),
)
def _(spark, sf):
    pid = F.col("pid")
    body = F.to_json(
        F.struct(
            F.struct(F.col("name").alias("model"), F.concat(F.lit("p"), (pid % 3).cast("string")).alias("provider")).alias("llm"),
            F.when(pid % 2 == 0, F.concat(F.lit("m"), pid.cast("string"))).alias("model"),
        )
    )
    env = F.concat(F.lit("# settings\nmodel=gpt-4\nprovider=q"), (pid % 4).cast("string"))
    both = view(spark, sf, "proc_snapshot").select("pid", px.json_settings(body).alias("j"), px.env_file_settings(env).alias("e"))
    return both.select(
        "pid",
        F.col("j.model").alias("json_model"),
        F.col("j.provider").alias("json_provider"),
        F.col("e.model").alias("env_model"),
        F.col("e.provider").alias("env_provider"),
    )


@query("sc94_key_prefix", oracle("proc_snapshot", "select pid, substr(sha256(env_value), 1, 16) as key_hash from proc_snapshot"))
def _(spark, sf):
    return view(spark, sf, "proc_snapshot").select("pid", px.key_prefix(F.col("env_value")).alias("key_hash"))
