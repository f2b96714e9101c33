"""Project trees: size, languages, tests, security, delivery files, manifests, settings.

Input: one row per file with ``project``, ``path`` (below the project) and ``content``.
The contents are read once into narrow per-file facts; projects are plain aggregates of
those, so a project with most of the files folds on the map side like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.numbers import clamp, flag
from .code import is_blank, language_of_path

# Root file -> (build system, languages); the last one present names the system.
BUILD_FILES = {
    "CMakeLists.txt": ("cmake", ["c", "cpp"]),
    "Makefile": ("make", ["c", "cpp"]),
    "pom.xml": ("maven", ["java"]),
    "build.gradle": ("gradle", ["java", "kotlin"]),
    "package.json": ("npm", ["javascript", "typescript"]),
    "Cargo.toml": ("cargo", ["rust"]),
    "go.mod": ("go", ["go"]),
    "setup.py": ("setuptools", ["python"]),
    "pyproject.toml": ("poetry", ["python"]),
    "requirements.txt": ("pip", ["python"]),
    "meson.build": ("meson", ["c", "cpp"]),
    "BUILD.bazel": ("bazel", ["multiple"]),
}
LANGUAGES = [*dict.fromkeys(rules.LANGUAGE_OF_EXTENSION.values()), "multiple"]
# Name patterns of test files; a file counts once per pattern it matches.
TEST_NAMES = [
    r"test.*\.py$", r"Test.*\.java$", r"test.*\.js$", r"test.*\.ts$", r"_test\.go$", r"_test\.rs$",
    r"^test_.*\.py$", r"^Test.*\.java$", r"spec.*\.js$", r"Spec.*\.java$", r"Tests\.cs$",
]
TEST_FRAMEWORKS = {
    "pytest": ["pytest", "conftest.py"],
    "unittest": ["unittest", "TestCase"],
    "jest": ["jest", ".spec.js"],
    "junit": ["junit", "@Test"],
    "gtest": ["gtest", "TEST("],
    "mocha": ["mocha", "describe("],
    "rspec": ["rspec", "describe "],
    "cargo test": ["#[test]"],
}
TEST_EXTENSIONS = ["py", "java", "js", "ts", "cpp", "rs", "go"]
SECURITY_WORDS = [
    "security", "authentication", "authorization", "encrypt", "decrypt", "hash", "crypto", "ssl", "tls", "jwt", "oauth",
    "sanitize", "validate",
]
SECURITY_FRAMEWORKS = {
    "spring-security": ["@preauthorize", "@secured", "springsecurity"],
    "django-security": ["django.contrib.auth", "csrf", "xss"],
    "express-security": ["helmet", "express-rate-limit", "cors"],
    "owasp": ["owasp"],
    "bcrypt": ["bcrypt", "hash"],
    "jwt": ["jsonwebtoken", "jwt"],
}
HOTSPOT_WORDS = ["password", "secret", "key", "token", "api_key", "database", "sql", "query", "input", "user_input"]
SECURITY_EXTENSIONS = ["py", "java", "js", "ts", "cpp", "c", "h"]
# Path pattern -> provider of a delivery configuration.
CI_FILES = [
    (r"^\.github/workflows/[^/]*\.yml$", "github-actions"),
    (r"^\.github/workflows/[^/]*\.yaml$", "github-actions"),
    (r"^\.gitlab-ci\.yml$", "gitlab-ci"),
    (r"^\.travis\.yml$", "travis-ci"),
    (r"^circle\.yml$", "circleci"),
    (r"^\.circleci/config\.yml$", "circleci"),
    (r"^azure-pipelines\.yml$", "azure-devops"),
    (r"^buildspec\.yml$", "aws-codebuild"),
    (r"^cloudbuild\.yaml$", "google-cloud-build"),
    (r"^Jenkinsfile$", "jenkins"),
    (r"^\.buildkite/pipeline\.yml$", "buildkite"),
    (r"^bitbucket-pipelines\.yml$", "bitbucket-pipelines"),
]
DEPLOYMENT_FILES = [
    r"^Dockerfile$", r"^docker-compose\.yml$", r"^docker-compose\.yaml$", r"^k8s/[^/]*\.yml$", r"^kubernetes/[^/]*\.yaml$",
    r"^deployment\.yml$", r"^terraform/[^/]*\.tf$", r"^ansible/[^/]*\.yml$", r"^helm/Chart\.yaml$",
]
README_FILES = ["README.md", "README.txt", "README.rst"]
HOTSPOT_LIMIT, ANNOTATION_LIMIT = 20, 1000


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def provider_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, provider in CI_FILES:
        out = F.when(path.rlike(pattern), provider).otherwise(out)
    return out


def is_deployment(path: Column) -> Column:
    return path.rlike("|".join(DEPLOYMENT_FILES))


def file_facts(files: DataFrame) -> DataFrame:
    """Everything the project aggregates need of a file, without its text."""
    path, text, ext = F.col("path"), F.col("content"), extension(F.col("path"))
    name, low = file_name(path), F.lower(F.col("content"))
    is_code = F.lower(ext).isin(*rules.LANGUAGE_OF_EXTENSION)
    tested, secured = ext.isin(*TEST_EXTENSIONS), ext.isin(*SECURITY_EXTENSIONS)
    used_lines = F.size(F.filter(T.lines(text), lambda x: ~is_blank(x)))
    test_hits, word_hits = flag(name.rlike(TEST_NAMES[0])), T.literal_count(low, SECURITY_WORDS[0])
    for pattern in TEST_NAMES[1:]:
        test_hits = test_hits + flag(name.rlike(pattern))
    for word in SECURITY_WORDS[1:]:
        word_hits = word_hits + T.literal_count(low, word)
    tests = [(tested & T.has(text, *marks), label) for label, marks in TEST_FRAMEWORKS.items()]
    guards = [(secured & T.has(low, *marks), label) for label, marks in SECURITY_FRAMEWORKS.items()]
    return files.select(
        "project",
        "path",
        language_of_path(path).alias("language"),
        F.when(is_code, used_lines).otherwise(0).cast("bigint").alias("loc"),
        test_hits.cast("bigint").alias("test_hits"),
        ext.isin("py", "java", "js").alias("countable"),
        T.present(*tests).alias("test_frameworks"),
        F.when(secured, word_hits).otherwise(0).cast("bigint").alias("security_words"),
        T.present(*guards).alias("security_frameworks"),
        (secured & T.has(low, *HOTSPOT_WORDS)).alias("is_hotspot"),
        provider_of(path).alias("ci_provider"),
        is_deployment(path).alias("is_deployment"),
    )


def _labels(column: str, labels: list[str]) -> Column:
    """Which of the fixed ``labels`` any row of the group has, in their order."""
    return F.array_compact(
        F.array(*[F.when(F.max(F.array_contains(column, label)), F.lit(label)) for label in labels])
    )


def directories(files: DataFrame) -> DataFrame:
    """Distinct directories per project, parents included."""
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    parents = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    rows = files.select("project", F.explode(parents).alias("directory")).distinct()
    return rows.groupBy("project").agg(F.count("*").alias("total_directories"))


def hotspots(facts: DataFrame, most: int = HOTSPOT_LIMIT) -> DataFrame:
    """The first ``most`` hotspot files per project by path; ranks are cut before the shuffle."""
    place = F.row_number().over(Window.partitionBy("project").orderBy("path"))
    first = facts.filter("is_hotspot").select("project", "path", place.alias("place")).filter(F.col("place") <= most)
    return first.groupBy("project").agg(F.array_sort(F.collect_list("path")).alias("hotspots"))


def aggregate_facts(facts: DataFrame) -> DataFrame:
    """All per-project figures that need no second pass."""
    names = [name for name in LANGUAGES if name != "multiple"]
    counted = [F.struct(F.count_if(F.col("language") == n).alias("files"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(names)]
    best = F.greatest(*counted)
    builds = list(BUILD_FILES)
    present = [F.max(F.col("path") == name) for name in builds]
    system = F.lit("unknown")
    for name, there in zip(builds, present):
        system = F.when(there, BUILD_FILES[name][0]).otherwise(system)
    languages = []
    for language in LANGUAGES:
        test = F.max(F.col("language") == language)
        for name, there in zip(builds, present):
            if language in BUILD_FILES[name][1]:
                test = test | there
        languages.append(F.when(test, F.lit(language)))
    return facts.groupBy("project").agg(
        F.count("*").alias("total_files"),
        F.sum("loc").alias("total_loc"),
        F.when(best["files"] > 0, best["name"]).otherwise("unknown").alias("primary_language"),
        F.array_compact(F.array(*languages)).alias("supported_languages"),
        system.alias("build_system"),
        F.array_compact(F.array(*[F.when(there, F.lit(name)) for name, there in zip(builds, present)])).alias("build_files"),
        F.sum("test_hits").alias("test_count"),
        F.count_if(F.col("test_hits") > 0).alias("distinct_test_files"),
        F.count_if("countable").alias("countable_files"),
        _labels("test_frameworks", list(TEST_FRAMEWORKS)).alias("test_frameworks"),
        F.least(F.sum("security_words"), F.lit(ANNOTATION_LIMIT)).alias("annotations_count"),
        _labels("security_frameworks", list(SECURITY_FRAMEWORKS)).alias("security_frameworks"),
        F.count_if("is_hotspot").alias("hotspot_files"),
        F.count("ci_provider").alias("ci_config_files"),
        F.array_compact(
            F.array(*[F.when(F.max(F.col("ci_provider") == p), F.lit(p)) for p in sorted({p for _, p in CI_FILES})])
        ).alias("ci_providers"),
        F.count_if("is_deployment").alias("deployment_configs"),
        F.max(F.col("path").isin(*README_FILES)).alias("has_readme"),
    )


def delivery_files(files: DataFrame) -> DataFrame:
    """CI and deployment configuration files as rows."""
    path = F.col("path")
    return files.select(
        "project",
        "path",
        provider_of(path).alias("provider"),
        F.when(provider_of(path).isNotNull(), "ci").when(is_deployment(path), "deployment").alias("kind"),
    ).filter("kind is not null")


def complexity_score() -> Column:
    parts = F.col("total_files") / 100 + F.col("total_directories") / 10 + F.col("total_loc") / 10000
    return F.least(parts, F.lit(10.0))


def coverage_estimate() -> Column:
    share = F.col("test_count") / F.col("countable_files") * 100
    return F.when(F.col("countable_files") > 0, F.least(share, F.lit(100.0))).otherwise(0.0)


def quality(profile: DataFrame) -> DataFrame:
    """Quality and maintainability (0-10) and technical debt (0-1) of a profile."""

    def when(test: Column, value: float) -> Column:
        return F.when(test, value).otherwise(0.0)

    coverage, untested = F.col("coverage_estimate"), F.col("test_count") == 0
    complex_, hot = F.col("complexity_score") > 8, F.least("hotspot_files", F.lit(HOTSPOT_LIMIT)) > 10
    many, plain = F.col("dependencies") > 50, ~F.coalesce("has_readme", F.lit(False))
    raw = (
        F.lit(5.0)
        + F.when(coverage > 80, 1.0).when(coverage > 50, 0.5).otherwise(0.0)
        + when(F.col("ci_config_files") > 0, 0.5)
        + when(F.size("security_frameworks") > 0, 0.5)
        + when(F.col("build_system") != "unknown", 0.5)
        - when(complex_, 1.0)
        - when(hot, 0.5)
        - when(untested, 1.0)
    )
    debt = when(complex_, 0.2) + when(hot, 0.1) + when(untested, 0.3) + when(many, 0.1) + when(plain, 0.1)
    return (
        profile.withColumn("quality_score", clamp(raw, 0.0, 10.0))
        .withColumn("maintainability_score", clamp(raw - when(many, 0.5) + when(~plain, 0.5), 0.0, 10.0))
        .withColumn("technical_debt_ratio", F.least(debt, F.lit(1.0)))
    )


# -- manifests -------------------------------------------------------------------

QUOTED = r"""["']([^"'>=<]+)"""
LIMITS = {"dependencies": 100, "dev_dependencies": 50}


def trimmed_lines(content: Column) -> Column:
    return F.filter(F.transform(T.lines(content), T.strip), lambda x: x != "")


def requirements(content: Column) -> Column:
    used = F.filter(trimmed_lines(content), lambda x: ~x.startswith("#") & ~x.startswith("-"))
    return F.filter(F.transform(used, lambda x: T.strip(F.regexp_extract(x, r"^([^><=!]*)", 1))), lambda x: x != "")


def package_keys(content: Column, section: str) -> Column:
    return F.json_object_keys(F.get_json_object(content, f"$.{section}"))


def maven_dependencies(content: Column) -> Column:
    """group:artifact of every dependency element, whatever its namespace prefix."""
    clean = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    blocks = T.matches(clean, r"(?s)<(?:\w+:)?dependency>(.*?)</(?:\w+:)?dependency>", 1)

    def part(block: Column, tag: str) -> Column:
        return F.regexp_extract(block, rf"(?s)<(?:\w+:)?{tag}>(.*?)</", 1)

    named = F.transform(blocks, lambda b: F.concat(part(b, "groupId"), F.lit(":"), part(b, "artifactId")))
    return F.filter(named, lambda x: ~x.startswith(":") & ~x.endswith(":"))


def go_requirements(content: Column) -> Column:
    block = F.regexp_extract(content, r"(?s)require\s*\((.*?)\)", 1)
    return F.transform(
        F.filter(trimmed_lines(block), lambda x: ~x.startswith("//")), lambda x: F.regexp_extract(x, r"^(\S+)", 1)
    )


def setup_requirements(content: Column) -> Column:
    return T.matches(F.regexp_extract(content, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), QUOTED, 1)


def pyproject_dependencies(content: Column) -> Column:
    return T.matches(F.regexp_extract(content, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), QUOTED, 1)


def pyproject_optional(content: Column) -> Column:
    section = F.regexp_extract(content, r"(?s)\[project\.optional-dependencies\](.*?)(?=\[|\z)", 1)
    return T.matches(section, QUOTED, 1)


def nothing(content: Column) -> Column:
    return F.array().cast("array<string>")


# Root file -> (dependencies, development dependencies). Callers may add entries.
MANIFESTS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "requirements.txt": (requirements, nothing),
    "package.json": (lambda c: package_keys(c, "dependencies"), lambda c: package_keys(c, "devDependencies")),
    "pom.xml": (maven_dependencies, nothing),
    "go.mod": (go_requirements, nothing),
    "setup.py": (setup_requirements, nothing),
    "pyproject.toml": (pyproject_dependencies, pyproject_optional),
}


def cargo_dependencies(files: DataFrame) -> DataFrame:
    """Keys below ``[dependencies]`` and ``[dev-dependencies]``: the last section is carried down the lines."""
    manifest = files.filter("path = 'Cargo.toml'")
    line = T.strip(F.col("raw"))
    rows = manifest.select("project", "path", F.posexplode(T.lines(F.col("content"))).alias("pos", "raw"))
    carried = Window.partitionBy("project", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(line.startswith("["), line), ignorenulls=True).over(carried)
    kind = F.when(section == "[dependencies]", "dependencies").when(section == "[dev-dependencies]", "dev_dependencies")
    name = F.btrim(T.strip(F.substring_index(line, "=", 1)), F.lit('"'))
    used = rows.select("project", "path", kind.alias("kind"), name.alias("dependency"), line.alias("line"))
    return used.filter(
        F.col("kind").isNotNull() & ~F.col("line").startswith("[") & F.col("line").contains("=") & (F.col("dependency") != "")
    ).drop("line")


def dependencies(files: DataFrame, manifests: dict | None = None) -> DataFrame:
    """Distinct (project, kind, dependency) over all manifests in the project root."""
    path, content = F.col("path"), F.col("content")
    parts = []
    for name, (main, dev) in (manifests or MANIFESTS).items():
        for kind, read in (("dependencies", main), ("dev_dependencies", dev)):
            parts.append(F.when(path == name, F.struct(F.lit(kind).alias("kind"), read(content).alias("names"))))
    found = files.filter(path.isin(*(manifests or MANIFESTS))).select(
        "project", "path", F.explode(F.array_compact(F.array(*parts))).alias("m")
    )
    rows = found.select("project", "path", "m.kind", F.explode("m.names").alias("dependency"))
    return rows.unionByName(cargo_dependencies(files)).select("project", "kind", "dependency").distinct()


def capped_dependencies(deps: DataFrame) -> DataFrame:
    """The first names per project and kind, up to the limit of the kind."""
    place = F.row_number().over(Window.partitionBy("project", "kind").orderBy("dependency"))
    limit = rules.lookup(F.col("kind"), LIMITS)
    ranked = deps.withColumn("place", place).filter(F.col("place") <= max(LIMITS.values()))
    return ranked.filter(F.col("place") <= limit).drop("place")


def profile(files: DataFrame) -> DataFrame:
    """One row per project with everything above and its quality scores."""
    facts = file_facts(files)
    counts = capped_dependencies(dependencies(files)).groupBy("project").agg(
        F.count_if(F.col("kind") == "dependencies").alias("dependencies"),
        F.count_if(F.col("kind") == "dev_dependencies").alias("dev_dependencies"),
    )
    joined = (
        aggregate_facts(facts)
        .join(directories(files), "project", "left")
        .join(counts, "project", "left")
        .join(hotspots(facts), "project", "left")
        .na.fill(0, ["total_directories", "dependencies", "dev_dependencies"])
        .withColumn("hotspots", F.coalesce("hotspots", F.array().cast("array<string>")))
    )
    scored = joined.withColumn("complexity_score", complexity_score()).withColumn("coverage_estimate", coverage_estimate())
    return quality(scored)


# -- snapshots and settings ------------------------------------------------------


def snapshot_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """created / modified / deleted between two listings of (path, mtime)."""
    old, new = previous.select("path", F.col("mtime").alias("old")), current.select("path", F.col("mtime").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change"), "old", "new").filter("change is not null")


PROVIDER_HINTS = {
    "openai": ["openai", "gpt-", "chatgpt"],
    "anthropic": ["anthropic", "claude"],
    "ollama": ["ollama", "localhost:11434"],
    "huggingface": ["huggingface", "hf-"],
    "localai": ["localai", "localhost:8080"],
}
PROJECT_PATHS = [
    r"--(?:project-)?(?:dir|path|root)[=\s]+([^\s]+)", r"--source[=\s]+([^\s]+)", r"-d[=\s]+([^\s]+)", r"--workspace[=\s]+([^\s]+)",
]
# CI provider -> (pipeline, job, build number) variables; the first with a pipeline id wins.
CI_VARIABLES = [
    ("github-actions", "GITHUB_RUN_ID", "GITHUB_JOB", "GITHUB_RUN_NUMBER"),
    ("gitlab-ci", "CI_PIPELINE_ID", "CI_JOB_ID", "CI_PIPELINE_IID"),
    ("jenkins", "BUILD_ID", "JOB_NAME", "BUILD_NUMBER"),
    ("azure-devops", "BUILD_BUILDID", "AGENT_JOBNAME", "BUILD_BUILDNUMBER"),
    ("circleci", "CIRCLE_WORKFLOW_ID", "CIRCLE_JOB", "CIRCLE_BUILD_NUM"),
    ("travis-ci", "TRAVIS_BUILD_ID", "TRAVIS_JOB_ID", "TRAVIS_BUILD_NUMBER"),
]


def command_settings(command: Column) -> Column:
    """Model, provider and endpoint named on a command line."""
    low = F.lower(command)
    provider = F.coalesce(T.first(command, r"(?i)--(?:llm-)?provider[=\s]+([^\s]+)", 1), F.lit("unknown"))
    for name, hints in reversed(PROVIDER_HINTS.items()):
        provider = F.when(T.has(low, *hints), name).otherwise(provider)
    return F.struct(
        provider.alias("provider"),
        F.coalesce(
            T.first(command, r"(?i)--ai-model[=\s]+([^\s]+)", 1),
            T.first(command, r"(?i)--(?:llm-)?model[=\s]+([^\s]+)", 1),
            F.lit("unknown"),
        ).alias("model"),
        F.coalesce(T.first(command, r"(?i)--(?:llm-)?endpoint[=\s]+([^\s]+)", 1), F.lit("")).alias("endpoint"),
    )


def project_path(command: Column) -> Column:
    return F.coalesce(*[T.first(command, pattern, 1) for pattern in PROJECT_PATHS])


def ci_context(env: Column) -> Column:
    """CI provider and ids from a MAP of environment variables."""
    out = F.lit(None)
    for provider, pipeline, job, build in reversed(CI_VARIABLES):
        found = F.struct(
            F.lit(provider).alias("provider"), env[pipeline].alias("pipeline_id"), env[job].alias("job_id"), env[build].alias("build_number")
        )
        out = F.when(F.coalesce(env[pipeline], F.lit("")) != "", found).otherwise(out)
    return out


def key_prefix(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def env_file_settings(content: Column) -> Column:
    """``model`` and ``provider`` of a KEY=value file; the last assignment counts."""

    def last(key: str) -> Column:
        found = F.filter(T.lines(content), lambda x: ~x.startswith("#") & T.strip(x).startswith(key + "="))
        return F.regexp_extract(T.strip(F.try_element_at(found, F.lit(-1))), r"^[^=]*=(.*)$", 1)

    return F.struct(last("model").alias("model"), last("provider").alias("provider"))


def json_settings(content: Column) -> Column:
    """Settings of a JSON file: plain keys win over the ``ai`` and ``llm`` sections."""
    document = F.try_parse_json(content)

    def value(key: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(document, path, "string") for path in paths]).alias(key)

    return F.struct(
        value("model", "$.model", "$.ai.model", "$.llm.model"),
        value("provider", "$.provider", "$.ai.provider", "$.llm.provider"),
        value("endpoint", "$.ai.endpoint", "$.llm.endpoint"),
    )
