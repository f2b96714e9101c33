"""Study results per model, repository and planned cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def _success() -> Column:
    return F.count_if(F.col("status") == "completed") / F.count("*")


def model_performance(experiments: DataFrame) -> DataFrame:
    """Runs, success rate, mean duration (missing counts as 0) and generated files per model."""
    return experiments.groupBy("model").agg(
        F.count("*").alias("experiments"),
        _success().alias("success_rate"),
        F.avg(F.coalesce("duration_seconds", F.lit(0.0))).alias("avg_duration_seconds"),
        F.sum("generated_files").alias("total_generated_files"),
    )


def repository_difficulty(experiments: DataFrame) -> DataFrame:
    rates = experiments.groupBy("repo_name").agg(F.count("*").alias("experiments"), _success().alias("success_rate"))
    return rates.withColumn("difficulty_score", 1.0 - F.col("success_rate"))


def completion(experiments: DataFrame) -> DataFrame:
    return experiments.agg(F.count("*").alias("total_experiments"), _success().alias("completion_rate"))


def model_matrix(experiments: DataFrame, models: list[str]) -> DataFrame:
    """Every (repository, model) cell with its runs, empty cells included.

    The models are a short fixed list, so the cells come from an explode.
    """
    done = experiments.groupBy("repo_name", "model").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    repos = done.select("repo_name").distinct()
    cells = repos.select("repo_name", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return cells.join(done, ["repo_name", "model"], "left").na.fill(0, ["runs", "completed"])


def top_repositories(repositories: DataFrame, most: Column) -> DataFrame:
    """The first ``most`` listed repositories per phase and category (all where NULL)."""
    rank = F.row_number().over(Window.partitionBy("phase", "category").orderBy("listed"))
    return repositories.withColumn("rank", rank).filter(most.isNull() | (F.col("rank") <= most)).drop("rank")


def phase_plan(spark) -> DataFrame:
    """The planned cells: phase, category, repository, model."""
    repo_rows = [
        (category, repo, minutes, place)
        for category, repos in rules.REPOSITORIES.items()
        for place, (repo, minutes) in enumerate(repos)
    ]
    repos = rules.dim(spark, repo_rows, "category string, repository string, build_minutes int, listed int")
    phases = rules.dim(spark, rules.PHASES, "phase string, categories array<string>, model_set string, most int")
    sets = rules.dim(spark, list(rules.MODEL_SETS.items()), "model_set string, models array<string>")
    wanted = phases.select("phase", "model_set", "most", F.explode("categories").alias("category"))
    chosen = top_repositories(wanted.join(F.broadcast(repos), "category"), F.col("most"))
    return (
        chosen.join(F.broadcast(sets), "model_set")
        .select("phase", "category", "repository", "build_minutes", F.explode("models").alias("model_name"))
    )


def plan_coverage(experiments: DataFrame) -> DataFrame:
    """Planned cells with the runs made for them.

    Experiments name models ``m<i>`` and repositories ``repo<i>`` by their place in the
    catalogues. They fold to one row per cell before the join.
    """
    spark = experiments.sparkSession
    repo_names = [repo for repos in rules.REPOSITORIES.values() for repo, _ in repos]
    models = rules.dim(spark, [(f"m{i}", m[0]) for i, m in enumerate(rules.MODELS)], "model string, model_name string")
    repos = rules.dim(spark, [(f"repo{i}", r) for i, r in enumerate(repo_names)], "repo_name string, repository string")
    done = experiments.groupBy("repo_name", "model").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    # The inner joins bound the folded runs by the two catalogues, so they can be broadcast.
    done = done.join(F.broadcast(models), "model").join(F.broadcast(repos), "repo_name")
    cells = F.broadcast(done.select("repository", "model_name", "runs", "completed"))
    return phase_plan(spark).join(cells, ["repository", "model_name"], "left").na.fill(0, ["runs", "completed"])


def by_specialty(experiments: DataFrame) -> DataFrame:
    """Runs per model specialty and expected quality."""
    rows = [(f"m{i}", *m) for i, m in enumerate(rules.MODELS)]
    models = rules.dim(experiments.sparkSession, rows, "model string, " + rules.MODEL_COLUMNS)
    per_model = experiments.groupBy("model").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    return per_model.join(F.broadcast(models), "model").groupBy("specialty", "expected_quality").agg(
        F.sum("runs").alias("runs"), F.sum("completed").alias("completed"), F.max("max_tokens").alias("max_tokens"), F.max("size_gb").alias("largest_gb")
    )
