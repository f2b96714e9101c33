"""Queries over study results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import oracle, view
from ..functions import rules
from ..operators import experiments as ex
from .registry import query

RATE = "count(case when status = 'completed' then 1 end) / cast(count(*) as double)"


def runs(spark, sf):
    return view(spark, sf, "experiments")


@query(
    "ag19_model_performance",
    oracle(
        "experiments",
        f"select model, count(*) as experiments, round({RATE}, 9) as success_rate, round(avg(coalesce(duration_seconds, 0)), 6) as avg_duration_seconds, cast(sum(generated_files) as bigint) as total_generated_files from experiments group by model",
    ),
)
def _(spark, sf):
    out = ex.model_performance(runs(spark, sf))
    return out.withColumn("success_rate", F.round("success_rate", 9)).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6))


@query(
    "ag20_repository_difficulty",
    oracle("experiments", f"select repo_name, count(*) as experiments, round({RATE}, 9) as success_rate, round(1.0 - {RATE}, 9) as difficulty_score from experiments group by repo_name"),
)
def _(spark, sf):
    out = ex.repository_difficulty(runs(spark, sf))
    return out.withColumn("success_rate", F.round("success_rate", 9)).withColumn("difficulty_score", F.round("difficulty_score", 9))


@query("ag21_completion_rate", oracle("experiments", f"select count(*) as total_experiments, round({RATE}, 9) as completion_rate from experiments"))
def _(spark, sf):
    return ex.completion(runs(spark, sf)).withColumn("completion_rate", F.round("completion_rate", 9))


MODELS = [f"m{i}" for i in range(14)]
MODEL_VALUES = ", ".join(f"('{m}')" for m in MODELS)


@query(
    "jn11_model_matrix",
    oracle(
        "experiments",
        f"select r.repo_name, m.model, count(e.experiment_id) as runs, count(case when status = 'completed' then 1 end) as completed from (select distinct repo_name from experiments) r cross join (values {MODEL_VALUES}) m(model) "
        "left join experiments e on e.repo_name = r.repo_name and e.model = m.model group by 1, 2",
    ),
)
def _(spark, sf):
    return ex.model_matrix(runs(spark, sf), MODELS)


def plan_values() -> str:
    """The planned cells, spelled out from the catalogues."""
    names = [repo for repos in rules.REPOSITORIES.values() for repo, _ in repos]
    places = {m[0]: i for i, m in enumerate(rules.MODELS)}
    cells = []
    for phase, categories, model_set, most in rules.PHASES:
        for category in categories:
            for repo, minutes in rules.REPOSITORIES[category][:most]:
                for model in rules.MODEL_SETS[model_set]:
                    cells.append(f"('{phase}','{category}','{repo}','{model}',{minutes},'repo{names.index(repo)}','m{places[model]}')")
    return ", ".join(cells)


@query(
    "jn12_wn10_plan_coverage",
    oracle(
        "experiments",
        f"with p(phase, category, repository, model_name, build_minutes, r, m) as (values {plan_values()}) select phase, p.category, repository, model_name, build_minutes, "
        "count(e.experiment_id) as runs, count(case when status = 'completed' then 1 end) as completed from p left join experiments e on e.repo_name = r and e.model = m group by 1, 2, 3, 4, 5",
    ),
)
def _(spark, sf):
    return ex.plan_coverage(runs(spark, sf)).select(
        "phase", "category", "repository", "model_name", "build_minutes", "runs", "completed"
    )


MODEL_ROWS = ", ".join(f"('m{i}','{m[2]}','{m[3]}',{m[5]},{m[1]}::double)" for i, m in enumerate(rules.MODELS))


@query(
    "src16_model_catalogue",
    oracle(
        "experiments",
        f"select specialty, expected_quality, count(*) as runs, count(case when status = 'completed' then 1 end) as completed, max(max_tokens) as max_tokens, max(size_gb) as largest_gb "
        f"from experiments join (values {MODEL_ROWS}) v(model, specialty, expected_quality, max_tokens, size_gb) using (model) group by 1, 2",
    ),
)
def _(spark, sf):
    return ex.by_specialty(runs(spark, sf))
