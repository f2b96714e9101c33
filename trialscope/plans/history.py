"""Counts over everything collected so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, section: str, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "value", "n")


def historical_summary(interactions: DataFrame, findings: DataFrame, log_lines: DataFrame, top_errors: int = 10) -> DataFrame:
    """Interactions per provider and model, findings per type, and the most common errors.

    Every section folds before it is unioned; the error list is a top-k.
    """
    message = F.regexp_extract("raw_line", r"pid: \d+ (.*)$", 1)
    errors = log_lines.filter(F.col("raw_line").contains(" ERROR ")).select(message.alias("message"))
    common = _counts(errors, "error", "message").orderBy(F.desc("n"), "value").limit(top_errors)
    return (
        _counts(interactions, "provider", "llm_provider")
        .unionByName(_counts(interactions, "model", "llm_model"))
        .unionByName(_counts(findings, "vulnerability", "vulnerability_type"))
        .unionByName(common)
    )
