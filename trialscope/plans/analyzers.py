"""Analyzers: a name and a function from DataFrame to DataFrame.

Every analyzer gives the same columns: its name, the row's id, a confidence, the result
as a VARIANT-ready JSON text, and the row's errors. A bad row gets an entry in ``errors``
and an empty result; it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import flag
from ..operators import code, findings, interactions


@dataclass(frozen=True)
class Analyzer:
    name: str
    key: str
    required: tuple[str, ...]
    run: Callable[[DataFrame], DataFrame]
    found: Callable[[], Column]
    results: tuple[str, ...]

    def analyze(self, rows: DataFrame) -> DataFrame:
        """Run over ``rows``; rows that lack a required value are reported, not analyzed."""
        missing = T.present(*[(F.col(name).isNull(), f"missing {name}") for name in self.required])
        filled = rows.withColumn("errors", missing)
        for name in self.required:
            filled = filled.withColumn(name, F.coalesce(name, F.lit("")))
        done = self.run(filled)
        valid = F.size("errors") == 0
        return done.select(
            F.lit(self.name).alias("analyzer_name"),
            F.col(self.key).cast("string").alias("id"),
            F.when(valid, F.least(self.found() * 0.1, F.lit(1.0))).otherwise(0.0).alias("confidence_score"),
            F.when(valid, F.to_json(F.struct(*self.results))).alias("results"),
            "errors",
        )


REPLIES = Analyzer(
    name="HallucinationDetector",
    key="interaction_id",
    required=("prompt_text", "response_text"),
    run=interactions.score_replies,
    found=lambda: F.size("issues") + flag(F.col("hallucination_detected")) + flag(F.col("confidence") > 0) + 2,
    results=("hallucination_detected", "confidence", "severity", "issues"),
)
SOURCES = Analyzer(
    name="CodeQualityAnalyzer",
    key="doc_id",
    required=("content",),
    run=code.score_code,
    # Score, metrics and issue groups count once each when they are not empty.
    found=lambda: flag(F.col("overall_score") > 0) + 2 + F.size("recommendations"),
    results=("overall_score", "cyclomatic_complexity", "recommendations"),
)


def crash_report(crashes: DataFrame) -> DataFrame:
    """Crashes with their findings as one array; a crash has a handful of them."""
    found = F.concat(
        findings.signature_findings(F.col("signature")),
        findings.trace_findings(F.col("stack_trace")),
        findings.memory_findings(F.col("heap_corruption"), F.col("stack_overflow")),
    )
    return crashes.withColumn("found", found)


CRASHES = Analyzer(
    name="VulnerabilityAnalyzer",
    key="crash_id",
    required=("signature", "stack_trace"),
    run=crash_report,
    found=lambda: F.size("found"),
    results=("found",),
)


def analyze_all(inputs: dict[Analyzer, DataFrame]) -> DataFrame:
    """The results of several analyzers in one table."""
    out = None
    for analyzer, rows in inputs.items():
        done = analyzer.analyze(rows)
        out = done if out is None else out.unionByName(done)
    return out


def summary(results: DataFrame) -> DataFrame:
    """Analyses, failed rows and mean confidence per analyzer."""
    return results.groupBy("analyzer_name").agg(
        F.count("*").alias("analyses"),
        F.count_if(F.size("errors") > 0).alias("failed"),
        F.avg("confidence_score").alias("average_confidence"),
    )
