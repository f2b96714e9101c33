"""Secret scans over a ledger of blobs: each distinct text is scanned once per rule version."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, worker_store


@dataclass(frozen=True)
class Rule:
    """``pattern`` with what a match needs: ``least`` characters in ``group``, and one of ``marks`` (lower case) in the text."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 1
    marks: tuple[str, ...] = ()


#: In the order in which kinds are listed. Letters of the assigned names count in either case, in ASCII.
RULES = (
    Rule(
        "assign",
        "1",
        r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        ("passw", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", "1", r"[0-9a-f]+", 0, 16),
)

SPAN = "struct<start: long, end: long>"
LEDGER = f"blob_id binary, kind string, version string, spans array<{SPAN}>"
ARROW = pa.schema(
    [("blob_id", pa.binary()), ("kind", pa.string()), ("version", pa.string()),
     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def spans_of(text: str, low: str, rule: Rule, pattern: re.Pattern) -> list[dict]:
    """Leftmost non-overlapping matches that are long enough, as code points, end exclusive."""
    if rule.marks and not any(mark in low for mark in rule.marks):
        return []
    return [
        {"start": m.start(), "end": m.end()} for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = worker_store("patterns")
        for rule in rules:
            # A run of one class is found whole or not at all, so its least length can stand in the pattern.
            source = re.sub(r"^(\[[^]]+\])\+$", rf"\1{{{rule.least},}}", rule.pattern)
            patterns[rule.kind, rule.version] = (rule, re.compile(source))
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch.column("blob_id"), batch.column("text"), batch.column("todo")):
                text = text.as_py()
                low = text.lower()
                for pair in todo.as_py():
                    rule, pattern = patterns[tuple(pair.split("@", 1))]
                    rows.append(
                        {"blob_id": blob.as_py(), "kind": rule.kind, "version": rule.version, "spans": spans_of(text, low, rule, pattern)}
                    )
            yield from pa.Table.from_pylist(rows, schema=ARROW).to_batches()

    return run


def read_ledger(spark, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None before its first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at path ``ledger`` has not seen, extend it, and return findings per version.

    ``versions`` has ``content`` (null counts as empty) besides any columns that say where it stands
    (path, commit, ...); these come back, with ``blob_id`` (SHA-256 of the content's UTF-8 bytes) and
    ``findings``: an array of (kind, version, spans) for each rule, in any order. A rule is keyed by kind
    and version: change its pattern, change its version. Columns named blob_id or findings are replaced.

    Copies are found by content address: texts are aggregated to one per blob before anything is
    scanned, so a text with a third of all rows is scanned once. The ledger has a row per blob and rule,
    also without findings; a run appends its rows in one write, so a run that fails leaves no rows that
    count, and a pair that two runs scanned at once is the same row twice.
    """
    spark = versions.sparkSession
    places = [c for c in versions.columns if c not in ("content", "blob_id", "findings")]
    content = F.coalesce("content", F.lit(""))
    address = F.unhex(F.sha2(content.cast("binary"), 256))
    blobs = versions.select(address.alias("blob_id"), content.alias("text")).groupBy("blob_id").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    known = read_ledger(spark, ledger)
    if known is None:
        unseen = blobs.withColumn("todo", every)
    else:
        seen = known.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
        unseen = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        unseen = unseen.where(F.size("todo") > 0).select("blob_id", "text", "todo")
    unseen.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger)

    current = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules])
    findings = (
        read_ledger(spark, ledger)
        .where(current)
        .groupBy("blob_id")
        .agg(F.collect_set(F.struct("kind", "version", "spans")).alias("findings"))
    )
    where = versions.select(*places, address.alias("blob_id"))
    # Written first: a join of plain scans is one whose hot blobs Spark can split.
    return where.join(stored(findings, "findings"), "blob_id")


def all_spans(findings: str = "findings", rules: tuple[Rule, ...] = RULES):
    """Findings as one array of (start, place of the kind, end, kind), by start, then kind as listed."""
    place = F.create_map(*[F.lit(v) for i, r in enumerate(rules) for v in (r.kind, i)])
    return F.array_sort(
        F.flatten(
            F.transform(
                findings,
                lambda f: F.transform(
                    f["spans"],
                    lambda s: F.struct(s["start"].alias("start"), place[f["kind"]].alias("place"), s["end"].alias("end"), f["kind"].alias("kind")),
                ),
            )
        )
    )


def joined_spans(spans: str = "all"):
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _masked(mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("all")):
                text, parts, at = text.as_py(), [], 0
                for span in spans.as_py():
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], mask]
                    at = max(at, span["end"])
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "masked"])

    return run


def redact(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``versions`` (with ``text``) with ``mask`` in place of every finding; overlapping findings are one mask.

    Only texts with findings pass through Python. Rows and all columns stay, whatever their names; null
    texts stay null.
    """
    rows = versions.select(F.struct(*versions.columns).alias("row"), F.col("text").alias("content"))
    scanned = scan_versions(rows, ledger, rules).select("row", all_spans("findings", rules).alias("all"))
    clean = scanned.where(F.size("all") == 0).select("row.*")
    found = scanned.where(F.size("all") > 0).select("row", "all", F.col("row.text").alias("text"))
    kind = dict(rows.dtypes)["row"]
    masked = found.mapInArrow(_masked(mask), f"row {kind}, masked string")
    return clean.unionByName(masked.select(*[F.col("masked").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in versions.columns]))
