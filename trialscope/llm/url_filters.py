"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes, all in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side

#: Rules of the query: (action, host, path). A rule fits its host, all subdomains, and paths that start with its path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

DEFAULT_VERDICT = "allow"
#: Hexadecimal digits of the short hash that rules are found by; the full digest decides.
PREFIX_DIGITS = 8


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _digest(*parts):
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _short(digest):
    return F.substring(digest, 1, PREFIX_DIGITS)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has (action, host, path), any number of them. A host is expanded into those of its suffixes that have as many labels as
    some rule's host; suffixes meet the rules' hosts by a short hash prefix, and the full digest confirms. Only for hosts that
    have rules is the path expanded, into the prefixes as long as a path of that host's rules, and prefixes meet the rules in
    the same way. The longest rule wins, then the one with the longer host, then ``block``.

    Rows are judged once per distinct (host, path), so a host or url of a third of all rows is one
    group per task, and the verdict is joined back. Null urls, urls without ``://`` and urls that no
    rule fits have a null rule and the default verdict; repeated rows stay repeated. Columns of
    ``pages`` named like a result column are replaced. Rules with a null part are ignored.
    """
    made = ["host", "path", "rule", "verdict"]
    rules = rules.dropna(subset=["action", "host", "path"]).distinct()
    labels = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("n")).first()["n"]

    address = pages[url]
    rows = pages.select(
        *[pages[c] for c in pages.columns if c not in made], host_of(address).alias("host"), path_of(address).alias("path")
    )
    if not labels:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # Suffixes of the hosts, and the rules' hosts with the lengths of their paths.
    fitting = F.filter(F.lit(labels), lambda n: n <= F.size(F.split("host", r"\.")))
    suffixes = F.transform(fitting, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).withColumn("digest", _digest("suffix"))
    known_hosts = (
        rules.groupBy(F.col("host").alias("rule_host"))
        .agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
        .withColumn("host_digest", _digest("rule_host"))
    )
    met = (
        hosts.withColumn("short", _short("digest"))
        .join(small_side(known_hosts.withColumn("short", _short("host_digest")), 100_000), "short")
        .where(F.col("digest") == F.col("host_digest"))
        .select("host", "suffix", "lengths")
    )

    # Prefixes of the paths under those hosts, and the rules.
    prefixes = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expanded = (
        rows.select("host", "path")
        .distinct()
        .join(met, "host")
        .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
        .select("host", "path", _digest("suffix", "prefix").alias("digest"))
        .withColumn("short", _short("digest"))
    )
    known = rules.select(F.concat("host", "path").alias("rule"), "action", F.length("host").alias("host_length"))
    known = known.withColumn("rule_digest", _digest("rule")).withColumn("short", _short("rule_digest"))
    # The best rule first: longest, then longer host, then block before allow.
    order = F.struct(
        F.length("rule").alias("n"), "host_length", F.when(F.col("action") == "block", 1).otherwise(0).alias("b"), "rule", "action"
    )
    judged = (
        expanded.join(small_side(known, 100_000), "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(order).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    return rows.join(judged, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
