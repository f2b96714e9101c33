"""Distributed ordered scans against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trialscope.functions import ordered
from trialscope.operators import interactions


def loop(values, keep, add):
    state = 0.0
    for value in values:
        state = keep * state + add * value
    return state


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_smoothed_with_a_hot_key(spark, parts):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i // 3, i, rng.uniform(0, 100)) for i in range(3000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(shuffled, "k string, ts bigint, id bigint, v double")
        got = {r["k"]: r["smoothed"] for r in ordered.smoothed(df, ["k"], ["ts", "id"], "v", 0.9, 0.1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r[0] for r in rows}:
        assert got[key] == pytest.approx(loop([r[3] for r in rows if r[0] == key], 0.9, 0.1), rel=1e-12)


def test_smoothed_starts_from_a_value(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "k string, ts bigint, v double")
    (row,) = ordered.smoothed(df, ["k"], ["ts"], "v", 0.5, 0.5, start=8.0).collect()
    assert row["smoothed"] == 0.5 * (0.5 * 8.0 + 5.0) + 10.0


@pytest.mark.parametrize("parts", [1, 7])
def test_running_total(spark, parts):
    rng = random.Random(3)
    rows = [(i * i, rng.choice([-1, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "at bigint, d bigint").repartition(parts)
    got = {r["at"]: r["running"] for r in ordered.running_total(df, "at", "d").collect()}
    total = 0
    for at, d in rows:
        total += d
        assert got[at] == total


def test_running_total_of_nothing(spark):
    assert ordered.running_total(spark.createDataFrame([], "at bigint, d bigint"), "at", "d").count() == 0


def test_newest_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", 1), ("cold", 2)]
    df = spark.createDataFrame(rows, "k string, at bigint").repartition(9)
    got = {(r["k"], r["at"], r["rank"]) for r in ordered.first_of_each(df, ["k"], [F.desc("at")], 1200).collect()}
    assert got == {("hot", 2999 - i, i + 1) for i in range(1200)} | {("cold", 2, 1), ("cold", 1, 2)}


@pytest.mark.parametrize("run", [1, 2, 3, 4096])
def test_pairs_do_not_depend_on_the_cut(spark, monkeypatch, run):
    rng = random.Random(5)
    rows = []
    for conv in range(20):
        turns = sorted(rng.sample(range(40), rng.randrange(2, 20)))
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), f"{conv}-{t}") for t in turns]
    expected = set()
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    for conv in by_conv.values():
        for a, b in zip(conv, conv[1:]):
            if a[2] == "user" and b[2] == "assistant":
                expected.add((a[0], a[1], a[3], b[3]))
    monkeypatch.setattr(interactions, "TURNS_PER_RUN", run)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = [tuple(r) for r in interactions.pair_turns(df).select("conv_id", "turn", "prompt_text", "response_text").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {f"f{n}.log": [f"{n}:{i} " + "x" * (i % 13) for i in range(n * 40)] for n in (1, 5, 30)}
    for name, rows in texts.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    from trialscope.sources.text import numbered_lines

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = numbered_lines(spark, str(tmp_path), "*.log").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, rows in texts.items():
        mine = sorted((r["line_number"], r["raw_line"]) for r in got if r["file"].endswith("/" + name))
        assert mine == list(enumerate(rows, 1))
