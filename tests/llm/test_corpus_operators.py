"""Filter audit, source mixing and phrase mining against plain versions and on odd rows."""

from __future__ import annotations

import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialscope.llm import phrases, spans
from trialscope.llm.filter_audit import audit_filters, text_counts, text_facts
from trialscope.llm.mixing import mix_sources, source_targets
from trialscope.llm.phrases import collocations, count_phrases

# Filter audit

ALPHABET = "aAbBzZ \t\n\x0b\x0c\r#$%é漢😀x"


@pytest.mark.parametrize("block", [7, 16, 1 << 21])
def test_byte_pass_counts_as_patterns_do(monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(40):
        texts = ["".join(draw.choices(ALPHABET, k=draw.choice([0, 1, 5, 40, 300]))) for _ in range(draw.randint(1, 12))]
        texts += [("q" * 100 + " ") * 3 + "q" * 99 + " " + "q" * 100, "", "w" * 64 + " " + "w" * 65]
        parts = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        got = text_counts(np.frombuffer(b"".join(parts), np.uint8), offsets)
        for i, t in enumerate(texts):
            words = re.findall("[^\x20\x09-\x0d]+", t)
            assert list(got[:, i]) == [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#$%&*|]", t))]


def test_words_of_equal_hash_stay_apart(monkeypatch):
    """With one hash for all words only the compared bytes tell them apart."""
    monkeypatch.setattr(spans, "span_hashes", lambda data, starts, lengths, seed=0: np.zeros(len(starts), np.uint64))
    text = " ".join(f"w{i % 50}" for i in range(200)).encode()
    assert list(text_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:2, 0]) == [200, 50]


def plain_audit(documents, labels):
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, text, _ in documents:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    rows = []
    for d, text, lang in documents:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, share = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order):
                lost = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                share[part, name] += len(lost)
                out[part, "".join(order), step + 1] = (
                    len(left),
                    len(lost),
                    sum(name in r[1] for r in own) - len(lost),
                    sum(r[1] == {name} for r in own),
                    sum(r[2] for r in lost),
                    sum(r[3] for r in lost),
                )
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_matches_loops(spark):
    draw = random.Random(5)
    long = [" ".join(draw.choices([f"w{i}" for i in range(n)], k=220)) for n in (60, 150, 400)]
    texts = [None, "", " ", "Ab#", "plain", "SHOUT", *long, long[2] + " 5 %", long[2].upper(), "x" * 100_000]
    documents = [(draw.choice([*range(40), None]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(150)]
    documents += [documents[0]] * 60
    labels = [(draw.choice([*range(40), None]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string").withColumn("words", F.lit("x")).withColumn("n", F.lit(1))
    got = audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == plain_audit(documents, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in documents})


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    one = spark.createDataFrame([(1, None, None, 7)], "doc_id long, text string, lang string, words int")
    assert text_facts(one, ["doc_id", "words"]).collect() == [(1, 0, 0, 0, 0, 0)]


# Source mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level >= 2 * sizes[s]]
        if not above:
            return {s: full[s] if s in full else weight[s] * level for s in names}
        for s in above:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    return mix_sources(docs, ["doc_id", "size"], **more)


@pytest.fixture(scope="module")
def sized():
    draw = random.Random(8)
    rows = []
    for i in range(900):
        words = draw.choice([0, 1, 2, 9, 30, 31, 32, 90, 400])
        source = draw.choice(["a"] * 12 + ["b", "c", "d", "é", None, ""])
        rows.append((i, " \n".join(["w"] * words) if words else draw.choice([None, "", " "]), source, i))
    return rows + [(5000, "w " * 700, "a", 0)] * 300 + [(None, "w w w", "b", None)] * 40


def test_mix_meets_its_targets(spark, sized):
    got = mixed(spark, sized).collect()
    size = Counter()
    for _, text, source, _ in sized:
        size[source] += len((text or "").split())
    source_of = {(d, len((t or "").split())): s for d, t, s, _ in sized}
    targets, taken = plain_targets(size), Counter()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").split())) for d, t, _, _ in sized)
    for r in got:
        source = source_of[r.doc_id, r.size]
        assert r.source_size == size[source] and r.target == pytest.approx(targets[source])
        low = int(r.target // r.source_size)
        assert r.taken in (r.size * low, r.size * (low + 1)) and r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 35, source


def test_mix_is_the_same_again_and_in_other_tasks(spark, sized):
    first = sorted(mixed(spark, sized).collect(), key=repr)
    assert sorted(mixed(spark, sized[::-1]).coalesce(1).collect(), key=repr) == first


def test_expected_copies_are_the_rate(spark):
    """Over several seeds the copies scatter about their rate as independent draws of it would."""
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2], 0) for i in range(800)]
    total, draws, rate = Counter(), 6, {}
    for seed in range(draws):
        for r in mixed(spark, rows, seed=seed, weights=(5, 4)).collect():
            total[r.doc_id] += r.taken / r.size
            rate[r.doc_id] = r.target / r.source_size
    miss = [(total[d] / draws - p) / (p % 1 * (1 - p % 1) / draws) ** 0.5 for d, p in rate.items()]
    assert len(miss) == 800 and 0.7 < np.mean(np.square(miss)) < 1.3 and abs(np.mean(miss)) < 0.15


def test_mix_of_little(spark):
    assert mixed(spark, []).count() == 0
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixed(spark, [(1, None, None, 0)]).collect()] == [(0, 0, 0.0, 0)]
    (one,) = mixed(spark, [(1, "a b c d", "s", 0)]).collect()
    assert (one.size, one.source_size, one.target) == (4, 4, 6.0) and one.taken in (4, 8)


def test_many_sources_of_very_unequal_size(spark):
    sizes = {f"s{i:04d}": 1 + (i * i * i) % 10_007 for i in range(1500)}
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()
    want = plain_targets(sizes)
    assert {r.source for r in got} == set(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)


# Phrases


def plain_phrases(rows, support, top):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang or "und" if lang != "" else ""] += len(own)
            for k in range(1, 5):
                for i in range(len(own) - k + 1):
                    counts["und" if lang is None else lang][tuple(own[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        many = {p: n for p, n in f.items() if len(p) > 1 and n >= support}
        ranked = []
        for p, a in many.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            around = [n for q, n in many.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * n >= 80 * a for n in around):
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def sentences():
    draw = random.Random(3)
    names = ["the", "The", "of", "new", "york", "times", "é", "😀", "漢字", "a-b", "x" * 70]
    rows = []
    for i in range(250):
        words = draw.choices(names, weights=[9, 3, 5, 2, 2, 2, 1, 1, 1, 1, 1], k=draw.choice([0, 1, 3, 30]))
        marks = draw.choices([" ", "  ", "\t", ". ", ",", "\n", "\r", " ! "], weights=[30, 2, 1, 2, 1, 1, 1, 1], k=len(words))
        rows.append(("".join(w + m for w, m in zip(words, marks)), draw.choice(["en"] * 5 + ["fr", None, ""])))
    return rows + [("New York Times of new york times", "en")] * 70 + [(None, "en"), ("", None), (" .;. ", "de")]


@pytest.mark.parametrize("slice_bytes", [40, 1 << 21])
def test_phrases_match_loops(spark, sentences, monkeypatch, slice_bytes):
    """Also where texts are cut into windows, and where tasks hand on few phrases at a time."""
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    monkeypatch.setattr(phrases, "GATHERED", 500)
    rows = [(t, lang, 0, "r") for t, lang in sentences]
    docs = spark.createDataFrame(rows, "text string, lang string, n int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, support=12, top=25).collect())
    assert got == plain_phrases(sentences, 12, 25)
    assert len(got) > 25


def test_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 1000)
    draw = random.Random(9)
    text = " ".join(draw.choices(["aa", "bb", "cc", "d" * 3000], weights=[5, 5, 5, 0.01], k=9000)) + " " + "e" * 9000
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    assert sorted(tuple(r) for r in collocations(docs).collect()) == plain_phrases([(text, "en")], 30, 2000)


def test_full_tables_change_nothing(spark, sentences, monkeypatch):
    """A table in which every bit is set lets all phrases through; the counts decide."""
    docs = spark.createDataFrame(sentences, "text string, lang string")
    want = sorted(map(tuple, count_phrases(docs, 12).collect()), key=repr)
    monkeypatch.setattr(phrases, "_mine", lambda *a: np.full(1 << (phrases.TABLE_BITS - 3), 255, np.uint8))
    assert sorted(map(tuple, count_phrases(docs, 12).collect()), key=repr) == want


def test_shuffle_files_of_a_level_go_with_it(spark, sentences, monkeypatch):
    """They were left to the driver's collector, so the files of all levels stood beside each other."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for top in disk.localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}

    before, left, mine = files(), [], phrases._mine

    def mine_and_look(*args):
        table = mine(*args)
        until = time.time() + 10
        while files() - before and time.time() < until:
            time.sleep(0.1)
        left.append(files() - before)
        return table

    monkeypatch.setattr(phrases, "_mine", mine_and_look)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    docs = spark.createDataFrame(sentences, "text string, lang string").repartition(3)
    assert collocations(docs, support=12, top=25).count() > 25
    assert left == [set()] * 3
    assert spark.conf.get(key, None) == own


@pytest.mark.parametrize("passes", [1, 3])
def test_counting_passes(spark, sentences, monkeypatch, passes):
    """Each counts a part of the phrases and is written, its shuffle files gone, before the next; shorter hashes change no result either."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for top in disk.localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}

    docs = spark.createDataFrame(sentences, "text string, lang string")
    want = sorted(map(tuple, count_phrases(docs, 12).collect()), key=repr)
    before, parts, store = files(), [], phrases.stored

    def store_and_look(*args):
        part = store(*args)
        until = time.time() + 10
        while files() - before and time.time() < until:
            time.sleep(0.1)
        parts.append((files() - before, part.count() > 0))
        return part

    monkeypatch.setattr(phrases, "stored", store_and_look)
    monkeypatch.setattr(phrases, "PASSES", passes)
    monkeypatch.setattr(phrases, "HASH_BITS", phrases.TABLE_BITS)
    assert sorted(map(tuple, count_phrases(docs, 12).collect()), key=repr) == want
    assert parts == [(set(), True)] * passes


def test_levels_keep_what_all_shards_have_often_enough(spark):
    """A word of 15 or 29 occurrences is frequent in a shard at its lowered support of 10; the counts of all shards say it is not of 30."""
    words = {"whole": (30, 0, 0), "even": (10, 10, 10), "uneven": (0, 12, 18), "one": (15, 0, 0), "less": (9, 10, 10)}
    rows = [(" ".join([w] * n), 7, s) for w, own in words.items() for s, n in enumerate(own)]
    texts = spark.createDataFrame(rows, "text string, language long, shard int").repartition(4)
    table = phrases.Table(phrases._mine(texts, 1, [], [10, 10, 10], 30))
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = phrases.Words(data, np.array([0, len(data)]), len(data)).hashes(np.array([7], np.uint64))[0]
    assert dict(zip(words, table.has(hashes).tolist())) == {"whole": True, "even": True, "uneven": True, "one": False, "less": False}


def test_scores_beyond_64_bits(spark):
    values = "cast(9000000000000000000 as bigint) as a, cast(9100000000000000000 as bigint) as l, cast(9200000000000000000 as bigint) as r"
    score = f"(cast(a as decimal(19, 0)) * {phrases.SCALE}) div (cast(l as decimal(19, 0)) + r)"
    row = spark.sql(f"select {values}").select(F.expr(score).cast("long").alias("s")).first()
    assert row.s == 2_000_000 * 9000000000000000000 // (9100000000000000000 + 9200000000000000000)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("a b", "x")], "text string, lang string")).count() == 0
