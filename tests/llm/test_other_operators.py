"""Operators on vectors and urls, and the pipeline, against plain versions and on odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trialscope.llm import metric_search
from trialscope.llm.components import components
from trialscope.llm.embedding_dedup import near_duplicate_vectors
from trialscope.llm.metric_search import top_k
from trialscope.llm.url_filters import filter_urls, rule_table

NAN, INF = float("nan"), float("inf")

# Components


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    edges = [*path, *((1000, 1001 + i) for i in range(200)), (7, 7), (None, 3), (50, 60), (60, 50), (50, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(201)}, 50: 50, 60: 50}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# Embedding near duplicates


def plain_links(rows, least):
    out = {}
    for i, (a, x, label) in enumerate(rows):
        linked = set()
        for j, (b, y, other) in enumerate(rows):
            if i == j or label is None or label != other or x is None or y is None or len(x) != len(y) or not x:
                continue
            if any(v is None or not np.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            if np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= least:
                linked.add(j)
        out[i] = linked
    return out


@pytest.fixture(scope="module")
def near_vectors():
    draw = np.random.default_rng(4)
    rows = []
    for group in range(40):
        centre = draw.normal(size=24)
        for _ in range(int(draw.integers(1, 9))):
            noise = draw.normal(size=24) * draw.choice([0.02, 0.12, 0.16])
            rows.append((len(rows), (centre + noise).tolist(), int(group % 3)))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(1500)]  # a group of copies
    return rows


def test_vector_links_match_brute_force(spark, near_vectors):
    frame = spark.createDataFrame(near_vectors, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("n"))
    got = {r.vec_id: r for r in near_duplicate_vectors(frame).collect()}
    first = near_vectors[: len(near_vectors) - 1500]
    plain = plain_links(first, 0.98)
    copies_of = {i for i in plain if i == 0 or 0 in plain[i]}
    true = {i: len(links) + (1500 if i in copies_of else 0) for i, links in plain.items()}
    found = sum(min(got[i].n_links, n) for i, n in true.items())
    assert all(got[i].n_links <= n for i, n in true.items())
    assert found >= 0.95 * sum(true.values())
    assert all(got[i].component_id == 0 and got[i].n_links == true[0] for i in range(len(first), len(near_vectors)))
    assert got[0].kept and not got[len(first)].kept


def test_vector_odd_rows(spark):
    x = [1.0, 2.0, 0.5]
    rows = [
        (1, x, 1), (2, x, 2), (3, x, None), (None, x, 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, NAN, 1.0], 1),
        (8, [1.0, INF, 1.0], 1), (9, [1.0, None, 1.0], 1), (10, [2.0, 4.0, 1.0], 1), (10, [2.0, 4.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -0.5], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).collect()), key=str)
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 11, 12)]
    assert got == sorted([(0, 0, None, True), (1, 2, 1, True), (10, 2, 1, False), (10, 2, 1, False), *alone], key=str)
    assert near_duplicate_vectors(frame.where("false")).count() == 0
    assert near_duplicate_vectors(frame.where("vec_id in (4, 5, 6)")).where("n_links = 0 and kept").count() == 3


def test_large_buckets_in_blocks(spark, monkeypatch):
    from trialscope.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    draw = np.random.default_rng(5)
    centre = draw.normal(size=16)
    rows = [(i, (centre + 0.01 * draw.normal(size=16)).tolist(), 1) for i in range(120)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


# Top k


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "SHARD_ROWS", 100)
    monkeypatch.setattr(metric_search, "PAGE_ROWS", 16)
    monkeypatch.setattr(metric_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(metric_search, "SHARD_BLOCK", 3)
    monkeypatch.setattr(metric_search, "ROUTES", 4)
    draw = np.random.default_rng(6)
    x = draw.integers(-4, 5, size=(700, 6))  # many ties
    x[300:500] = x[300]  # a group of copies
    rows = [(int(3 * i), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = top_k(frame, frame.where("vec_id % 20 = 0"), 9).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i, _ in rows])
    asked = [i for i in range(len(rows)) if ids[i] % 20 == 0]
    assert len(mine) == len(asked)
    for q in asked:
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:9]
        assert mine[ids[q]] == [(k + 1, ids[i], score[i]) for k, i in enumerate(best)]


def test_top_k_odd_rows(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (20, [0, 0]), (40, [3, 3]), (None, [1, 1]), (60, None), (80, [None, 1]), (100, [1]), (120, [])]
    frame = spark.createDataFrame(rows, "vec_id long, x array<long>").where("x is null or not exists(x, v -> v is null)")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, frame.where("vec_id % 20 = 0"), 5).collect())
    assert got == [(20, 1, 1, 0), (20, 2, 40, 0), (40, 1, 1, 9), (40, 2, 20, 0)]  # the one vector of length one has no other
    assert top_k(frame.where("false"), frame, 5).count() == 0
    assert top_k(frame, frame.where("false"), 5).count() == 0
    assert top_k(frame.where("vec_id = 40"), frame.where("vec_id = 40"), 5).count() == 0


def test_top_k_of_each_length(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.integers(-9, 9, size=2 + i % 3).tolist()) for i in range(61)] + [(1000, [1] * 40)]
    frame = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, frame, 4).collect())
    want = []
    for q, x in rows:
        near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(x) == len(y))[:4]
        want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(near)]
    assert got == sorted(want)


def test_top_k_of_scores_that_doubles_cannot_hold(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [int(v) for v in draw.integers(-(2**28), 2**28, size=5)]) for i in range(80)]
    rows += [(100 + i, [2**30 + i % 3, 1 - i % 2, 0, 0, i % 4]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(frame, frame.where("vec_id % 20 = 0"), 6).collect())
    want = []
    for q, x in rows:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)[:6]
            want += [(q, k + 1, i, -score) for k, (score, i) in enumerate(near)]
    assert got == sorted(want)
    huge = spark.createDataFrame([(0, [2**62, 1]), (20, [2**62, 2]), (21, [-(2**62), 2])], "vec_id long, x array<long>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(huge, huge.where("vec_id = 20"), 5).collect()}
    assert found == {(20, 1): (0, 2**63 - 1), (20, 2): (21, -(2**63))}


# Urls

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "a.example.org", "/fr/x/"), ("allow", "same.org", "/q/"), ("block", "same.org", "/q/"),
]


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(h + p), len(h), a == "block", h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://x.Net/EN/", "https://WWW.Example.NET/en/1?q=/de/", "http://example.net/de/",
    "http://example.com/de", "http://example.com/de/", "http://notexample.com/de/", "ftp://a.b.example.com:80/de/", "http://o.org/fr/#x", "http://a.example.org/fr/x/y",
    "http://same.org/q/1", "x://y://net/", "http://net?/", "http://.net/", "http://net./", "http://ÄÖ.net/é", "http://a.net/\n/b", "http://h/" + "p/" * 20000, "http://" + "l." * 5000 + "net/",
]


def test_urls_match_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, rule string")
    rules = rule_table(spark, [*RULES, (None, "x", "/")])
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rules).collect())
    assert got == [(i, *plain_verdict(u)) for i, u in enumerate([*URLS, URLS[6]])]
    assert filter_urls(pages.where("false"), rules).count() == 0
    assert {(r.rule, r.verdict) for r in filter_urls(pages, rules.where("false")).collect()} == {(None, "allow")}


def test_many_shapes_of_rules(spark):
    """Hosts of one to seventy labels with paths of one to seventy lengths."""
    shapes = [("block" if (i * j) % 3 else "allow", ".".join(["a"] * i), "/" + "p" * j) for i in range(1, 71) for j in range(70) if (i + j) % 5 == 0 or i == 7]
    urls = [f"http://{'.'.join(['a'] * i)}/{'p' * j}" for i in (1, 2, 7, 8, 69, 70, 90) for j in (0, 1, 33, 68, 69, 80)] + ["http://b.a/ppp"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rule_table(spark, shapes)).collect()}
    for i, url in enumerate(urls):
        host, path = url[7:].split("/", 1)
        fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in shapes if ("." + host).endswith("." + h) and ("/" + path).startswith(p)]
        assert got[i] == (max(fits)[3:] if fits else (None, "allow")), url


# Pipeline


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    """The small corpus with odd rows, and its labels."""
    root = str(tmp_path_factory.mktemp("corpus"))
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("s")).withColumn("node", F.lit(1))
    odd = [
        (90001, None, "en"), (90002, "", "en"), (90003, "123 456", None), (None, "the thing of and in the one", None), (90004, "password=abcdefghijklmnop the thing and of it", "en"),
    ]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    extra = extra.withColumn("source", F.lit("odd")).withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(None).cast("string")).withColumn("node", F.lit(None).cast("int"))
    documents.unionByName(extra).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_keep_columns_and_act(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, corpus), f"test-{name}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        kept.append(ids)
        docs = out
    assert 90001 not in kept[0] and 90002 not in kept[0] and 90003 not in kept[0]
    assert len(kept[1]) < len(kept[0]) and set(kept[1]) <= set(kept[0])
    assert len(kept[2]) < len(kept[1]) and sorted(kept[3], key=str) == sorted(kept[2], key=str)
    assert set(kept[4]) == set(kept[3])
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    rebuilt = {}
    for r in docs.orderBy("doc_id", "piece").collect():
        rebuilt[r.doc_id] = rebuilt.get(r.doc_id, b"") + r.ids
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = {i: tokenizer.encode(texts[i], add_special_tokens=False).ids for i in rebuilt if i is not None and i < 90000}
    same = [np.frombuffer(rebuilt[i], "<u4").tolist() == [*ids, 1] for i, ids in plain.items()]
    assert sum(same) > 0.7 * len(same)  # the others had secrets, which are masked



def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, corpus), f"empty-{name}")
        assert docs.count() == 0


def test_run_is_all_stages(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
