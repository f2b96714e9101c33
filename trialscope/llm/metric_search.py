"""Exact top-k search by inner product in an M-tree of written pages.

The tree has three levels: shards (a routing object and a covering radius each), leaf pages inside a
shard (centre, covering radius), and vectors (distance to their page's centre stored). One coordinate
more, sqrt(M - |x|^2) with M the largest |x|^2, makes the largest inner product the least Euclidean
distance, so the triangle inequality holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, groups, stored

#: Top routing objects, drawn from the data (those of least id hash).
ROUTES = 32
#: Vectors of a shard (about), a page, and queries and shards of a block, at most.
SHARD_ROWS = 8192
PAGE_ROWS = 512
QUERY_BLOCK = 1024
SHARD_BLOCK = 4096
#: Floating-point slack of a bound, relative to M.
SLACK = 1e-9
SCALE = 64
#: Squared norms below this one have scores that doubles hold exactly.
EXACT = 2.0**52


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in np.ascontiguousarray(values)], pa.binary())


def _doubles(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def _lift(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the squared norm ``most``."""
    rest = np.maximum(most - (vectors * vectors).sum(axis=1), 0.0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _encode(width: int, most: float, routes: np.ndarray):
    """Vectors as bytes, with the nearest route and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lifted = _lift(flat.reshape(-1, width), most)
            far = _distances(lifted, routes)
            route = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(route.astype(np.int32)), pa.array(far[np.arange(len(far)), route]), _lists(lifted)],
                ["vec_id", "route", "far", "x"],
            )

    return run


def leaves(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of ``vectors`` in pages of at most ``size``, halved again and again between two far-apart vectors."""
    todo, done = [np.arange(len(vectors))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        own = vectors[at]
        one = own[_distances(own, own[:1])[:, 0].argmax()][None]
        to_one = _distances(own, one)[:, 0]
        two = own[to_one.argmax()][None]
        order = np.argsort(to_one - _distances(own, two)[:, 0], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


PAGE = "shard long, page int, size int, centre binary, radius double, ids binary, vectors binary, parent binary"


def _pages(width: int, page_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["route", "part"]):
            ids, x = table["vec_id"].to_numpy(), _doubles(table["x"], width + 1)
            shard = table["route"][0].as_py() * (1 << 32) + table["part"][0].as_py()
            rows = []
            for number, at in enumerate(leaves(x, page_rows)):
                centre = x[at].mean(axis=0)
                parent = _distances(x[at], centre[None])[:, 0]
                rows.append(
                    {"shard": shard, "page": number, "size": len(at), "centre": centre.tobytes(), "radius": float(parent.max()),
                     "ids": ids[at].astype(np.int64).tobytes(), "vectors": x[at].tobytes(), "parent": parent.tobytes()}
                )
            yield from pa.Table.from_pylist(rows, schema=SCHEMA).to_batches()

    return run


SCHEMA = pa.schema(
    [("shard", pa.int64()), ("page", pa.int32()), ("size", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()),
     ("ids", pa.binary()), ("vectors", pa.binary()), ("parent", pa.binary())]
)


def _directory(width: int):
    """One row per shard: routing object and covering radius, from its pages' centres and radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["shard"]):
            centres, sizes = _doubles(table["centre"], width + 1), table["size"].to_numpy()
            centre = (centres * sizes[:, None]).sum(axis=0) / sizes.sum()
            radius = float((_distances(centres, centre[None])[:, 0] + table["radius"].to_numpy()).max())
            yield pa.RecordBatch.from_arrays(
                [table["shard"].combine_chunks()[:1].cast(pa.int64()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
                ["shard", "centre", "radius"],
            )

    return run


def _reach(width: int, most: float, nearest: bool):
    """Best possible score of each query (of a block) in each shard (of a block).

    ``nearest``: only the best shard of each query; else those that may hold a score of ``floor`` or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["block", "part"]):
            is_query = table["is_query"].to_numpy()
            x = _doubles(table["x"], width + 1)
            ids, radius, floor = (table[c].to_numpy() for c in ("id", "radius", "floor"))
            asked, shards = np.flatnonzero(is_query), np.flatnonzero(~is_query)
            if not len(asked) or not len(shards):
                continue
            q = x[asked]
            q[:, -1] = 0.0
            low = np.maximum(_distances(q, x[shards]) - radius[shards][None, :], 0.0)
            best = ((q * q).sum(axis=1)[:, None] + most - low * low) / 2 + SLACK * (1 + most)
            if nearest:
                i, j = np.arange(len(asked)), best.argmax(axis=1)
            else:
                i, j = np.nonzero(best >= floor[asked][:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[asked][i]), pa.array(ids[shards][j]), pa.array(best[i, j])], ["query_id", "shard", "best"]
            )

    return run


def _merge(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: higher score, then smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _merge_whole(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The same for scores that are Python's whole numbers."""
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)


def search(q, own, floor, pages, most: float, k: int):
    """The ``k`` best (score, id) of each query in ``pages`` [(centre, radius, ids, vectors, parent)], best page first.

    A query stops at the first page that cannot reach its k-th score so far; in a page only vectors are
    scored that their stored distance to the centre leaves within reach of some query that came. Where doubles cannot
    hold every score (``most`` of EXACT or more), those within reach are computed in whole numbers of any size.
    """
    if most >= EXACT:
        floor = floor - SLACK * (1 + most)
    n = len(q)
    square = (q * q).sum(axis=1)
    to_centre = _distances(q, np.stack([p[0] for p in pages]))
    slack = SLACK * (1 + most)

    def bound(rows, low):
        return (square[rows][:, None] + most - low * low) / 2 + slack

    reach = bound(np.arange(n), np.maximum(to_centre - np.array([p[1] for p in pages])[None, :], 0.0))
    order = np.argsort(-reach, axis=1, kind="stable")
    least = floor.copy()
    scores = [np.zeros(0)] * n
    found = [np.zeros(0, dtype=np.int64)] * n
    going = np.arange(n)
    for step in range(len(pages)):
        page = order[going, step]
        keep = reach[going, page] >= least[going]
        going, page = going[keep], page[keep]
        if not len(going):
            break
        for p in np.unique(page):
            _, _, ids, vectors, parent = pages[p]
            at = going[page == p]
            near = bound(at, np.abs(to_centre[at, p][:, None] - parent[None, :])) >= least[at][:, None]
            columns = np.flatnonzero(near.any(axis=0))
            if not len(columns):
                continue
            score = np.rint(q[at, :-1] @ vectors[columns, :-1].T)
            if most >= EXACT:
                score += slack
            hit = near[:, columns] & (score >= least[at][:, None]) & (ids[columns][None, :] != own[at][:, None])
            for i in np.flatnonzero(hit.any(axis=1)):
                row = at[i]
                all_ids = np.concatenate([found[row], ids[columns[hit[i]]]])
                if most >= EXACT:
                    one = list(map(int, q[row, :-1]))
                    whole = [sum(map(int.__mul__, one, map(int, v))) for v in vectors[columns[hit[i]], :-1]]
                    all_scores = np.array([*scores[row], *whole], dtype=object)
                    best = _merge_whole(all_scores, all_ids, k)
                    scores[row], found[row] = all_scores[best], all_ids[best]
                    if len(best) == k:
                        least[row] = max(least[row], float(all_scores[best[-1]]) - slack)
                    continue
                all_scores = np.concatenate([scores[row], score[i, hit[i]]])
                if len(all_scores) > 4 * k:
                    top = np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]
                    wanted = all_scores >= top
                    all_scores, all_ids = all_scores[wanted], all_ids[wanted]
                best = _merge(all_scores, all_ids, k)
                scores[row], found[row] = all_scores[best], all_ids[best]
                if len(best) == k:
                    least[row] = max(least[row], all_scores[best[-1]])
    return scores, found


def _longs(scores: np.ndarray) -> pa.Array:
    """Scores as 64-bit numbers; larger ones are cut to their range."""
    if scores.dtype == object:
        return pa.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], pa.int64())
    return pa.array(scores.astype(np.int64))


def _search(width: int, most: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["shard", "part"]):
            is_query = table["is_query"].to_numpy()
            pages = []
            for r in table.filter(pa.array(~is_query)).select(["centre", "radius", "ids", "vectors", "parent"]).to_pylist():
                pages.append(
                    (np.frombuffer(r["centre"]), r["radius"], np.frombuffer(r["ids"], dtype=np.int64),
                     np.frombuffer(r["vectors"]).reshape(-1, width + 1), np.frombuffer(r["parent"]))
                )
            asked = table.filter(pa.array(is_query))
            if not pages or not asked.num_rows:
                continue
            q = _doubles(asked["vectors"], width + 1).copy()
            q[:, -1] = 0.0
            own = asked["query_id"].to_numpy()
            scores, found = search(q, own, asked["radius"].to_numpy(), pages, most, k)
            sizes = [len(s) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, sizes)), pa.array(np.concatenate(found)), _longs(np.concatenate(scores))],
                ["query_id", "vec_id", "score"],
            )

    return run


def _paired(asked: DataFrame, directory: DataFrame, blocks: int, width: int, most: float, nearest: bool) -> DataFrame:
    """Queries against the directory of shards, as pairs of blocks."""
    parts = max(1, -(-directory.count() // SHARD_BLOCK))
    queries = asked.select(
        F.col("query_id").alias("id"), "x", F.lit(0.0).alias("radius"), "floor", F.lit(True).alias("is_query"),
        "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    shards = directory.select(
        F.col("shard").alias("id"), F.col("centre").alias("x"), "radius", F.lit(0.0).alias("floor"), F.lit(False).alias("is_query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part"),
    )
    return by_group(queries.unionByName(shards), ["block", "part"]).mapInArrow(
        _reach(width, most, nearest), "query_id long, shard long, best double"
    )


def _searched(pairs: DataFrame, asked: DataFrame, pages: DataFrame, width: int, most: float, k: int) -> DataFrame:
    """The ``k`` best of each (query, shard) pair; a shard's pages go once to each block of its queries."""
    pairs = pairs.join(asked, "query_id")
    wanted = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    wanted = stored(wanted, "wanted")
    none = F.lit(None).cast("binary")
    queries = pairs.join(wanted, "shard").select(
        "shard", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), F.lit(True).alias("is_query"),
        "query_id", none.alias("centre"), F.col("floor").alias("radius"), none.alias("ids"), F.col("x").alias("vectors"), none.alias("parent"),
    )
    held = pages.join(wanted, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query"),
        F.lit(0).cast("long").alias("query_id"), "centre", "radius", "ids", "vectors", "parent",
    )
    return by_group(queries.unionByName(held), ["shard", "part"]).mapInArrow(
        _search(width, most, k), "query_id long, vec_id long, score long"
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for every row of ``queries``.

    Both have (vec_id: long, x: array of whole numbers as long). Returns ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score``; ties go to the smaller vec_id; fewer rows if there are fewer candidates.
    Candidates are all rows of the query's length but those of the query's own vec_id; vectors of each length are searched for
    themselves. Rows with a null id or an empty or null vector take no part; repeated rows count once. Scores
    are exact; components beyond 2^53 are taken as doubles, and scores beyond 64 bits are cut to the range.

    The tree is written to the shared folder: vectors go to their nearest route, routes are cut into
    shards, shards into pages. Best first: each query visits its nearest shard, which
    gives a k-th score; then only shards whose bound reaches it, and within a shard pages in order of
    their bounds. Blocks of queries meet blocks of shards, never all pairs of rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = vectors.select("vec_id", "x").where("vec_id is not null and x is not null and size(x) > 0")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.max(norm).alias("most")).orderBy("width").collect()  # a row per length
    found = empty
    for i, r in enumerate(lengths):
        own = [side.where(F.size("x") == r["width"]) for side in (rows, queries.select("vec_id", "x").where("vec_id is not null"))]
        part = _top_k_of_length(*own, r["width"], r["most"], k)
        found = found.unionByName(part) if i else part
    return found


def _top_k_of_length(vectors: DataFrame, queries: DataFrame, width: int, most: float, k: int) -> DataFrame:
    rows = vectors.distinct()
    routes = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROUTES).select("x").toArrow()["x"].combine_chunks()
    routes = _lift(routes.flatten().to_numpy().astype(np.float64).reshape(-1, width), most)
    encoded = rows.mapInArrow(_encode(width, most, routes), "vec_id long, route int, far double, x binary")
    encoded = stored(encoded, "encoded")

    # A route of many rows (a third of them may be near one) is cut into shards of bounded size.
    sizes = {r["route"]: r["count"] for r in encoded.groupBy("route").count().collect()}  # at most ROUTES rows
    parts = F.create_map(*[F.lit(v) for r, n in sizes.items() for v in (r, -(-n // SHARD_ROWS))])
    dealt = encoded.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("route")]).cast("int"))
    pages = stored(
        by_group(dealt.select("vec_id", "route", "part", "x"), ["route", "part"]).mapInArrow(_pages(width, PAGE_ROWS), PAGE), "pages"
    )
    directory = stored(
        by_group(pages.select("shard", "size", "centre", "radius"), ["shard"]).mapInArrow(
            _directory(width), "shard long, centre binary, radius double"
        ),
        "directory",
    )

    asked = queries.distinct().mapInArrow(_encode(width, most, routes), "vec_id long, route int, far double, x binary")
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), "x"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    none = F.lit(float("-inf"))
    near = _paired(asked.withColumn("floor", none), directory, blocks, width, most, True)
    near = stored(near.groupBy("query_id").agg(F.max_by("shard", "best").alias("shard")), "nearest")
    first = stored(_searched(near, asked.withColumn("floor", none), pages, width, most, k), "first")
    floors = first.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.where((F.col("n") >= k) & (F.col("floor") > -(2.0**62)))  # lower ones may have been cut
    asked = asked.join(floors.select("query_id", "floor"), "query_id", "left").withColumn("floor", F.coalesce("floor", none))
    rest = _paired(asked, directory, blocks, width, most, False).join(near, ["query_id", "shard"], "left_anti")
    second = _searched(stored(rest.select("query_id", "shard"), "pairs"), asked, pages, width, most, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
