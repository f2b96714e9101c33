"""Near duplicates among embeddings: iterative quantisation codes, multi-index tables, exact cosine on the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, groups, small_side, stored
from .components import components

#: The rotation is learned from at most so many distinct vectors (those of least id hash).
SAMPLE = 8192
TABLES = 8
TABLE_BITS = 12
ROUNDS = 50
#: Rows of a bucket compared at a time; larger buckets are dealt as pairs of blocks.
BLOCK = 1024


def usable(column: str):
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Directions: the signs of unit vector @ directions are ``bits`` code bits.

    Vectors are not centred: a cosine is an angle at the origin, and planes through another point would
    cut a sample that is one tight cluster by its noise. Principal axes first, then a rotation that is improved in turn with the codes until their
    quantisation error settles. If there are more bits than axes, further rotations start elsewhere.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    axes = axes[:, ::-1][:, :bits]
    flat = unit @ axes
    random = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn, _ = np.linalg.qr(random.normal(size=(axes.shape[1],) * 2))
        for _ in range(rounds):
            codes = np.where(flat @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ flat)
            turn = (left @ right).T
        parts.append(axes @ turn)
    return np.concatenate(parts, axis=1)[:, :bits]


def codes_of(vectors: np.ndarray, directions: np.ndarray, tables: int, table_bits: int) -> np.ndarray:
    """One integer per vector and table: ``table_bits`` code bits each."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    bits = (unit @ directions >= 0).reshape(len(vectors), tables, table_bits)
    return (bits * (1 << np.arange(table_bits))).sum(axis=2)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column to a matrix of doubles, shorter rows filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _code(width: int, directions, tables: int, table_bits: int, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("embedding"), width)
            codes = codes_of(vectors, directions, tables, table_bits).astype("<i4")
            offsets = pa.array(np.arange(0, codes.size + 1, tables), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("node", "kind", "weight")),
                    pa.array([v.tobytes() for v in vectors.astype(kind)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1))),
                ],
                ["node", "kind", "weight", "vector", "codes"],
            )

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position reachable from each of ``n`` positions over links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(least: float, kind):
    """Exact cosines in a pair of blocks; a pair counts only in the first table in which its codes agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["kind", "slot", "code", "block_a", "block_b"], least=2):
            table = table.combine_chunks()
            order = np.argsort(table["node"].to_numpy(), kind="stable")
            node = table["node"].to_numpy()[order]
            weight = table["weight"].to_numpy()[order]
            own = table["own"].to_numpy()[order]
            slot, block = table["slot"][0].as_py(), table["block_a"][0].as_py()
            inside = block == table["block_b"][0].as_py()
            vector = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype=kind).reshape(len(node), -1)[order].astype(np.float64)
            codes = table["codes"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order]
            left = np.flatnonzero(own == block)
            right = left if inside else np.flatnonzero(own != block)
            norm = np.sqrt((vector * vector).sum(axis=1))
            cosine = (vector[left] @ vector[right].T) / (norm[left][:, None] * norm[right][None, :])
            i, j = np.nonzero(cosine >= least)
            a, b = left[i], right[j]
            first = ~(codes[a, :slot] == codes[b, :slot]).any(axis=1)
            if inside:
                first &= a < b
            a, b = a[first], b[first]
            if not len(a):
                continue
            links = np.zeros(len(node), dtype=np.int64)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            root = _roots(len(node), a, b)
            seen = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[seen]), pa.array(links[seen]), pa.array(node[root[seen]])], ["node", "links", "root"]
            )

    return run


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.98, tables: int = TABLES, table_bits: int = TABLE_BITS, sample: int = SAMPLE
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Two vectors are linked if their labels and lengths are equal, their codes agree in a table, and their
    cosine in double precision is ``least`` or more. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable and ``kept`` says whether it is the row's own. Null
    labels, null ids, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing (a null id has a null component and is kept). Rows with one vec_id are one node. Other
    columns are not read.

    Equal vectors of a label become one weighted node first, so copies cost nothing. Codes are
    ``tables`` words of ``table_bits`` bits; each node is dealt once per table, with its vector. A bucket
    of more than ``BLOCK`` nodes is dealt as pairs of blocks. Groups give counts and one edge per node
    to the group's least linked node, never pairs. At the threshold of 0.98 a bit differs with a
    probability of 0.064, so a pair is missed with (1 - 0.936^12)^8 = 0.8 %, less at higher cosines.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    nodes = stored(
        rows.where(usable("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
        .withColumn("kind", F.xxhash64("label", F.size("embedding"))),
        "nodes",
    )
    width = nodes.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("embedding").toArrow()
    drawn = _matrix(drawn["embedding"].combine_chunks(), width)
    directions = learn_rotations(drawn, tables * table_bits)
    coded = nodes.select("node", "kind", "weight", "embedding").mapInArrow(
        _code(width, directions, tables, table_bits, kind),
        "node long, kind long, weight long, vector binary, codes array<int>",
    )
    coded = stored(coded, "codes")
    keys = ["kind", "slot", "code"]
    large = (
        coded.select("kind", F.posexplode("codes").alias("slot", "code"))
        .groupBy(keys)
        .count()
        .where(F.col("count") > BLOCK)
        .select(*keys, F.ceil(F.col("count") / BLOCK).alias("blocks"))
    )
    large = stored(large, "large")
    dealt = (
        coded.select("*", F.posexplode("codes").alias("slot", "code"))
        .join(small_side(large, 200_000), keys, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("*", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"))
        .drop("other", "blocks")
    )
    found = stored(
        by_group(dealt, [*keys, "block_a", "block_b"]).mapInArrow(_compare(least, kind), "node long, links long, root long"),
        "links",
    )
    edges = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.join(counts, "node", "left").join(edges, "node", "left")
    facts = facts.select(
        "label",
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    joined = rows.join(stored(facts, "facts"), ["label", "embedding"], "left")
    known = F.col("vec_id").isNotNull()
    return joined.select(
        "vec_id",
        F.coalesce(F.when(known, F.col("links")), F.lit(0)).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
