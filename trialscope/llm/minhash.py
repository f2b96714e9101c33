"""Near duplicates by word shingles: fast similarity sketches, banding, exact verification.

Sketch: rounds 0 to t-1 hash every shingle into one of t bins with a value that is larger in later
rounds, rounds t to 2t-1 put every shingle into one fixed bin each, and a bin keeps its least value.
So every coordinate is filled after 2t rounds at most (most texts need one to three), and the share of
equal coordinates estimates the Jaccard similarity with Chernoff-type concentration bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, groups, mix, small_side, stored, text_slices, worker_store
from .components import components

BINS = 128
BAND_ROWS = 5
BANDS = BINS // BAND_ROWS
#: Rows of a bucket compared at a time; larger buckets are dealt as pairs of blocks.
BLOCK = 512
#: The same where rows carry their texts.
TEXT_BLOCK = 256
#: Standard deviations below the threshold at which a sketch still sends a pair to the exact check.
SLACK = 6.0
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n`` at least."""
    store = worker_store("powers")
    if len(store.get("up", ())) < n:
        n = max(n, SEGMENT + (1 << 16))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            store[name] = np.multiply.accumulate(table)
    return store["up"], store["down"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it is white space, and a random number (0 for white space; a-z for A-Z)."""
    store = worker_store("bytes")
    if not store:
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        low = np.arange(256)
        low[65:91] += 32
        value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[low]
        value[space] = 0
        store |= {"space": space, "value": value}
    return store["space"], store["value"]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of the texts data[offsets[i]:offsets[i+1]], in order, and the words' count per text.

    Words are runs of bytes that are not white space; A-Z counts as a-z. The hash is a polynomial over
    random byte values, found for all words at once; long inputs go in segments cut at white space.
    """
    space, value = _tables()
    body = ~space[data]
    start = body.copy()
    start[1:] &= ~body[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = body[inner]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + SEGMENT, side="right"))
        end = max(end - 1, at + 1) if end < len(starts) else end
        low = starts[at]
        high = starts[end] if end < len(starts) else len(data)
        up, down = _powers(high - low)
        x = value[data[low:high]] * up[: high - low]
        own = starts[at:end] - low
        out[at:end] = mix(np.add.reduceat(x, own) * down[own])
        at = end
    return out, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than ``size``, the whole sequence is one."""
    words, counts = word_hashes(data, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    whole = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        whole += words[j : j + len(whole)] * np.uint64(2 * j + 1) * np.uint64(BASE)
        whole = mix(whole)
    out = []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(whole[ends[i] : ends[i + 1] - size + 1]))
        elif n:
            text = np.uint64(n)
            for w in words[ends[i] : ends[i + 1]]:
                text = mix(np.array([text], dtype=np.uint64) * np.uint64(BASE) + w)[0]
            out.append(np.array([text], dtype=np.uint64))
        else:
            out.append(words[:0])
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` filled coordinates per non-empty set (rows of empty sets stay at the largest number)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * bins, empty, dtype=np.uint64)
    for k in range(2 * bins):
        if not len(values):
            break
        h = mix(values + np.uint64((k + 1) * BASE & 0xFFFFFFFFFFFFFFFF))
        place = (h % np.uint64(bins)).astype(np.int64) if k < bins else np.int64(k - bins)
        np.minimum.at(out, rows * bins + place, (h >> np.uint64(9)) | np.uint64(k << 55))
        open_ = (out.reshape(-1, bins) == empty).any(axis=1)
        keep = open_[rows]
        values, rows = values[keep], rows[keep]
    return out.reshape(-1, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band of coordinates."""
    own = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :].repeat(len(sketch), axis=0)
    for j in range(rows):
        key = mix(key * np.uint64(BASE) + own[:, :, j])
    return key.view(np.int64)


FACTS = "doc_id long, n_shingles long, same binary, bands array<long>, signature binary"


def _facts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, end, data, offsets in text_slices(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                sketch = sketches(sets)
                keys = band_keys(sketch)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                full = counts > 0
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                flat = pa.array(keys[full].reshape(-1))
                ends = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~full, False)), flat)
                low = sketch.astype(np.uint8)
                signature = pa.array([low[i].tobytes() if full[i] else None for i in range(len(sets))], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(counts), pa.array(same, pa.binary()), bands, signature],
                    ["doc_id", "n_shingles", "same", "bands", "signature"],
                )

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, np.ndarray] = {}  # a text often stands in many pairs of a batch
            ok = np.zeros(batch.num_rows, dtype=bool)
            sides = []
            for column in ("text_a", "text_b"):
                values = batch.column(column)
                sets = []
                for i in range(batch.num_rows):
                    text = (values[i].as_buffer() if values[i].is_valid else b"") or b""
                    key = hashlib.blake2b(text, digest_size=16).digest()
                    if key not in held:
                        raw = np.frombuffer(text, dtype=np.uint8)
                        held[key] = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
                    sets.append(held[key])
                sides.append(sets)
            for i, (x, y) in enumerate(zip(*sides)):
                ok[i] = alike_enough(x, y, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "ok"])

    return run


def _open_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (i, j) and agreement of a bucket's pairs that a block pair has to decide, best first.

    These are pairs of different components whose signatures agree well enough and that share no
    earlier band: a pair of a band before this one was decided there.
    """
    share = percent / 100
    least = (share - SLACK * (share * (1 - share) / BINS) ** 0.5) * BINS
    label = table["component"].to_numpy()
    own = table["own"].to_numpy()
    signs = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    bucket, block = table["bucket"][0].as_py(), table["block_a"][0].as_py()
    left = np.flatnonzero(own == block)
    right = left if block == table["block_b"][0].as_py() else np.flatnonzero(own != block)
    found: list[tuple[np.ndarray, ...]] = []
    for i in left:
        other = right[label[right] != label[i]]
        if right is left:
            other = other[other > i]
        alike = (signs[other] == signs[i]).sum(axis=1)
        other, alike = other[alike >= least], alike[alike >= least]
        if len(other):
            first = bands[i][(bands[other] == bands[i]).argmax(axis=1)] == bucket
            found.append((np.full(first.sum(), i), other[first], alike[first]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    i, j, alike = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-alike, kind="stable")
    return i[order], j[order], alike[order]


GROUP = ["bucket", "block_a", "block_b"]


def _undecided(percent: int):
    """The members of each bucket that stand in a pair still to be decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, GROUP, least=2):
            i, j, _ = _open_pairs(table, percent)
            nodes = np.unique(table["node"].to_numpy()[np.concatenate([i, j])])
            if len(nodes):
                bucket = np.full(len(nodes), table["bucket"][0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(nodes)], ["bucket", "node"])

    return run


def _decided(size: int, percent: int):
    """Open pairs of a block pair checked on full sets; one edge per node that a link joins to another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, GROUP, least=2):
            node = table["node"].to_numpy()
            sets = []
            for text in table["text"]:
                raw = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                sets.append(shingle_sets(raw, np.array([0, len(raw)]), size)[0])
            _, at = np.unique(table["component"].to_numpy(), return_inverse=True)
            root = list(range(int(at.max()) + 1))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            a, b = [], []
            for i, j in zip(*(x.tolist() for x in _open_pairs(table, percent)[:2])):
                x, y = top(at[i]), top(at[j])
                if x != y and alike_enough(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def alike_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets of distinct numbers."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short) or 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= percent * (len(short) + len(long) - both)


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked if the Jaccard similarity of their sets of ``size``-word shingles is ``percent``
    hundredths or more; ``component_id`` is the smallest doc_id reachable over links and ``kept`` says
    whether it is the document's own. Null and wordless texts have no shingles and no links; a text of
    fewer words than ``size`` is one shingle. Rows with a null doc_id link with nothing, have a null
    component and are kept. Repeated rows with one doc_id share its component. Other columns are not read.

    Steps: (1) one pass over the texts makes sketches, band keys and a digest of the whole set; (2) equal
    sets become one class, so a group of copies of any size is one node; (3) in each bucket of equal band
    keys every class is checked against the least one, on full sets; (4) buckets of three or more classes
    that are not one component after that are compared between components, in blocks, by signature;
    members with plausible partners come again with their texts and are checked on full sets, best pairs
    first, while they are in different components. Tasks give edges that join components, never pairs.
    So a group of near copies costs a star and no candidate pair is left undecided. Two texts at the
    threshold of 0.85 share no band with a probability of 4e-7, at 0.8 of 5e-5.
    """
    texts = documents.select("doc_id", "text")
    facts = stored(texts.mapInArrow(_facts(size), FACTS), "sketches")
    with_id = facts.where("doc_id is not null and same is not null")
    classes = stored(
        with_id.groupBy("same").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("signature", "doc_id").alias("signature")),
        "classes",
    )
    in_bands = classes.select("node", F.explode("bands").alias("bucket"))
    shared = stored(
        in_bands.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets"
    )
    members = stored(in_bands.join(shared, "bucket"), "members")

    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    checked = _verified(texts, stars, size, percent)
    links = checked.where("ok").select("a", "b")
    found = components(links, "links")

    # Buckets of at least three classes with more than one component.
    wide = members.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    wide = stored(wide, "labelled")
    mixed = (
        wide.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("n").alias("n")).where("x <> y")
    )
    mixed = wide.join(stored(mixed.select("bucket", "n"), "mixed").withColumnRenamed("n", "rows"), "bucket")
    signs = classes.select("node", "signature", "bands")
    undecided = by_group(_blocks(mixed.select("bucket", "node", "component", "rows").join(signs, "node"), BLOCK), GROUP)
    undecided = stored(undecided.mapInArrow(_undecided(percent), "bucket long, node long").distinct(), "undecided")
    if undecided.limit(1).count():
        rows = undecided.join(stored(undecided.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")), "sizes"), "bucket")
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        needed = _texts_of(texts, undecided.select(F.col("node").alias("doc_id")).distinct())
        rows = rows.join(signs, "node").join(needed.withColumnRenamed("doc_id", "node"), "node")
        more = by_group(_blocks(rows, TEXT_BLOCK), GROUP).mapInArrow(_decided(size, percent), "a long, b long")
        found = components(links.unionByName(stored(more, "more")), "links")

    class_of = classes.select("same", "node").join(found, "node", "left")
    class_of = class_of.select("same", F.coalesce("component", "node").alias("component"))
    return (
        facts.select("doc_id", "n_shingles", "same")
        .join(class_of, "same", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a bucket dealt to pairs of blocks of about ``size`` rows; ``rows`` says how many the bucket has."""
    blocks = F.ceil(F.col("rows") / size)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    return dealt.select("*", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b")).drop("other", "rows")


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents ``ids``, written."""
    return stored(texts.join(small_side(ids, 500_000), "doc_id", "left_semi").where("text is not null"), "needed")


def _verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: the exact check on the full shingle sets of both texts.

    Were a doc_id repeated with other texts, all of them are tried and any that links counts.
    """
    pairs = stored(pairs, "pairs")
    needed = _texts_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    joined = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    checked = joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long, ok boolean")
    return stored(checked.groupBy("a", "b").agg(F.max("ok").alias("ok")), "checked")
