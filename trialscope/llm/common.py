"""Helpers the operators share: written intermediate tables, Arrow streams cut into groups, hashing in numpy."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path

MASK = 0xFFFFFFFFFFFFFFFF


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: later jobs start from the files."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside lose their shuffle files when their job has ended, not when the driver happens to collect its garbage.

    For frames that are run once: a second run would have to shuffle anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for caches that tasks share.

    Task functions are pickled by value, so their module's globals start anew with each task. Names that
    begin with ``large`` are for caches of many megabytes: asking for any other store frees them, so that
    a worker that goes on with another operator does not keep both.
    """
    key = "_trialscope_worker_store"
    if key not in sys.modules:
        sys.modules[key] = types.ModuleType(key)
    stores = vars(sys.modules[key])
    for other in [k for k in stores if k.startswith("large") and k != name]:
        del stores[other]
    return stores.setdefault(name, {})


def text_slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut ``batch`` into runs of rows with about ``most`` bytes of text; one longer text is a run of its own.

    Yields (first row, end row, bytes, offsets): row i of a run holds bytes[offsets[i]:offsets[i+1]]. Null is empty.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end, raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finalizer of a public hash function); equal in, equal out."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` (integer columns without nulls) of a sorted stream, one table each.

    Runs shorter than ``least`` rows are passed over.
    """
    held: list[pa.RecordBatch] = []  # the run that may go on in the next batch
    last = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if held and tuple(c[0] for c in columns) != last:
            if sum(b.num_rows for b in held) >= least:
                yield pa.Table.from_batches(held)
            held = []
        cuts = np.concatenate([[0], np.flatnonzero(change), [n]])
        if len(cuts) == 2:
            held.append(batch)
        else:
            held.append(batch.slice(0, cuts[1]))
            if sum(b.num_rows for b in held) >= least:
                yield pa.Table.from_batches(held)
            sizes = np.diff(cuts)
            for i in np.flatnonzero(sizes[1:-1] >= least) + 1:
                yield pa.Table.from_batches([batch.slice(cuts[i], sizes[i])])
            held = [batch.slice(cuts[-2], sizes[-1])]
        last = tuple(c[-1] for c in columns)
    if held and sum(b.num_rows for b in held) >= least:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` and sorted by them in each task, as ``groups`` needs it."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def drawn(rows: DataFrame, group: str, key: str, each: int, most_groups: int) -> DataFrame:
    """At most ``each`` rows (more only where keys repeat) of the ``most_groups`` largest groups: those of least key hash.

    The rows that count are found by a hash threshold per group, so no group is gathered in one task;
    the driver sees group sizes and about one and a half times as many hashes as rows are drawn.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(group).count().orderBy(F.desc("count"), group).limit(most_groups).collect()
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    none = F.lit(False)
    near = [
        F.when(F.col(group) == r[group], hashed < int((1 << 40) * min(1.0, (1.5 * each + 50) / r["count"]))) for r in counts
    ]
    held: dict[object, list[int]] = {}
    for r in rows.where(F.coalesce(*near, none)).select(F.col(group).alias("g"), hashed.alias("h")).collect():
        held.setdefault(r["g"], []).append(r["h"])
    last = {g: sorted(hashes)[:each][-1] for g, hashes in held.items()}
    return rows.where(F.coalesce(*[F.when(F.col(group) == g, hashed <= h) for g, h in last.items()], none))
