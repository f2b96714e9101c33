"""Best-fit packing of token pieces by exact complements, planned on counts per length.

A plan needs the number of pieces of each length only, at most ``size`` numbers whatever the corpus. Its
patterns are exact: a sequence starts with the longest length left, and whenever a single length, a pair
or a triple of lengths that are still available sums to the gap, it closes the sequence; else the
longest length that fits goes in (best fit). A pattern is used as often as the counts allow.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, Words, byte_letters
from .common import small_side, stored, worker_store

SIZE = 4096
END_ID = 1
#: Rows (one per task and length) that are broadcast to the pieces at most; more are joined by a shuffle.
BROADCAST_OFFSETS = 200_000


class Complements:
    """Which lengths are left, with the sums of one, two and three of them that close a gap exactly."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64)  # by length, 0 to size
        self.size = len(counts) - 1
        self._pairs: np.ndarray | None = None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length] or self.counts[length] == 1:
            self._pairs = None

    def pair_sums(self) -> np.ndarray:
        """Whether two pieces sum to s (two of one length only if two are left)."""
        if self._pairs is None:
            here = (self.counts > 0).astype(np.float64)
            n = 2 * len(here)
            transform = np.fft.rfft(here, n)
            ways = np.rint(np.fft.irfft(transform * transform, n))[: self.size + 1].astype(np.int64)
            halves = np.arange(0, self.size // 2 + 1)
            ways[2 * halves] -= here[halves].astype(np.int64)
            able = ways > 0
            able[2 * halves] |= self.counts[halves] > 1
            self._pairs = able
        return self._pairs

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.counts[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """The available pair that sums to ``gap`` with the longest piece."""
        if not self.pair_sums()[gap]:
            return None
        long = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
        short = gap - long
        able = (self.counts[long] > 0) & (self.counts[short] > (long == short))
        found = np.flatnonzero(able)
        return [int(long[found[0]]), int(short[found[0]])] if len(found) else None

    def triple(self, gap: int) -> list[int] | None:
        """The available triple with the longest piece; its two others may not be longer."""
        long = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        able = long[(self.counts[long] > 0) & self.pair_sums()[gap - long]]
        for a in able.tolist():
            self.counts[a] -= 1
            self._pairs, held = None if self.counts[a] <= 1 else self._pairs, self._pairs
            rest = self.pair(gap - a)
            self.counts[a] += 1
            self._pairs = held
            if rest:
                return sorted([a, *rest], reverse=True)
        return None


def plan(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, copies), ...] and how many sequences each fills, for ``counts`` by length (0 to size)."""
    left = Complements(counts)
    out = []
    while True:
        lengths = np.flatnonzero(left.counts[1:]) + 1
        if not len(lengths):
            return out
        longest = int(lengths[-1])
        used = {longest: 1}
        left.take(longest, 1)
        gap = left.size - longest
        while gap:
            closing = left.single(gap) or (gap > 1 and left.pair(gap)) or (gap > 2 and left.triple(gap)) or None
            if closing is None:
                fits = np.flatnonzero(left.counts[1 : gap + 1])
                if not len(fits):
                    break
                closing = [int(fits[-1]) + 1]
            for length in closing:
                left.take(length, 1)
                used[length] = used.get(length, 0) + 1
                gap -= length
        more = min(int(left.counts[length]) // n for length, n in used.items())
        for length, n in used.items():
            left.take(length, more * n)
        out.append((sorted(used.items(), reverse=True), 1 + more))


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset): where pieces of a length go, by rank among them."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for used, times in patterns:
        offset = 0
        for length, n in used:
            first = ranks.get(length, 0)
            rows.append((length, first, n, base, offset))
            ranks[length] = first + n * times
            offset += length * n
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _encoder(source: str) -> Encoder:
    """The tokenizers library's splitter and model, asked for each chunk that is not remembered."""
    store = worker_store("large-pack-" + hashlib.sha256(source.encode()).hexdigest())
    if not store:
        split, letters = Words(source), byte_letters()
        model, split.model = split.tokenizer.model, None

        def word_ids(word: bytes | int) -> list[int]:
            return [word] if isinstance(word, int) else [t.id for t in model.tokenize("".join([letters[b] for b in word]))]

        def chunk_ids(chunk: str) -> bytes:
            if chunk.isascii() and chunk.isalpha():
                return array("I", [t.id for t in model.tokenize(chunk.lower())]).tobytes()
            return array("I", [i for w in split(chunk) for i in word_ids(w)]).tobytes()

        store["encoder"] = Encoder(chunk_ids)
    return store["encoder"]


PIECES = "piece int, start long, length long, part int, nth long, ids binary"


def _pieces(source, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(source.value)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)  # pieces of each length in this task so far
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            place = batch.schema.get_field_index("text")
            others = [i for i in range(batch.num_columns) if i != place]
            rows, columns = [], {k: [] for k in ("piece", "start", "length", "nth", "ids")}
            for i, text in enumerate(batch.column(place)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append(i)
                    for name, value in (("piece", k), ("start", at // 4), ("length", n), ("nth", int(seen[n])), ("ids", own)):
                        columns[name].append(value)
                    seen[n] += 1
            kept = batch.take(pa.array(rows, pa.int64()))
            made = [
                pa.array(columns["piece"], pa.int32()), pa.array(columns["start"], pa.int64()), pa.array(columns["length"], pa.int64()),
                pa.array([part] * len(rows), pa.int32()), pa.array(columns["nth"], pa.int64()), pa.array(columns["ids"], pa.binary()),
            ]
            names = ["piece", "start", "length", "part", "nth", "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(i) for i in others), *made], [*(batch.schema.names[i] for i in others), *names]
            )

    return run


def _placed(table):
    """Sequence and offset of the piece of a length with a rank; only these two numbers go through Python."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = table.value
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        own = rows[np.searchsorted((rows[:, 0] << 48) + rows[:, 1], (lengths << 48) + ranks, side="right") - 1]
        turn, times = ranks - own[:, 1], np.maximum(own[:, 2], 1)
        return pd.DataFrame({"sequence_id": own[:, 3] + turn // times, "offset": own[:, 4] + turn % times * lengths})

    return place


def pack(documents: DataFrame, tokenizer_file: str, keep: list[str], size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document of ``documents`` (with ``text``), each with its place in a sequence of ``size`` tokens at most.

    A document is its text's ids (without added special tokens; null counts as empty) and ``end_id``; only longer ones are cut, every
    ``size`` tokens. Columns: ``keep``, ``piece`` from 0, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit
    integers), ``ids_crc32`` of these, ``sequence_id``, ``offset`` (gapless from 0). Columns of ``keep`` named text, part, nth, before or like a
    result column are left out. Repeated rows are packed each; an empty table gives no rows.

    Texts are encoded once, in place, and their ids written. Each piece is numbered in its task by length, and the tasks'
    counts give it a rank among all pieces of its length: no length is gathered in one task. The
    plan's table has a row per length and pattern, so it is bounded by ``size`` and broadcast.
    """
    made = {"text", "part", "nth", "before", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    keep = [c for c in keep if c not in made]
    with open(tokenizer_file, encoding="utf-8") as file:
        source = file.read()
    context = documents.sparkSession.sparkContext
    rows = documents.select(*keep, "text")
    kept = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "text")
    pieces = stored(rows.mapInArrow(_pieces(context.broadcast(source), size, end_id), kept + PIECES), "pieces")

    each = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    table = context.broadcast(slots(plan(counts)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # A row per task and length: broadcast while it is small, so that the ids stay where they are.
    ranked = pieces.join(small_side(before, BROADCAST_OFFSETS), ["part", "length"])
    placed = ranked.withColumn("place", _placed(table)("length", F.col("nth") + F.col("before")))
    names = [c for c in pieces.columns if c not in ("part", "nth", "ids")]
    return placed.select(*names, F.crc32("ids").alias("ids_crc32"), "place.sequence_id", "place.offset", "ids")
