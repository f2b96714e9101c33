"""Phrases that occur more often than their parts suggest, found by mining parts of the corpus and counting globally.

The corpus is dealt into a few shards, each spread over many tasks. A phrase of ``support`` occurrences has, in some shard, at least that shard's
share of them (by words), so each shard is mined completely at this lowered support, level by level: words, then
pairs of words frequent in a shard, then triples and quadruples of such pairs. What any shard finds and all shards together have often
enough is kept as a bit table of fixed size, and last all phrases the tables let through are counted, exactly and by their texts. The support is a
number of occurrences, so the shards must be fewer than it for the lowered support to leave anything out: it is their size
that grows with the data. A fuller table lets more phrases through to the exact count and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, shuffles_let_go, small_side, stored, text_slices, worker_store
from .spans import SEED, Bytes, scan, span_hashes

SUPPORT = 30
LONGEST = 4
SHARDS = 3
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
COVERED = 80
#: Rows per language.
TOP = 2000
#: Scores are a / (l + r) in millionths of its largest value, rounded down.
SCALE = 2_000_000
#: Bits of a table of phrases (16 MB) as a power of two, and those of a bitmap of Spark's aggregate.
TABLE_BITS, MAP_BITS = 27, 15
#: Leading bits of a hash that are mined (TABLE_BITS at least; the others are zeros, which compress), and passes that count, each a part of the phrases.
HASH_BITS, PASSES = 40, 2
#: Bytes of text held at a time, and phrases gathered in a task before they are handed on.
SLICE, GATHERED = 1 << 21, 1 << 22
#: Groups a language's phrases are ranked in before they are ranked together.
RANK_GROUPS = 64
#: Counted phrases that are broadcast to their joins at most (of at most four words each); more are joined by a shuffle.
BROADCAST_PHRASES = 50_000

WORD, GAP, BREAK = range(3)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte for words, the events of breaks, and bytes with a-z for A-Z."""
    store = worker_store("phrases")
    if not store:
        classes = np.full(256, WORD, dtype=np.uint8)
        classes[[0x20, 0x09]] = GAP
        classes[[*(ord(c) for c in ".,;:!?"), *range(0x0A, 0x0E)]] = BREAK
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        store |= {"classes": classes, "lower": lower}
    return store["classes"], store["lower"]


def _windows(data: np.ndarray, gap: np.ndarray, ahead: int) -> Iterator[tuple[int, int, int]]:
    """Cut one long text at gaps: (first byte, end, end of the ``ahead`` words that follow)."""
    at = 0
    while len(data) - at > SLICE:
        near = np.flatnonzero(gap[data[at : at + SLICE]])
        end = at + int(near[-1]) + 1 if len(near) else at + SLICE
        while not len(near) and end < len(data):  # a word longer than a slice
            near = np.flatnonzero(gap[data[end : end + SLICE]])
            end = end + int(near[0]) + 1 if len(near) else min(end + SLICE, len(data))
        reach = 1 << 10
        while True:
            inside = ~gap[data[end : end + reach]]
            ends = np.flatnonzero(inside[:-1] & ~inside[1:])
            if len(ends) >= ahead or end + reach >= len(data):
                break
            reach *= 2
        yield at, end, end + int(ends[ahead - 1]) + 1 if len(ends) >= ahead else len(data)
        at = end
    if at < len(data):
        yield at, len(data), len(data)


class Words:
    """The words of a window of texts, and the hashes of the phrases that begin at each of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: int):
        """Phrases begin before byte ``begin``; what follows only ends them."""
        classes, lower = _tables()
        self.data = Bytes(lower[data])
        kind = classes[data]
        found = list(scan(data, offsets, np.minimum(classes, GAP), np.zeros((2, 2), np.uint8), GAP)) if len(data) else []
        self.starts = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        ends = np.concatenate([f[3] for f in found]) if found else self.starts
        self.lengths = ends - self.starts
        self.owner = np.searchsorted(offsets, self.starts, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == BREAK), self.starts) + self.owner
        self.begins = int(np.searchsorted(self.starts, begin))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words, each followed by one space, and the begin and end of each with its space."""
        ends = np.cumsum(self.lengths + 1)
        begins = ends - self.lengths - 1
        place = np.repeat(self.starts - begins, self.lengths + 1) + np.arange(ends[-1] if len(ends) else 0)
        place[ends - 1] -= 1
        raw = self.data.raw[place]
        raw[ends - 1] = 0x20
        return raw, begins, ends

    def hashes(self, language: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """For 1 to LONGEST words: the hash of the phrase from each word on, with its row's language."""
        words = span_hashes(self.data, self.starts, self.lengths, seed)
        out = [mix(words ^ language[self.owner])]
        for k in range(1, LONGEST):
            out.append(mix(out[-1][: max(len(words) - k, 0)] * SEED + words[k:]))
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether the k + 1 words from each word on are in one piece."""
        n = max(len(self.starts) - k, 0)
        out = self.piece[:n] == self.piece[k:]
        out[self.begins :] = False
        return out


class Table:
    """A bit per hash of the phrases found so far."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - TABLE_BITS)
        byte = self.bits[(place >> np.uint64(3)).astype(np.int64)]
        return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Words, pa.RecordBatch, np.ndarray]]:
    """Words, rows and language hashes of each window of ``batch``."""
    gap = _tables()[0] != WORD
    language = batch.column("language").to_numpy().view(np.uint64)
    for first, end, data, offsets in text_slices(batch, "text", SLICE):
        rows, own = batch.slice(first, end - first), language[first:end]
        if end - first > 1 or len(data) <= SLICE:
            yield Words(data, offsets, len(data)), rows, own
        else:
            for low, high, reach in _windows(data, gap, LONGEST - 1):
                yield Words(data[low:reach], np.array([0, reach - low]), high - low), rows, own


def _level(words: Words, language: np.ndarray, level: int, tables: list[Table]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the phrases of mining level 1, 2 or 3 (triples and quadruples) whose parts are frequent."""
    hashes = words.hashes(language)
    if level == 1:
        yield np.arange(words.begins), hashes[0][: words.begins]
        return
    below = tables[level - 2].has(hashes[level - 2])
    for k in [1] if level == 2 else range(2, LONGEST):
        n = max(len(words.starts) - k, 0)
        own = words.whole(k)
        for j in range(k + 1 if level == 2 else k):
            own &= below[j : j + n]
        at = np.flatnonzero(own)
        yield at, hashes[k][at]


MINED = "shard int, bucket int, hash long, n long"


def _mined(level: int, tables: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Table(bits) for bits in tables.value]
        leading = np.uint64((1 << 64) - (1 << (64 - HASH_BITS)))
        held: list[list[np.ndarray]] = [[] for _ in range(SHARDS)]
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for shard, parts in enumerate(held):
                if parts:
                    own, counts = np.unique(np.concatenate(parts) & leading, return_counts=True)
                    parts.clear()
                    bucket = own >> np.uint64(64 - TABLE_BITS + MAP_BITS)  # sorted like the hashes, so rows compress well
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), shard, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(counts)],
                        ["shard", "bucket", "hash", "n"],
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            for words, rows, language in _read(batch):
                shard = rows.column("shard").to_numpy()[words.owner]
                for at, hashes in _level(words, language, level, known):
                    own = shard[at]
                    for s in np.unique(own):
                        held[s].append(hashes[own == s])
                    size += len(hashes)
                if size >= GATHERED:
                    yield from given()
                    size = 0
        yield from given()

    return run


def _words_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SHARDS, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            for words, rows, _ in _read(batch):
                total += np.bincount(rows.column("shard").to_numpy()[words.owner[: words.begins]], minlength=SHARDS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARDS, dtype=np.int32)), pa.array(total)], ["shard", "n"])


def _mine(texts: DataFrame, level: int, tables: list[np.ndarray], lowered: list[int], support: int) -> np.ndarray:
    """The table of phrases that are frequent in any shard and have ``support`` occurrences in all shards together.

    Every level sees the same tables in all shards, so the shards' counts of a phrase are whole. Equal hashes only add to them.
    One exchange serves the counts, the sums over shards and the bitmaps.
    """
    context = texts.sparkSession.sparkContext
    counted = texts.mapInArrow(_mined(level, context.broadcast(tables)), MINED).repartition("bucket")
    own = [F.sum(F.when(F.col("shard") == s, F.col("n"))).alias(f"n{s}") for s in range(SHARDS)]
    sums = counted.groupBy("bucket", "hash").agg(F.sum("n").alias("n"), *own)
    in_a_shard = reduce(or_, [F.col(f"n{s}") >= n for s, n in enumerate(lowered)])
    frequent = sums.where(in_a_shard & (F.col("n") >= support))
    bit = F.shiftrightunsigned("hash", 64 - TABLE_BITS).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    maps = frequent.groupBy("bucket").agg(F.bitmap_construct_agg(bit).alias("bits")).toArrow()  # at most 2 ** TABLE_BITS bits
    table = np.zeros((1 << (TABLE_BITS - MAP_BITS), 1 << (MAP_BITS - 3)), dtype=np.uint8)
    for bucket, bits in zip(maps.column("bucket").to_pylist(), maps.column("bits")):
        table[bucket] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    return table.reshape(-1)


COUNTED = "lang string, phrase string, words int, n long"


def _phrase_texts(joined: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, k: int) -> pa.Array:
    """The texts of the phrases of k words at ``at``, words joined by one space."""
    raw, begins, ends = joined
    length = ends[at + k - 1] - 1 - begins[at]
    offsets = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(begins[at] - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[place])])


def _same_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each pair of numbers; the pairs differ in ``a`` as good as always."""
    _, first, group, counts = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    if (b != b[first][group]).any():
        _, first, counts = np.unique(np.stack([a, b]), axis=1, return_index=True, return_counts=True)
    return first, counts


def _counted(tables: Broadcast, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Table(bits) for bits in tables.value]
        names = ["lang", "phrase", "words", "n"]

        def rows_of(lang, phrase, k, n):
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), pa.array(n)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for words, rows, language in _read(batch):
                lang = rows.column("lang")
                if part == 0:
                    each = np.bincount(words.owner[: words.begins], minlength=rows.num_rows)
                    yield rows_of(lang, pa.nulls(rows.num_rows, pa.string()), 0, each)
                hashes, others, joined = words.hashes(language), words.hashes(language, 1), words.joined()
                for k in range(LONGEST):
                    n = max(len(words.starts) - k, 0)
                    own = known[min(k, len(known) - 1)].has(hashes[k][:n]) & words.whole(k)
                    at = np.flatnonzero(own)
                    at = at[hashes[k][at] % np.uint64(PASSES) == part]
                    first, counts = _same_keys(hashes[k][at], others[k][at])
                    if len(first):
                        yield rows_of(lang.take(pa.array(words.owner[at[first]])), _phrase_texts(joined, at[first], k + 1), k + 1, counts)

    return run


def count_phrases(documents: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 1 to LONGEST words with at least ``support`` occurrences in a language, exactly.

    The row with a null phrase and 0 words has the number of all words of the language; languages without words have such a row too.
    Each pass over the texts counts a part of the phrases, dealt by hash, and is written before the next begins.
    """
    lang = F.coalesce("lang", F.lit("und"))
    shard = F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int")
    texts = documents.select("text", lang.alias("lang"), F.xxhash64(lang).alias("language"), F.coalesce(shard, F.lit(0)).alias("shard"))
    mined = texts.select("text", "language", "shard")
    context, passes = documents.sparkSession.sparkContext, []
    with shuffles_let_go(documents.sparkSession):  # of each level and pass when it is over
        sizes = {r["shard"]: r["n"] for r in mined.mapInArrow(_words_of_shards, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        total = sum(sizes.values())
        # Some shard has at least its share of any ``support`` occurrences; a share is rounded up.
        lowered = [max(1, -(-support * sizes.get(s, 0) // max(total, 1))) for s in range(SHARDS)]
        tables: list[np.ndarray] = []
        for level in (1, 2, 3):
            tables.append(_mine(mined, level, tables, lowered, support))
        known = context.broadcast(tables)
        for part in range(PASSES):
            counted = texts.select("text", "lang", "language").mapInArrow(_counted(known, part), COUNTED)
            sums = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
            passes.append(stored(sums.where((F.col("words") == 0) | (F.col("n") >= support)), "phrases"))
    return reduce(DataFrame.union, passes)


def _part(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("split", first, last - first + 1), " ")


def collocations(documents: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, occurrences and text.

    ``documents`` has text and lang; other columns are ignored. A-Z is lower-cased; texts are cut into pieces at ``.,;:!?`` and line
    ends and these into words at blanks. Null texts are empty; a null language is ``und``. Repeated rows count each.
    A phrase of 2 to 4 words has a occurrences, ``support`` at least; of the cuts into a first part (l) and the rest (r) the
    one with the least score counts, ties to the shorter first part. Phrases inside a longer one that has COVERED percent of their occurrences
    are left out. Scores are exact (decimals where 64 bits would not do). Languages without such a phrase, and empty tables, give no rows.

    Texts are read once per level and twice to count; hashes and counts are shuffled, never texts. Tables of 2 ** TABLE_BITS bits
    are all that goes through the driver.
    """
    known = count_phrases(documents, support)
    words = small_side(known.where("words = 0").select("lang", F.col("n").alias("all_words")), BROADCAST_PHRASES)
    phrases = known.where("words > 0")
    split = phrases.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("split"))

    one = F.lit(1)
    cuts = split.select("lang", "phrase", "words", "a", "split", F.explode(F.sequence(one, F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k", _part(one, F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("words")).alias("tail")
    )
    counts = small_side(phrases.select("lang", F.col("phrase").alias("part"), "n"), BROADCAST_PHRASES)
    heads = counts.select("lang", F.col("part").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("part").alias("tail"), F.col("n").alias("r"))
    score = F.expr(f"(cast(a as decimal(19, 0)) * {SCALE}) div (cast(l as decimal(19, 0)) + r)").cast("long")
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )

    inner = split.where("words > 2").select("lang", "words", "a", "split", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "words", "a", "split", "size", F.explode(F.sequence(one, F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", _part(F.col("at"), F.col("at") + F.col("size") - 1).alias("phrase")).agg(F.max("a").alias("around"))
    covered = F.expr(f"cast(100 as decimal(19, 0)) * around >= cast({COVERED} as decimal(19, 0)) * a")
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | ~covered)

    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score"
    )
