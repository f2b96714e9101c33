"""How text filters interact: what each one removes in every order, from one pass over the texts.

A byte transducer with two states (outside, inside a word) reads the UTF-8 bytes once; its table gives the events of a byte
(a capital, the first byte of a code point, a symbol) and the borders of words, whose spans go into a hash
table that compares bytes before it calls two words equal. What fails which filter is five bits; counts per part and
set of failed filters are all that the audit of the 120 orders needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_slices, worker_store
from .spans import Bytes, SpanTable, scan

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: In percent: distinct words of all words at least, capitals of all code points at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = "#$%&*|"

#: Classes of bytes and events.
BLANK, CAPITAL, SYMBOL, OTHER, LATER = range(5)
IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4
FACTS = ("words", "distinct_words", "capitals", "code_points", "symbols")
SLICE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte; events by (state, class). White space leads outside, all else inside a word."""
    store = worker_store("audit")
    if not store:
        classes = np.full(256, OTHER, dtype=np.uint8)
        classes[[0x20, *range(0x09, 0x0E)]] = BLANK
        classes[65:91] = CAPITAL
        classes[[ord(c) for c in SYMBOLS]] = SYMBOL
        classes[0x80:0xC0] = LATER
        events = np.zeros((2, 5), dtype=np.uint8)
        events[:, [BLANK, OTHER]] = IS_POINT
        events[:, CAPITAL] = IS_POINT | IS_CAPITAL
        events[:, SYMBOL] = IS_POINT | IS_SYMBOL
        store |= {"classes": classes, "events": events}
    return store["classes"], store["events"]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols (rows) of the texts data[offsets[i]:offsets[i+1]]."""
    n = len(offsets) - 1
    out = np.zeros((len(FACTS), n), dtype=np.int64)
    classes, events = _tables()
    table = SpanTable(Bytes(data))
    for low, seen, starts, ends in scan(data, offsets, classes, events, BLANK):
        high = low + len(seen)
        first, last = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high, side="left")
        edges = np.clip(offsets[first : last + 1] - low, 0, high - low)
        for row, bit in ((2, IS_CAPITAL), (3, IS_POINT), (4, IS_SYMBOL)):
            out[row, first:last] += np.diff(np.searchsorted(np.flatnonzero(seen & bit), edges))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        out[0] += np.bincount(owner, minlength=n)
        out[1] += np.bincount(table.insert(owner, starts, ends - starts), minlength=n)
    return out


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "text"]
        for first, end, data, offsets in text_slices(batch, "text", SLICE):
            counts = text_counts(data, offsets)
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(c) for c in counts)], [*kept, *FACTS])


def text_facts(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the counts ``words``, ``distinct_words``, ``capitals``, ``code_points`` and ``symbols`` of every whole text.

    Words are runs of bytes that are not white space, compared byte by byte. A null text is empty; an empty text has zeros. Memory hangs
    on the longest text and its distinct words. Columns of ``keep`` named text or like a count are left out.
    """
    keep = [c for c in keep if c not in ("text", *FACTS)]
    rows = documents.select(*keep, "text")
    kept = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_facts, kept + ", ".join(f"{f} long" for f in FACTS))


def _bit(failed: Column, name: str) -> Column:
    return F.when(failed, 1 << FILTERS.index(name)).otherwise(0)


def _total(cells: Column, value, when) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + F.when(when(c["mask"]), value(c)).otherwise(F.lit(0).cast("long")))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the five filters, per part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``documents`` has doc_id, text and lang (other columns are ignored), ``labels`` doc_id, quality and toxic. A part is a value of
    lang; null counts as the empty string. Null texts are empty and equal to each other. Rows with one doc_id count
    each; of equal texts only those of the least doc_id pass filter E, and rows without doc_id, which have no order,
    pass it. A doc_id is good or toxic if any row of its labels says 1; null labels say nothing. An empty table gives no rows.

    Texts stay where they are: one pass makes (doc_id, digest, part, bits), aggregated before it is shuffled, so a text of a third of
    all rows is few rows. Digests are SHA-256.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )
    facts = text_facts(rows, ["doc_id", "part", "digest"])
    own = (
        _bit(F.col("words") < LEAST_WORDS, "A")
        + _bit(100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words"), "B")
        + _bit(100 * F.col("capitals") > MOST_CAPITALS * F.col("code_points"), "C")
        + _bit(F.col("symbols") > 0, "D")
    )
    failed = stored(facts.select("doc_id", "part", "digest", own.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "failed")

    # Rows without doc_id meet no label; the second key deals them out.
    known = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
        .where("good or toxic")
        .withColumn("spread", F.lit(0).cast("long"))
    )
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    labelled = failed.withColumn("spread", spread).join(known, ["doc_id", "spread"], "left").na.fill(False, ["good", "toxic"])

    # A text's rows per part and labels, and how many of them belong to their least doc_id.
    texts = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    at_least = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    texts = texts.select("part", "mask", "good", "toxic", "n", (F.col("without") + at_least).alias("firsts"))
    later = F.lit(1 << FILTERS.index("E"))
    cells = (
        texts.select(
            "part", "good", "toxic",
            F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + later).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c"),
        )
        .groupBy("part", F.col("c.mask").alias("mask"))
        .agg(
            F.sum("c.n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"),
        )
    )
    # At most one cell per set of failed filters, so a part is a list of at most 32.
    parts = stored(cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")), "parts")
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order"))
    steps = steps.select("part", "cells", "filter_order", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.ascii(F.substring(F.col("filter_order"), place, F.lit(1))) - ord(FILTERS[0]))

    steps = steps.withColumn("bit", bit(F.col("step"))).withColumn(
        "until", F.aggregate(F.sequence(F.lit(1), "step"), F.lit(0), lambda s, i: s + bit(i))
    )
    cells, own, until = F.col("cells"), F.col("bit"), F.col("until")
    earlier = until - own

    def here(mask: Column) -> Column:
        return (mask.bitwiseAND(own) != 0) & (mask.bitwiseAND(earlier) == 0)

    share = F.lit(120).cast("long")  # orders; 1 of k failed filters comes first in 120 / k of them
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total(cells, lambda c: c["n"], lambda m: m.bitwiseAND(until) == 0).alias("kept"),
        _total(cells, lambda c: c["n"], here).alias("removed"),
        _total(cells, lambda c: c["n"], lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        _total(cells, lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        _total(cells, lambda c: c["good"], here).alias("good_lost"),
        _total(cells, lambda c: c["toxic"], here).alias("toxic_lost"),
        _total(
            cells, lambda c: c["n"] * F.call_function("div", share, F.bit_count(c["mask"]).cast("long")), lambda m: m.bitwiseAND(own) != 0
        ).alias("shapley"),
    )
