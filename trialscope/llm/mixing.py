"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Each source has a target in words; its documents are all taken the same whole number of times, and each has a fraction of one
more copy. Fractions become copies in pairs: two documents of a source exchange mass (words times fraction) in a random
direction until one of them has a whole copy or none, and the other one goes on. An exchange keeps the pair's
mass, and its directions are weighted so that each document's expected copies stay as they were. Documents of like size meet in
groups of bounded size; what a group leaves open goes up a tree, level by level, until each size class of a source has
one open document at most. These are settled together, the largest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_side, stored

WEIGHTS = (3, 1, 2)
#: Words taken of all words, in percent; copies of a source's words at most.
SHARE, MOST_COPIES = 150, 2
#: Bits of the hash that one level of the tree folds: groups have about 2 ** GROUP_BITS documents.
GROUP_BITS = 5
#: Size classes per doubling of the size.
CLASSES = 4
#: Sources broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
MADE = ("size", "source_size", "target", "taken")


def _uniform(*what) -> Column:
    """A number of [0, 1) that hangs on ``what`` alone."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / float(1 << 52)


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: ranks of a range's rows and the sizes of earlier ranges."""
    order = [F.col("source").asc_nulls_last()]
    ranges = stored(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sources")
    each = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # a row per partition
    before, total = [], 0
    for r in each:
        before += [F.lit(r["range"]), F.lit(total)]
        total += r["n"]
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("rank", own + (F.create_map(*before)[F.col("range")] if before else 0)).drop("range")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` percent of all sizes, dealt by weight, at most ``most`` times a source's size.

    Weights repeat in the order of sources (code points, null last). What a source cannot take is dealt
    to the others by weight until none is above its limit: targets are the least of limit and weight times one level, and each
    round raises the level to what the sources below their limits must bear. Rounds are aggregates over sources; the driver holds sums.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    known = stored(_ranked(sizes).select("source", "source_size", weight.alias("weight"), limit.alias("limit")), "targets")
    totals = known.agg(F.sum("source_size").alias("size"), F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
    if not totals["size"]:
        return known.select("source", "source_size", F.lit(0.0).alias("target"))
    budget = min(float(share * totals["size"]) / 100, totals["limit"])
    level, free = budget / totals["weight"], None
    while True:
        above = F.col("limit") <= F.col("weight") * level
        got = known.agg(
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if got["weight"] in (0.0, free):
            break
        free, level = got["weight"], (budget - got["full"]) / got["weight"]
    return known.select("source", "source_size", F.when(above, F.col("limit")).otherwise(F.col("weight") * level).alias("target"))


def _settled(item: Column, copies) -> Column:
    return F.struct(*[item[c].alias(c) for c in ("key", "size", "mass", "hash", "bits")], F.lit(copies).cast("int").alias("copies"))


def _pair(level: Column):
    """Meet the open document ``s.open`` with the next one: one of them is settled, the other one has the pair's mass."""

    def step(s: Column, b: Column) -> Column:
        a = s["open"]
        up = F.least(a["size"] - a["mass"], b["mass"])  # b gives until a is whole or b empty
        down = F.least(a["mass"], b["size"] - b["mass"])  # a gives until a is empty or b whole
        rises = _uniform(b["hash"], a["hash"], level) * (up + down) < down
        whole_a, empty_a = a["size"] - a["mass"] <= b["mass"], a["mass"] <= b["size"] - b["mass"]
        done = (
            F.when(rises & whole_a, _settled(a, 1)).when(rises, _settled(b, 0)).when(empty_a, _settled(a, 0)).otherwise(_settled(b, 1))
        )
        left = (
            F.when(rises & whole_a, b.withField("mass", b["mass"] - (a["size"] - a["mass"])))
            .when(rises, a.withField("mass", a["mass"] + b["mass"]))
            .when(empty_a, b.withField("mass", b["mass"] + a["mass"]))
            .otherwise(a.withField("mass", a["mass"] - (b["size"] - b["mass"])))
        )
        return F.struct(left.alias("open"), F.concat(s["done"], F.array(done)).alias("done"))

    return step


def _fold_groups(items: DataFrame, level: int) -> DataFrame:
    """Settle all but one document of each group (source, class, first bits of the hash); the open one has null copies."""
    group = F.call_function("shiftrightunsigned", F.col("hash"), (F.lit(64) - F.col("bits")).cast("int"))
    group = F.when(F.col("bits") == 0, 0).otherwise(group)
    item = F.struct("hash", "key", "size", "mass", "bits")
    sets = items.groupBy("source", "class", group.alias("group")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = F.col("items")[0]
    start = F.struct(first.alias("open"), F.filter(F.array(_settled(first, 0)), lambda x: F.lit(False)).alias("done"))
    folded = sets.select(
        "source", "class", F.aggregate(F.expr("slice(items, 2, greatest(size(items) - 1, 0))"), start, _pair(F.lit(level))).alias("f")
    )
    rows = folded.select("source", "class", F.explode(F.concat(F.col("f.done"), F.array(_settled(F.col("f.open"), None)))).alias("r"))
    return rows.select("source", "class", "r.*")


def _settle_classes(items: DataFrame) -> DataFrame:
    """Settle the open documents of a source's classes (a bounded number), the largest first.

    A document is taken with its own probability where the smaller ones can still even out either choice,
    otherwise as they can, or as comes nearest: the source's words miss their target by about the smallest sizes.
    """
    item = F.struct("size", "hash", "key", "mass", "bits")
    sets = items.groupBy("source").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"), F.sum("mass").alias("mass"), F.sum("size").alias("size"))

    def step(s: Column, b: Column) -> Column:
        rest = s["rest"] - b["size"]  # words of the smaller ones
        miss = F.greatest(b["size"] + 0.0 - s["mass"], s["mass"] - b["size"] - rest, F.lit(0.0))  # of the target, if taken
        lose = F.greatest(s["mass"] - rest, F.lit(0.0))  # if not
        taken = F.when(miss == lose, _uniform(b["hash"], F.lit("last")) * b["size"] < b["mass"]).otherwise(miss < lose)
        left = F.when(taken, s["mass"] - b["size"]).otherwise(s["mass"])
        done = F.when(taken, _settled(b, 1)).otherwise(_settled(b, 0))
        return F.struct(left.alias("mass"), rest.alias("rest"), F.concat(s["done"], F.array(done)).alias("done"))

    none = F.filter(F.array(_settled(F.col("items")[0], 0)), lambda x: F.lit(False))
    start = F.struct("mass", F.col("size").cast("double").alias("rest"), none.alias("done"))
    return sets.select("source", F.explode(F.aggregate("items", start, step)["done"]).alias("r")).select("source", "r.*")


def mix_sources(documents: DataFrame, keep: list[str], weights=WEIGHTS, share: int = SHARE, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """Columns ``keep`` with ``size``, ``source_size``, ``target`` and ``taken`` for every row of ``documents`` (with ``text`` and ``source``).

    ``size`` is the number of words (runs without white space; null: 0), ``target`` the row's source's words to take, ``taken`` the row's
    words times its copies. With r = target / source_size every row of a source has the whole part of r
    copies, and one more with the remaining fraction as probability; a source's ``taken`` add up to its target but for
    less than a small document, and no row has more than ``most`` copies. The same rows give the same result, however they are cut into files
    and tasks; another ``seed`` draws anew. Rows without words take none. Null sources are one source,
    the last one. Equal rows are evened out among themselves first, so a hot row is one document of the tree. An empty table gives
    no rows. Columns of ``keep`` must be comparable; those named like a result column are left out.

    Texts are counted in place; then short rows are grouped. A source of any size is folded in groups of about
    2 ** GROUP_BITS rows per level, so the levels grow with the logarithm of the rows and no group with the data.
    """
    keep = [c for c in keep if c not in MADE]
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
    key = F.struct(*[F.col(c) for c in keep], F.lit(0).alias("-")) if not keep else F.struct(*keep)
    rows = stored(
        documents.select(key.alias("key"), "source", words.alias("size")).groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes"
    )
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = stored(source_targets(sources, weights, share, most), "targets")
    aim = small_side(targets.withColumnRenamed("source", "of"), BROADCAST_SOURCES)
    rows = rows.join(aim, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    # Equal rows: so many have one copy more, and at most one row stays open.
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(rate)).withColumn("share", F.col("rows") * (rate - F.col("base")))
    rows = rows.withColumn("more", F.floor("share")).withColumn("mass", (F.col("share") - F.col("more")) * F.col("size"))
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    rows = stored(
        rows.withColumn("open", F.coalesce(open_, F.lit(False)))
        .withColumn("hash", F.xxhash64(F.lit(seed), "key", "source", "size"))
        .withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1))) * CLASSES).cast("int")),
        "rates",
    )

    counts = rows.where("open").groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
    depth = F.greatest(F.ceil(F.log2("n")) - GROUP_BITS, F.lit(0)).cast("int")
    depths = stored(counts.select(F.col("source").alias("of"), F.col("class").alias("like"), depth.alias("bits")), "depths")
    levels = -(-(depths.agg(F.max("bits")).first()[0] or 0) // GROUP_BITS) + 1
    items = rows.where("open").join(
        small_side(depths, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("like"))
    )
    items = items.select("source", "class", "key", "size", "hash", "mass", "bits")
    settled = []
    for level in range(levels):
        folded = stored(_fold_groups(items, level), "fold")
        settled.append(folded.where("copies is not null"))
        items = folded.where("copies is null").withColumn("bits", F.greatest(F.col("bits") - GROUP_BITS, F.lit(0))).drop("copies")
    settled.append(_settle_classes(items))

    names = ["key", "source", "size"]
    copies = settled[0].select(*names, "copies")
    for other in settled[1:]:
        copies = copies.unionByName(other.select(*names, "copies"))
    one = stored(copies, "copies").select(*[F.col(n).alias(f"own_{n}") for n in names], "copies")
    same = [F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]
    rows = rows.join(one, (F.col("open") & same[0] & same[1] & same[2]), "left")
    more = F.col("more") + F.coalesce("copies", F.lit(0)) + F.when(F.col("open") | (F.col("mass") == 0), 0).otherwise(1)
    parts = F.array(F.struct(F.lit(1).alias("extra"), more.alias("n")), F.struct(F.lit(0).alias("extra"), (F.col("rows") - more).alias("n")))
    dealt = rows.select("key", "size", "source_size", "target", "base", F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p"))
    return dealt.select(
        *[F.col("key")[c].alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("base") + F.col("p.extra"))).cast("long").alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n"))).alias("-"),
    ).drop("-")
