"""Recurrences over ordered rows, without putting a group into one task.

A smoothing recurrence is a chain of affine steps, and affine steps compose: a run of
rows is fully described by how much of the start value survives it and what it adds.
So the rows are range-partitioned by (keys, order), every task folds its runs, and only
one small row per (key, task) is put together at the end. A key that holds most of the
table is spread over many tasks like any other range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path


def segments_of(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float, add: float) -> DataFrame:
    """One affine step (``survives``, ``adds``) per key and task for ``s <- keep * s + add * value``."""
    ranged = df.select(*keys, *order, F.col(value).cast("double").alias("_v"))
    ranged = ranged.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = ranged.select(*keys, "_v", F.spark_partition_id().alias("_task"))
    key_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The run that is still open: key values, task, survives, adds.
        current: list | None = None
        for batch in batches:
            changed = (batch[keys] != batch[keys].shift()).any(axis=1)
            done = []
            for _, run in batch.groupby(changed.cumsum(), sort=False):
                values = run["_v"].to_numpy()
                survives = keep ** len(values)
                adds = add * float(values @ keep ** np.arange(len(values) - 1, -1, -1, dtype="float64"))
                key = [run[k].iloc[0] for k in keys]
                if current is not None and current[: len(keys)] == key:
                    current[-2:] = [current[-2] * survives, current[-1] * survives + adds]
                    continue
                if current is not None:
                    done.append(current)
                current = [*key, int(run["_task"].iloc[0]), survives, adds]
            if done:
                yield pd.DataFrame(done, columns=columns)
        if current is not None:
            yield pd.DataFrame([current], columns=columns)

    columns = [*keys, "task", "survives", "adds"]
    return ranged.mapInPandas(fold, f"{key_fields}, task int, survives double, adds double")


def smoothed_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The steps of each key put together, in task order, into one step."""
    chain = F.array_sort(F.collect_list(F.struct("task", "survives", "adds")))
    first = F.struct(F.lit(1.0).alias("survives"), F.lit(0.0).alias("adds"))
    whole = F.aggregate(
        chain,
        first,
        lambda s, x: F.struct(
            (s["survives"] * x["survives"]).alias("survives"), (s["adds"] * x["survives"] + x["adds"]).alias("adds")
        ),
    )
    return segments.groupBy(*keys).agg(whole.alias("step")).select(*keys, "step.survives", "step.adds")


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, keep: float, add: float, start: float = 0.0) -> DataFrame:
    """Final value of ``s <- keep * s + add * value`` per key, from ``start``, in ``order``."""
    steps = smoothed_segments(segments_of(df, keys, order, value, keep, add), keys)
    return steps.select(*keys, (F.col("survives") * start + F.col("adds")).alias("smoothed"))


def running_total(df: DataFrame, order: str, delta: str) -> DataFrame:
    """``df`` with ``running``: the sum of ``delta`` (whole numbers) up to each row, over the whole table.

    ``order`` must be unique (fold ties first). Rows are range-partitioned by it, each task sums its own,
    and the tasks' totals, one row each, are added as offsets. The summed rows are written to the
    shared folder first: the ranges of two evaluations need not be the same.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_task", F.spark_partition_id())

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            batch["_inside"] = total + batch[delta].cumsum()
            if len(batch):
                total = int(batch["_inside"].iloc[-1])
            yield batch

    fields = ", ".join(f"`{n}` {t}" for n, t in ranged.dtypes)
    path = work_path(df.sparkSession, "running")
    inside = ranged.mapInPandas(add, f"{fields}, _inside bigint")
    inside.write.parquet(path)
    inside = df.sparkSession.read.schema(inside.schema).parquet(path)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.groupBy("_task").agg(F.sum(delta).alias("_t"))
    offsets = totals.select("_task", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    return (
        inside.join(F.broadcast(offsets), "_task")
        .withColumn("running", F.col("_inside") + F.col("_offset"))
        .drop("_task", "_inside", "_offset")
    )


def first_of_each(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """``df`` with ``rank`` (from 1, in ``order``) of the first ``most`` rows of each key.

    Rows are cut to ``most`` per input partition, then per 256th of these, then per key: a key that holds
    most of the table is never in one task before it is cut.
    """
    rows = df.withColumn("_part", F.spark_partition_id())
    for group in ([*keys, "_part"], [*keys, "_some"], keys):
        rows = rows.withColumn("_some", F.col("_part") % 256)
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        rows = rows.withColumn("rank", rank).filter(F.col("rank") <= most)
    return rows.drop("_part", "_some")
