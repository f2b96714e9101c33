"""Streaming input and output over the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..session import work_path

#: Batches whose rows are put together into a new base, and seconds between two looks at a running job's progress.
COMPACT_EVERY, POLL_SECONDS = 32, 5


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table as a file stream, each file read once.

    A table stored as one file is found by its name in the parent folder.
    """
    root, file = sf_dir.rstrip("/"), f"{name}.parquet"
    schema = spark.read.parquet(f"{root}/{file}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{file}")
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if file_system.getFileStatus(hadoop_path).isDirectory():
        return reader.parquet(f"{root}/{file}")
    return reader.option("pathGlobFilter", file).parquet(root)


def _start(writer, path: str, checkpoint: str | None, trigger: dict | None):
    """Start ``writer``; what it has done is remembered in ``checkpoint`` (default: beside ``path``)."""
    return writer.option("checkpointLocation", checkpoint or f"{path}-progress").trigger(**(trigger or {"availableNow": True}))


def append(
    stream: DataFrame, label: str, target: str | None = None, checkpoint: str | None = None, trigger: dict | None = None
) -> DataFrame:
    """Append all available input to a table; return the table.

    With ``target`` (and ``checkpoint``) of an earlier run the job goes on where that stopped. ``trigger``
    holds the arguments of the stream's trigger, by default one run over what there is.
    """
    path = target or work_path(stream.sparkSession, label)
    _start(stream.writeStream.format("parquet"), path, checkpoint, trigger).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def each_batch(
    stream: DataFrame,
    label: str,
    write: Callable[[DataFrame, int, str], None],
    mode: str = "update",
    target: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> str:
    """Run over all available input with ``write(batch, batch_id, path)``; return the path.

    ``write`` must give the same result when a batch is repeated after a failure. ``target``,
    ``checkpoint`` and ``trigger`` as in ``append``. Rows that came behind the watermark of a job with a
    delay are counted in the table ``late`` below the path.
    """
    path = target or work_path(stream.sparkSession, label)
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, batch_id: write(batch, batch_id, path))
    query = _start(writer, path, checkpoint, trigger).start()
    late: dict[int, int] = {}
    try:
        ended = False
        while not ended:
            ended = query.awaitTermination(POLL_SECONDS)
            # The session remembers the last batches only (100 by default), so they are noted while the job runs.
            for progress in query.recentProgress:
                dropped = sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
                late[progress["batchId"]] = max(dropped, late.get(progress["batchId"], 0))
    finally:
        rows = [(batch_id, n) for batch_id, n in late.items() if n]
        stream.sparkSession.createDataFrame(rows, LATE).coalesce(1).write.mode("append").parquet(f"{path}/late")
    return path


LATE = "batch BIGINT, rows BIGINT"


def late_rows(spark: SparkSession, path: str) -> int:
    """Rows that the runs into ``path`` left out as late; none for jobs without a delay."""
    late = spark.read.schema(LATE).parquet(f"{path}/late").groupBy("batch").agg(F.max("rows").alias("rows"))
    return late.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def batches(spark: SparkSession, path: str, schema, numbers: list[int] | None = None) -> DataFrame:
    """All rows below ``path``, or those of the batches ``numbers``, with the ``batch`` that wrote them; none if no batch ran."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    folders = [path] if numbers is None else [batch_folder(path, number) for number in numbers]
    rows = reader.parquet(*folders) if folders else spark.createDataFrame([], reader_schema(spark, schema))
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint") if folders else F.lit(None).cast("bigint")
    return rows.withColumn("batch", named)


def reader_schema(spark: SparkSession, schema) -> StructType:
    return schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema


def _files(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of, of(path).getFileSystem(spark._jsc.hadoopConfiguration())


#: Mark of a folder that is whole; our own, as committers may be told to leave none.
DONE = "_done"


def _write_marked(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch folder anew (an old mark goes first) and mark it."""
    folder = batch_folder(path, batch_id)
    rows.write.mode("overwrite").parquet(folder)
    of, system = _files(rows.sparkSession, folder)
    system.create(of(f"{folder}/{DONE}"), True).close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batch folders of ``path``; one that a failure cut short has no mark."""
    of, system = _files(spark, path)
    marks = system.globStatus(of(f"{path}/batch=*/{DONE}")) or []
    return sorted(int(mark.getPath().getParent().getName().removeprefix("batch=")) for mark in marks)


Fold = Callable[[DataFrame], DataFrame]


class Versions:
    """Rows that batches add to or replace: a base, and the changes of the batches behind it.

    ``fold`` takes rows with the ``batch`` that wrote them and gives the same columns with fewer rows; folding a fold with
    later rows has to be the same as folding all rows. Each batch writes a folder of ``changes``. Every ``COMPACT_EVERY``
    batches the base and the changes behind it are folded into a new base, which counts once it is whole; a failure before
    that leaves the old one in force, and a repeated batch writes the same folders again. The base before the newest one
    stays with its changes, for readers that still use it; all that is older goes. So what is kept and read
    follows the keys and a fixed number of batches, not the age of the job.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, fold: Fold):
        self.spark, self.path, self.schema, self.fold = spark, path, schema, fold
        self.based = StructType([*schema.fields]).add("batch", LongType())

    def bases(self) -> list[int]:
        return _numbers(self.spark, f"{self.path}/base")

    def rows(self, upto: int | None = None, base: int | None = None) -> DataFrame:
        """The newest base (or ``base``) and the changes behind it, up to batch ``upto``, unfolded."""
        known = self.bases() if base is None else [base]
        base = known[-1] if known else -1
        behind = [n for n in _numbers(self.spark, f"{self.path}/changes") if n > base and (upto is None or n <= upto)]
        rows = batches(self.spark, f"{self.path}/changes", self.schema, behind)
        if base < 0:
            return rows
        return rows.unionByName(self.spark.read.schema(self.based).parquet(batch_folder(f"{self.path}/base", base)))

    def current(self) -> DataFrame:
        return self.fold(self.rows())

    def add(self, change: DataFrame, batch_id: int) -> None:
        _write_marked(change, f"{self.path}/changes", batch_id)
        if (batch_id + 1) % COMPACT_EVERY == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Make the base of all batches up to ``upto``, and drop what only bases before the last one needed."""
        before = [n for n in self.bases() if n < upto]
        rows = self.rows(upto, before[-1] if before else -1)
        _write_marked(self.fold(rows), f"{self.path}/base", upto)
        if before:
            of, system = _files(self.spark, self.path)
            for number in before[:-1]:
                system.delete(of(batch_folder(f"{self.path}/base", number)), True)
            for number in _numbers(self.spark, f"{self.path}/changes"):
                if number <= before[-1]:
                    system.delete(of(batch_folder(f"{self.path}/changes", number)), True)


def versioned(
    stream: DataFrame, label: str, schema: StructType, change: Callable[[DataFrame], DataFrame], fold: Fold, mode: str = "update", **where
) -> DataFrame:
    """Run over the input, keep ``change(batch)`` of every batch as ``Versions`` do, return their folded rows without ``batch``.

    ``where``: ``target``, ``checkpoint`` and ``trigger`` as in ``append``.
    """

    def write(batch: DataFrame, batch_id: int, path: str) -> None:
        Versions(batch.sparkSession, path, schema, fold).add(change(batch), batch_id)

    path = each_batch(stream, label, write, mode, **where)
    return Versions(stream.sparkSession, path, schema, fold).current().drop("batch")


def upsert(stream: DataFrame, label: str, *keys: str, mode: str = "update", **where) -> DataFrame:
    """Run an aggregation, return the last row per key, whatever batch changed it; old versions go (``Versions``)."""

    def last(rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"), F.max("batch").alias("batch"))
        return newest.select("row.*", "batch")

    return versioned(stream, label, stream.schema, lambda batch: batch, last, mode, **where)
