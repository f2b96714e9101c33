"""Log files that grow: a ledger of what has been read, and readers of what lies behind it.

The ledger has a row per file: size, time, how far it is read (bytes and lines), and a digest of the bytes before that place. A
pass lists the folder and skips files whose size and time are known; the others are read from where
their last whole line ended, if the bytes before that place are still the same, and else anew as a new generation. ``bytes_read`` is what the last pass
read of a file as lines, besides ``TAIL`` bytes for the digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import listing

#: Bytes that one task reads of a file, bytes whose digest says that a file is still the same, and lines per Arrow batch.
CHUNK, TAIL, BATCH_LINES = 1 << 26, 256, 8192

LEDGER = (
    "file STRING, generation INT, size_bytes BIGINT, modified_at TIMESTAMP, offset BIGINT, line_count BIGINT, "
    "tail STRING, last_batch BIGINT, bytes_read BIGINT"
)
LINES = "file STRING, generation INT, line_number BIGINT, raw_line STRING, is_open BOOLEAN"


def _opened(file: str):
    """A random-access file by its path or address, on whatever store it is."""
    from pyarrow import fs

    scheme = re.match(r"^(\w[\w+.-]*):/", file)
    if not scheme or scheme[1] == "file":
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", file))
    system, path = fs.FileSystem.from_uri(re.sub(r"^(\w[\w+.-]*):/(?!/)", r"\1:///", file))
    return system.open_input_file(path)


def _part(file: str, start: int, end: int) -> bytes:
    with _opened(file) as f:
        f.seek(start)
        return f.read(max(end - start, 0))


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the last bytes before ``offset``."""
    for batch in batches:
        rows = batch.to_pylist()
        tails = [hashlib.sha256(_part(r["file"], max(0, r["offset"] - TAIL), r["offset"])).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(tails, pa.string())], ["file", "tail"])


def tails(files: DataFrame) -> DataFrame:
    return files.select("file", "offset").mapInArrow(_tails, "file STRING, tail STRING")


def _lines_of(file: str, start: int, end: int, first: int, size: int) -> Iterator[tuple[str, bool, int]]:
    """Lines that begin in bytes ``start`` to ``end`` of a file that is ``size`` long: text, whether it has no end yet, bytes if so.

    A line that begins earlier belongs to the chunk before; ``first`` is where the first chunk starts, which is a line's start.
    """
    with _opened(file) as f:
        f.seek(max(start - 1, first))
        held = f.read(min(end, size) - max(start - 1, first))
        at_end = end >= size
        while not at_end and not held.endswith(b"\n"):
            more = f.read(min(1 << 16, size - f.tell()))
            cut = more.find(b"\n")
            held += more if cut < 0 else more[: cut + 1]
            at_end = not more or f.tell() >= size and cut < 0
            if cut >= 0:
                break
    if start > first:
        cut = held.find(b"\n")
        # The chunk begins inside a line, unless the byte before it ends one.
        held = held[cut + 1 :] if cut >= 0 else b""
    ended = held.rfind(b"\n") + 1
    for line in held[:ended].splitlines():
        yield line.decode(errors="replace"), False, 0
    rest = held[ended:]
    if rest:
        yield rest.rstrip(b"\r").decode(errors="replace"), True, len(rest)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows = []
            for n, (text, is_open, size) in enumerate(_lines_of(r["file"], r["start"], r["end"], r["first"], r["size_bytes"])):
                rows.append((r["file"], r["generation"], r["start"], n, text, is_open, size))
                if len(rows) == BATCH_LINES:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
    names = ["file", "generation", "start", "local", "raw_line", "is_open", "open_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches below ``path`` that were finished, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(hadoop(f"{path}/batch=*/_SUCCESS")) or []
    return sorted(int(re.search(r"batch=(\d+)/", str(f.getPath().toString()))[1]) for f in found)


def ledger(spark: SparkSession, state: str) -> DataFrame:
    """The files known so far, as the last finished pass left them; none before the first one."""
    done = _folders(spark, f"{state}/ledger")
    if not done:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{state}/ledger/batch={done[-1]}")


def read_growth(spark: SparkSession, path: str, state: str, glob: str = "*.log") -> DataFrame:
    """Read what is new in the files below ``path`` and remember it below ``state``; return the new lines.

    Files with known size and time are not opened. Of a file that grew, the bytes behind the last whole line are read; a last line without an
    end is read as it is, marked ``is_open``, and read again when there is more. A file that became shorter, or whose bytes before the
    known place changed, is read anew. Files that went, or are empty now, keep their lines until they have others. What is to be read is cut into chunks, so one
    file of any growth is read by many tasks. A pass writes its lines, then the ledger: one that failed is repeated with the same number and
    overwrites what it left. Compressed files do not grow and are not for this reader. An empty or missing folder gives no rows.
    """
    done = _folders(spark, f"{state}/ledger")
    number = done[-1] + 1 if done else 0
    old = ledger(spark, state)
    try:
        now = listing(spark, path, glob).select("file", "size_bytes", "modified_at")
    except AnalysisException:  # there is no such folder yet
        now = spark.createDataFrame([], "file STRING, size_bytes BIGINT, modified_at TIMESTAMP")
    known = old.select("file", "generation", "offset", "line_count", "tail", F.col("size_bytes").alias("old_size"), F.col("modified_at").alias("old_time"))
    seen = now.join(known, "file", "left")
    changed = F.col("old_size").isNull() | (F.col("old_size") != F.col("size_bytes")) | (F.col("old_time") != F.col("modified_at"))
    seen = seen.filter(changed)
    grown = seen.filter(F.col("offset") <= F.col("size_bytes"))
    same = tails(grown.repartition("file")).withColumnRenamed("tail", "tail_now")
    same = seen.join(same, "file", "left").withColumn("goes_on", F.coalesce(F.col("tail") == F.col("tail_now"), F.lit(False)))
    first = F.when(F.col("goes_on"), F.col("offset")).otherwise(0)
    plan = same.select(
        "file", "size_bytes", "modified_at", first.alias("first"),
        F.when(F.col("goes_on"), F.col("line_count")).otherwise(0).alias("before"),
        (F.coalesce("generation", F.lit(-1)) + F.when(F.col("goes_on"), 0).otherwise(1)).cast("int").alias("generation"),
        (F.col("size_bytes") - first).alias("bytes_read"),
    )
    plan_path = f"{state}/plan/batch={number}"
    plan.write.mode("overwrite").parquet(plan_path)
    plan = spark.read.schema(plan.schema).parquet(plan_path)

    starts = F.explode(F.sequence("first", F.greatest("first", F.col("size_bytes") - 1), F.lit(CHUNK).cast("bigint")))
    chunks = plan.filter("size_bytes > first").select("file", "generation", "first", "size_bytes", starts.alias("start"))
    chunks = chunks.withColumn("end", F.least(F.col("start") + CHUNK, "size_bytes")).repartition("file", "start")
    raw_path = f"{state}/raw/batch={number}"
    raw = chunks.mapInArrow(
        _read, "file STRING, generation INT, start BIGINT, local BIGINT, raw_line STRING, is_open BOOLEAN, open_bytes BIGINT"
    )
    raw.write.mode("overwrite").parquet(raw_path)
    raw = spark.read.schema(raw.schema).parquet(raw_path)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.count_if(~F.col("is_open")).alias("ended"), F.max("open_bytes").alias("open_bytes"))
    offsets = sizes.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped")).join(plan.select("file", "before"), "file")
    numbered = raw.join(offsets, ["file", "start"]).select(
        "file", "generation", (F.col("before") + F.col("skipped") + F.col("local") + 1).alias("line_number"), "raw_line", "is_open"
    )
    lines_path = f"{state}/lines/batch={number}"
    numbered.write.mode("overwrite").parquet(lines_path)

    counts = sizes.groupBy("file").agg(F.sum("ended").alias("ended"), F.max("open_bytes").alias("open_bytes"))
    read = plan.join(counts, "file", "left").select(
        "file", "generation", "size_bytes", "modified_at",
        (F.col("size_bytes") - F.coalesce("open_bytes", F.lit(0))).alias("offset"),
        (F.col("before") + F.coalesce("ended", F.lit(0))).alias("line_count"), "bytes_read",
    )
    read = read.join(tails(read.repartition("file")), "file").withColumn("last_batch", F.lit(number).cast("bigint"))
    kept = old.join(plan.select("file"), "file", "left_anti").withColumn("bytes_read", F.lit(0).cast("bigint"))
    names = [field.split()[0] for field in LEDGER.split(", ")]
    read.select(*names).unionByName(kept.select(*names)).write.mode("overwrite").parquet(f"{state}/ledger/batch={number}")
    return spark.read.schema(LINES).parquet(lines_path)


def grown_lines(spark: SparkSession, state: str) -> DataFrame:
    """(file, line_number, raw_line) of all files as far as they are read: of each its last generation, and an open line only as last read."""
    done = _folders(spark, f"{state}/ledger")
    if not done:
        return spark.createDataFrame([], "file STRING, line_number BIGINT, raw_line STRING")
    lines = spark.read.schema(LINES).option("basePath", f"{state}/lines").parquet(*[f"{state}/lines/batch={n}" for n in done])
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint")
    files = ledger(spark, state).select("file", "generation", "last_batch")
    rows = lines.withColumn("read_in", batch).join(files, ["file", "generation"])
    return rows.filter(~F.col("is_open") | (F.col("read_in") == F.col("last_batch"))).select("file", "line_number", "raw_line")
