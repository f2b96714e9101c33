"""Text files: line tables, whole contents, listings, format sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

MOST_SPLITS = 500_000
JSON_EXTENSIONS, SNIFFED_LINES = ("json", "jsonl"), 5
# Words in the first lines that name a tool.
TOOL_WORDS = [("afl", ["afl-fuzz", "american fuzzy lop"]), ("libfuzzer", ["libfuzzer"]), ("honggfuzz", ["honggfuzz"]), ("cifuzz", ["cifuzz"])]


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file``, 1-based ``line_number``, ``raw_line`` of every text file below ``path`` (also ``.gz``).

    A file may be read in several splits. A split's lines have numbers in a row as they are read, and
    the splits' line counts and first numbers, one row per split, give the offset: no text moves, and a
    file of any size is numbered without ever being one row or one group. Beyond ``MOST_SPLITS``
    splits the offsets are not broadcast but joined.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("raw_line"),
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    offsets = sizes.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    if offsets.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["file", "split"]).select("file", (F.col("offset") + F.col("seq")).alias("line_number"), "raw_line")


def file_contents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, size and text. For source files and documents, not for logs."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value").alias("content"),
    )


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, directory, size and modification time of every file; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.col("path").alias("file"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as listings give it, with the scheme of its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def storage_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("directory").agg(F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("file_count"))


def folder_totals(files: DataFrame, root: str) -> DataFrame:
    """Bytes and entries (files and folders) of each folder of ``files`` (a ``listing`` below ``root``) with all that lies below it.

    ``folder`` is relative to ``root``, which is the empty text itself. Files fold to their own folder before a folder's figures go to
    each folder around it, so only small rows are multiplied, by their depth. A listing has files only:
    folders without any file below them are not seen.
    """
    within = F.substr("directory", F.lit(len(root.rstrip("/")) + 1))
    own = files.groupBy(F.array_remove(F.split(within, "/"), "").alias("parts")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.count("*").alias("entries")
    )

    def around(levels: Column) -> Column:
        return F.transform(levels, lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))

    depth = F.size("parts")
    rolled = own.select("size_bytes", "entries", F.explode(around(F.sequence(F.lit(0), depth))).alias("folder"))
    totals = rolled.groupBy("folder").agg(F.sum("size_bytes").alias("size_bytes"), F.sum("entries").alias("files"))
    parts = F.array_remove(F.split("folder", "/"), "")
    folders = totals.filter("folder <> ''").select(parts.alias("parts"))
    inner = folders.select(F.explode(around(F.sequence(F.lit(0), depth - 1))).alias("folder")).groupBy("folder").agg(F.count("*").alias("folders"))
    entries = F.col("files") + F.coalesce("folders", F.lit(0))
    return totals.join(inner, "folder", "left").select("folder", "size_bytes", entries.alias("entries"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def sniffing_tests(line: Column) -> dict[str, Column]:
    """Format -> test of one of the first lines, in order of precedence."""
    stripped = T.strip(line)
    low = F.lower(stripped)
    tests = {"json": stripped.startswith("{"), "xml": stripped.startswith("<"), "csv": F.size(F.split(stripped, ",")) > 3}
    return tests | {tool: T.has(low, *words) for tool, words in TOOL_WORDS}


def format_of(file: Column, names: list[str]) -> Column:
    """The extension decides, then the first test (a boolean column of that name) that held."""
    ext = extension(file)
    found = F.when(ext.isin(*JSON_EXTENSIONS), "json").when(ext == "xml", "xml").when(ext == "csv", "csv")
    for name in names:
        found = found.when(F.col(name), name)
    return found.otherwise("text")


def detect_formats(lines: DataFrame) -> DataFrame:
    """Format per file: by extension, else by its first lines."""
    tests = sniffing_tests(F.col("raw_line"))
    seen = (
        lines.filter(F.col("line_number") <= SNIFFED_LINES)
        .groupBy("file")
        .agg(*[F.max(test).alias(name) for name, test in tests.items()])
    )
    return seen.select("file", format_of(F.col("file"), list(tests)).alias("format"))
