"""JSON readers: tolerant lines, strict lines, whole documents.

Every line keeps its file and number, because file order decides which record was written
last.  Schemas are given, never inferred.  Files are read in blocks, whatever their size; line ends are those
of Spark's text reader (\\n, \\r\\n, \\r).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.paths import scratch


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def file_name(path) -> F.Column:
    """Decoded path of ``_metadata.file_path``: %20 is a space, a plus stays."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def placed_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """``(path, place, line)`` of all lines of files of any size, blank ones only if asked for.

    Files are read in blocks by many tasks.  ``place`` (block start, number in the task) orders
    a file's lines as they stand; only their count is not known.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, place struct<block:long,n:long>, line string")
    raw = spark.read.text(path).select(
        file_name(F.col("_metadata.file_path")).alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
        ).alias("place"),
        F.col("value").alias("line"),
    )
    return raw if blank else raw.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


#: Blocks whose line counts are broadcast, as counted; with more of them they are joined by shuffles.
BLOCKS = 500_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` of all non-blank lines, numbered from 1; a missing path gives none.

    Files of any size are read in blocks by many tasks.  A first scan counts the lines of each block
    and keeps the number of its first; a block's lines are numbered on from the sum of those ahead
    of it in its file.  Both scans cut the files alike, as Spark does with the same files and settings.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, line_no long, line string")
    every = placed_lines(spark, path, blank=True).select("path", F.col("place.block").alias("block"), "place.n", "line")
    counts = every.groupBy("path", "block").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("path").alias("__path"), F.col("block").alias("__block"),
        (F.coalesce(F.sum("lines").over(ahead), F.lit(0)) - F.col("first") + 1).alias("__shift"),
    )
    at = scratch(spark, "lines")
    offsets.write.parquet(at)
    offsets = spark.read.schema(offsets.schema).parquet(at)
    if offsets.count() <= BLOCKS:
        offsets = F.broadcast(offsets)
    placed = every.join(offsets, (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    return placed.select("path", (F.col("n") + F.col("__shift")).alias("line_no"), "line").where(
        F.trim(F.regexp_replace("line", r"\s+", " ")) != ""
    )


def tolerant(spark: SparkSession, path: str, schema: str, numbered: bool = True) -> DataFrame:
    """``(path, line_no or place, rec)`` of the lines that hold a JSON object; all others are skipped.

    Cut-off lines, broken UTF-8, and null, list or number lines do not parse to an object.  Files
    may have any size; true line numbers cost a scan that counts lines.
    """
    parsed = (lines if numbered else placed_lines)(spark, path).withColumn("v", F.try_parse_json("line"))
    good = parsed.where(F.is_valid_utf8("line") & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    return good.select("path", "line_no" if numbered else "place", F.from_json("line", schema).alias("rec"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(path, place, rec)``: the same for files of any size, but a bad line is an error that names its file and line.

    All lines are looked at first, in blocks; only where one is bad the lines ahead of the first
    such one are counted.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    good = F.is_valid_utf8("line") & F.coalesce(
        F.startswith(F.schema_of_variant(F.try_parse_json("line")), F.lit("OBJECT")), F.lit(False)
    )
    first = placed_lines(spark, path).where(~good).agg(F.min(F.struct("path", "place")).alias("bad")).first().bad
    if first is not None:
        ahead = placed_lines(spark, path, blank=True).where(
            (F.col("path") == first.path)
            & (F.col("place") <= F.struct(F.lit(first.place.block).alias("block"), F.lit(first.place.n).alias("n")))
        )
        raise ValueError(f"not a JSON object: {first.path}:{ahead.count()}")
    return placed_lines(spark, path).select("path", "place", F.from_json("line", schema).alias("rec"))


def documents(spark: SparkSession, path: str, schema: str, skip: str = r"(^|/)all_[^/]*$") -> DataFrame:
    """One row per JSON document, combined files left out."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumn("path", file_name(F.col("_metadata.file_path"))).where(~F.col("path").rlike(skip))


def chapter_files(spark: SparkSession, path: str) -> DataFrame:
    """``(chapter, text)`` of ``chapter_<n>.txt``; other names are skipped."""
    from ..functions.ids import chapter_number

    raw = spark.read.text(path, wholetext=True).select(
        chapter_number(file_name(F.col("_metadata.file_path"))).alias("chapter"), F.col("value").alias("text")
    )
    return raw.where("chapter IS NOT NULL")


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their embeddings: one table, so texts and vectors cannot fall out of step."""
    return spark.read.schema(
        "novel string, chapter int, chunk_idx int, text string, embedding array<float>"
    ).parquet(path)


def dataset_split(
    spark: SparkSession, schema: str, files: list[str] | None = None, folder: str | None = None, split: str = "train",
    configs: list[str] | None = None,
) -> DataFrame:
    """A corpus split: explicit files, else a folder's ``<split>`` files, else all configs of the folder, concatenated."""
    from functools import reduce

    def load(path: str) -> DataFrame:
        if path.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
            return spark.read.schema(schema).json(path)
        return spark.read.schema(schema).parquet(path)

    if files:
        parts = [load(f) for f in files]
    elif folder and configs:
        parts = [load(f"{folder}/{c}/{split}*.parquet") for c in configs]
    elif folder:
        found = next(
            (
                p
                for p in (
                    f"{folder}/{split}*.parquet", f"{folder}/{split}*.jsonl", f"{folder}/{split}*.json"
                ) if exists(spark, p)
            ),
            None,
        )
        if found is None:
            raise FileNotFoundError(f"{folder}: no files of split {split}")
        parts = [load(found)]
    else:
        raise ValueError("files or a folder must be given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
