"""Last write wins, increment by increment: new files only, never the whole history again.

A run takes the files that have arrived since the last one and writes the winners among them, with
the order they won by beside their columns.  No state is held between increments, so an increment
costs what it reads, however many keys there are.  Reading takes each key's last row of all that was
written; :func:`compact` writes it together, so that reading stays in proportion to the keys.  A run
that is repeated after a failure writes its rows again, under the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.publish import _fs


#: Metadata of a stored column: its place in the order that decides.
ORDER = "loomspan.order"


def winners(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key by ``order``, which should be total; nulls come first."""
    rest: list[Column] = [F.col(c) for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def _marked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The order goes with the columns, into the files."""
    return rows.select(
        *[F.col(c).alias(c, metadata={ORDER: order.index(c)}) if c in order else F.col(c) for c in rows.columns]
    )


def take_in(
    spark: SparkSession, source: str, schema: str, keys: list[str], order: list[str], path: str,
    files_at_once: int | None = None,
) -> int:
    """Take the Parquet files that are new at ``source`` into the table at ``path``; the number of rows read.

    ``files_at_once`` bounds what one increment reads.  The table's progress is kept beside it.  All
    runs of a table should give the same ``order``.
    """
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)

    def write(arrived: DataFrame, number: int) -> None:
        _marked(winners(arrived, keys, order), order).write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{path}/progress"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _changes(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """All rows written at ``path`` with their ``batch``, and the order they are in."""
    changes = spark.read.option("basePath", f"{path}/changes").parquet(f"{path}/changes/batch=*")
    marked = [f for f in changes.schema if ORDER in f.metadata]
    return changes, [f.name for f in sorted(marked, key=lambda f: f.metadata[ORDER])]


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Each key's winner by the order of :func:`take_in`; of equal ones, that of the later increment."""
    changes, order = _changes(spark, path)
    return winners(changes, keys, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Write all changes together under the number of the last one, then delete the earlier ones.

    A reader between the steps sees the same winners; a run that died in between is made good by the next.
    """
    fs, p = _fs(spark, f"{path}/changes")
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName())
    if len(numbers) < 2:
        return
    part = f"{path}/compacted-{numbers[-1]}"
    _marked(latest(spark, path, keys), _changes(spark, path)[1]).write.mode("overwrite").parquet(part)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = jvm.Path(f"{path}/changes/batch={numbers[-1]}")
    for status in fs.listStatus(jvm.Path(part)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), jvm.Path(target, f"all-{status.getPath().getName()}"))
    for n in numbers[:-1]:  # every winner stands in the new files by now
        fs.delete(jvm.Path(f"{path}/changes/batch={n}"), True)
    fs.delete(jvm.Path(part), True)
