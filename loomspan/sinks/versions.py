"""Published tables that readers never find missing: versions, and a pointer that is created at once.

A version is a folder of its own.  What makes it the current one is an empty file whose name
holds its number and the folder's name; creating an empty file is one step on any store, and
nothing is renamed, replaced or copied.  Readers take the greatest number, so they see the old
version or the new one, whole, whenever they look; a reader that holds on to a version keeps it
until :func:`vacuum` takes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import PublishError, _fs

POINTERS = "_versions"


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """Names of the pointers, oldest first."""
    fs, p = _fs(spark, f"{path}/{POINTERS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version; None where nothing has been published."""
    found = _pointers(spark, path)
    return f"{path}/{found[-1].split('.', 1)[1]}" if found else None


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version; the frame stays with it whatever is published later."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path}: nothing has been published")
    return (spark.read.schema(schema) if schema else spark.read).parquet(folder)


def point(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the current one.  Of two writers that do so at once, the later by name is."""
    found = _pointers(spark, path)
    number = int(found[-1].split(".", 1)[0]) + 1 if found else 1
    fs, p = _fs(spark, f"{path}/{POINTERS}/{number:012d}.{version}")
    fs.mkdirs(p.getParent())
    if not fs.createNewFile(p):
        raise PublishError(f"{p} is there already")


def publish(df: DataFrame, path: str, failed: str = "false", allow_empty: bool = True) -> DataFrame:
    """Store ``df`` as a new version and make it the current one, unless a row fulfils ``failed``.

    The rows are computed once; the gate reads the stored ones.  If it says no, the current version
    stays, :class:`PublishError` names the folder of the new one, which is kept for a look.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    stored = spark.read.schema(df.schema).parquet(f"{path}/{version}")
    n, bad = stored.agg(F.count("*"), F.count_if(F.expr(failed))).first()
    if bad or not (n or allow_empty):
        raise PublishError(f"{bad} of {n} rows failed; {path} is unchanged, see {path}/{version}")
    point(spark, path, version)
    return stored


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` published versions; the pointers go first.  Their names."""
    found = _pointers(spark, path)
    old = found[: max(0, len(found) - max(1, keep))]
    for name in old:
        for part in (f"{POINTERS}/{name}", name.split(".", 1)[1]):
            fs, p = _fs(spark, f"{path}/{part}")
            fs.delete(p, True)
    return [name.split(".", 1)[1] for name in old]


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What has been published at ``path``; where nothing has, or by ``force``, what ``make`` gives is.

    An attempt that failed has published nothing, so it is made again.
    """
    if not force and current(spark, path) is not None:
        return read(spark, path)
    return publish(make(), path)
