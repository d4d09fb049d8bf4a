"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regular-expression class: space, \t \n \v \f \r.
WS_CLASS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Rows of a text column that Python holds as objects at once, of an Arrow batch.
ARROW_ROWS = 400
#: Bytes of an Arrow batch, set once a session (:func:`configure`): two tasks of an executor hold
#: a batch each in the JVM and in Python.  A longer text is a batch of its own.
ARROW_BYTES = 4 << 20
#: Tables whose rows are whole texts: the work is in the rows.
TEXTS = ("documents", "pages")
#: A caller's parameter, unset by default: text tables are dealt out to so many pieces when read.
PIECES = "spark.loomspan.pieces"
#: Groups of at least so many rows are hot: they are joined apart from the others.
HOT_ROWS = 20_000
#: Tables that are counted and no longer than this are broadcast.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``str.translate`` table that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def lower_ascii(col):
    """Lower-case A-Z only, whatever the locale; other letters stay."""
    return F.translate(col, _UPPER, _LOWER)


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for the whole session and all operators alike.

    Called where tables are read, so before any operator; operators themselves change no
    setting, and lazy results do not depend on the order they are made or run in.  A tighter
    bound that the session has already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  ``PIECES`` in the session deals out text tables that lie in too few files."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pieces = spark.conf.get(PIECES, None)
    return df.repartition(int(pieces)) if pieces and name in TEXTS else df


def slices(batches, rows: int = ARROW_ROWS):
    """Arrow batches in views of at most ``rows`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_function(make: Callable[[], Callable], kind: str):
    """A column function from a text to a value of the SQL type ``kind``.

    ``make`` is called once a task and gives a function from a list of texts (null: None) to their
    values; equal texts of a slice are computed once.  Every row gets its own value, whatever its id.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(columns):
        of = make()
        for column in columns:
            parts = [pa.array([], type=arrow)]
            for at in range(0, len(column), ARROW_ROWS):
                texts = column.slice(at, ARROW_ROWS).to_pylist()
                distinct = list(dict.fromkeys(texts))
                seen = dict(zip(distinct, of(distinct), strict=True))
                parts.append(pa.array([seen[t] for t in texts], type=arrow))
            yield pa.concat_arrays(parts)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns, nulls told from other values: with the id it tells rows apart."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where the driver's disk is the executors' too, a folder of our own is
    made if the setting is missing; elsewhere that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='loomspan-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder an application."""
    return f"{shared_dir(spark)}/loomspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later actions neither repeat the work nor depend on any
    executor's local disk.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete stored tables that nothing lazy reads any more."""
    for df in frames:
        if df is not None and df.__dict__.get("_stored_at"):
            drop_path(df.sparkSession, df.__dict__.pop("_stored_at"))


def clean(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that are still lazy cannot be read afterwards."""
    drop_path(spark, f"{shared_dir(spark)}/loomspan/{spark.sparkContext.applicationId}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file systems (any store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted rows stay within ``limit``.  ``df`` must be stored.

    Longer tables are merged: the optimizer would go by the size of their compressed files.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df.hint("merge")


def merge_if_long(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """No broadcast by the optimizer, which goes by the size of compressed files, when ``rows`` is over ``limit``."""
    return df if rows <= limit else df.hint("merge")


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with one row a group, ``groups`` (key, n = its number of rows, ...).

    Both stored; keys not null.  Groups of ``hot_rows`` or more, of which there are at most rows /
    ``hot_rows``, are joined where the rows lie if their count allows a broadcast, so that no task
    gets a whole group; the others are shuffled.
    """
    rest = groups.drop("n")
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(rest), key)
    hot = groups.where(F.col("n") >= hot_rows)
    many = hot.count()
    if not many or many > BROADCAST_ROWS:
        return rows.join(rest.hint("merge"), key)
    hot_rest = F.broadcast(hot.drop("n"))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        groups.where(F.col("n") < hot_rows).drop("n").hint("merge"), key
    )
    return rows.join(hot_rest, key).unionByName(cold)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used: inside higher-order
    functions nothing else shares it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(array: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array by doubling, in k log k steps: place i holds 0..i combined.

    ``combine(earlier, here)``; ``earlier`` is null where there is none.
    """
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(array).cast("long"))) - 1)
    shift = lambda j: F.call_function("shiftleft", F.lit(1), j)
    return F.aggregate(steps, array, lambda acc, j: F.transform(acc, lambda x, i: combine(F.get(acc, i - shift(j)), x)))
