"""Sinks: all-or-nothing publishing, appends, write-once, gzip JSON, report tables.

Whole-file commits replace partial lines: a reader sees a complete file or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PublishError(RuntimeError):
    """Some rows failed; what was published before stays as it is."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, path: str, failed: str, allow_empty: bool = True) -> DataFrame:
    """Writes to ``<path>.partial``; if a row fulfils ``failed`` the old output stays and
    :class:`PublishError` is raised, else the new one takes its place.

    The rows are computed once: the gate reads the stored ones.  The staging folder is kept on
    failure, for a look at what went wrong.
    """
    spark = df.sparkSession
    part = f"{path}.partial"
    df.write.mode("overwrite").parquet(part)
    stored = spark.read.schema(df.schema).parquet(part)
    n, bad = stored.agg(F.count("*"), F.count_if(F.expr(failed))).first()
    if bad or not (n or allow_empty):
        raise PublishError(f"{bad} of {n} rows failed; {path} is unchanged, see {part}")
    fs, p = _fs(spark, path)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), p):
        fs.rename(old, p)
        raise PublishError(f"{part} could not take the place of {path}")
    fs.delete(old, True)
    return spark.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds whole files; earlier ones are never touched."""
    df.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses to replace anything that is there."""
    df.write.mode("errorifexists").parquet(path)


def gzip_json(df: DataFrame, path: str, by: list[str]) -> None:
    """Compact gzip JSON, a folder per entity; a task writes the entities it holds."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).option("compression", "gzip").json(path)


def text_files(df: DataFrame, path: str, name: str, text: str) -> DataFrame:
    """One file a row, ``path/<name>``; the returned ``(file, bytes)`` must be run, and lists them.

    Tasks write under another name and rename, so a file is whole or not there; a task that
    runs twice writes the same file twice.  Null texts are empty files.
    """
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    fs.mkdirs(p)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs as stores

        store, root = stores.FileSystem.from_uri(path)
        for b in batches:
            sizes = []
            for file, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, part = (body or "").encode("utf-8"), f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(data)
                store.move(part, f"{root}/{file}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return df.select(
        F.col(name).cast("string").alias("file"), F.col(text).cast("string").alias("text")
    ).mapInArrow(run, "file string, bytes long")


def nested_json(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """``{outer: {inner: value}}`` as JSON text, from a small result."""
    pairs = lambda k, v: F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v"))))
    one = df.groupBy(outer).agg(pairs(inner, value).alias("e"))
    maps = F.transform(pairs(outer, "e"), lambda x: F.struct(x["k"], F.map_from_entries(x["v"])))
    return one.agg(F.to_json(F.map_from_entries(maps)).alias("json"))


def number(v, best: bool = False) -> str:
    """One decimal, two dashes for nothing, bold for a block's best."""
    s = "--" if v is None else f"{v:.1f}"
    return rf"\textbf{{{s}}}" if best and v is not None else s


def latex_table(
    rows: list, columns: list[str], labels: list[str], block: str, name: str, marked: str | None = None
) -> str:
    """A table of a small report (one row per model and mode), blocks by model, bold maxima per block.

    ``rows``: dicts, in order.  ``marked``: a name whose rows are highlighted.
    """
    top: dict = {}
    for r in rows:
        for c in columns:
            if r[c] is not None:
                top[r[block], c] = max(r[c], top.get((r[block], c), r[c]))
    sizes = {b: sum(r[block] == b for r in rows) for b in {r[block] for r in rows}}
    out = [
        r"\begin{tabular}{ll" + "r" * len(columns) + "}", r"\toprule", " & ".join([block, name, *labels]) + r" \\",
        r"\midrule",
    ]
    last = None
    for r in rows:
        first = r[block] != last
        if first and last is not None:
            out.append(r"\midrule")
        cells = [number(r[c], r[c] is not None and abs(r[c] - top[r[block], c]) < 1e-9) for c in columns]
        head = rf"\multirow{{{sizes[r[block]]}}}{{*}}{{{r[block]}}}" if first else ""
        line = " & ".join([head, str(r[name]), *cells]) + r" \\"
        out.append((r"\rowcolor{gray!15} " if marked and r[name] == marked else "") + line)
        last = r[block]
    return "\n".join([*out, r"\bottomrule", r"\end{tabular}"])


def text_table(rows: list, columns: list[str]) -> str:
    """Plain columns for a terminal."""
    cells = [
        columns,
        *[[number(r[c]) if isinstance(r[c], float) or r[c] is None else str(r[c]) for c in columns] for r in rows],
    ]
    wide = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in cells)
