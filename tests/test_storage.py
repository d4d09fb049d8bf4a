"""Versions, entity files, increments, numbered lines in blocks, table functions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import increments, splitting, table_functions
from loomspan.sinks import entity_files
from loomspan.sinks import versions as V
from loomspan.sinks.publish import PublishError
from loomspan.sources import jsonl


def numbers(spark, *n):
    return spark.createDataFrame([(x,) for x in n], "n int")


def ints(df):
    return sorted(r.n for r in df.collect())


# --- versions


def test_readers_see_the_old_or_the_new_version(spark, tmp_path, monkeypatch):
    """A reader between any two steps of a publication finds a whole table."""
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        V.read(spark, path)
    V.publish(numbers(spark, 1, 2), path)
    seen, point = [], V.point

    def watched(spark, path, version):
        seen.append(ints(V.read(spark, path)))  # all files are there, the pointer is not
        point(spark, path, version)
        seen.append(ints(V.read(spark, path)))

    monkeypatch.setattr(V, "point", watched)
    held = V.read(spark, path)
    V.publish(numbers(spark, 3), path)
    assert seen == [[1, 2], [3]] and ints(held) == [1, 2]


def test_a_failed_version_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    V.publish(numbers(spark, 1), path)
    with pytest.raises(PublishError, match="1 of 2 rows failed"):
        V.publish(numbers(spark, 2, 3), path, failed="n = 3")
    with pytest.raises(PublishError):
        V.publish(numbers(spark), path, allow_empty=False)
    assert ints(V.read(spark, path)) == [1]


def test_writers_at_once_and_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for k in range(4):
        V.publish(numbers(spark, k), path)
    # two pointers of one number: the later name counts, for every reader
    for name in ("v-a", "v-b"):
        numbers(spark, 10 if name == "v-a" else 11).write.parquet(f"{path}/{name}")
        open(f"{tmp_path}/t/_versions/000000000005.{name}", "w").close()
    assert ints(V.read(spark, path)) == [11]
    assert len(V.vacuum(spark, path, keep=2)) == 4 and ints(V.read(spark, path)) == [11]
    assert sorted(x for x in os.listdir(f"{tmp_path}/t") if x.startswith("v-")) == ["v-a", "v-b"]


def test_cached_builds_once(spark, tmp_path):
    path, made = f"file://{tmp_path}/c", []

    def make(n):
        def build():
            made.append(n)
            if n < 0:
                raise RuntimeError("no")
            return numbers(spark, n)

        return build

    with pytest.raises(RuntimeError):
        V.cached(spark, path, make(-1))
    assert [ints(V.cached(spark, path, make(n))) for n in (1, 2)] == [[1], [1]]
    assert ints(V.cached(spark, path, make(3), force=True)) == [3] and made == [-1, 1, 3]


# --- entity files


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string").repartition(3)


def test_entity_files_are_published_together(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    entity_files.register(spark)
    rows = [(f"f{i}.txt", f"text {i} é") for i in range(40)] + [("none.txt", None)]
    files(spark, *rows).write.format("entity_files").mode("append").save(path)
    first = V.current(spark, path).removeprefix("file://")
    assert {n: open(f"{first}/{n}", encoding="utf-8").read() for n in os.listdir(first) if not n.startswith(".")} == {
        n: t or "" for n, t in rows
    }
    # a name that is none aborts the write: the current version and its folder stay alone
    with pytest.raises(Exception, match="is no file name"):
        files(spark, ("ok.txt", "x"), ("../up.txt", "y")).write.format("entity_files").mode("append").save(path)
    assert V.current(spark, path) == f"file://{first}"
    assert [x for x in os.listdir(f"{tmp_path}/e") if x.startswith("v-")] == [os.path.basename(first)]
    files(spark).write.format("entity_files").mode("append").save(path)
    assert [n for n in os.listdir(V.current(spark, path).removeprefix("file://")) if not n.startswith(".")] == []


def test_entity_files_need_their_columns(spark, tmp_path):
    entity_files.register(spark)
    with pytest.raises(Exception, match="file and text"):
        numbers(spark, 1).write.format("entity_files").mode("append").save(f"file://{tmp_path}/e")


# --- increments

ROW = "k int, ts int, v string"


def test_increments_equal_the_batch_and_read_new_files_only(spark, tmp_path):
    rnd = random.Random(4)
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    rows, read = [], []
    for step in range(10):
        more = [(rnd.randrange(40), rnd.randrange(100) if rnd.random() < 0.9 else None, f"v{step}_{i}") for i in range(25)]
        rows += more
        spark.createDataFrame(more, ROW).coalesce(1).write.mode("append").parquet(source)
        read.append(increments.take_in(spark, source, ROW, ["k"], ["ts", "v"], path))
        if step == 6:
            increments.compact(spark, path, ["k"])
    assert read == [25] * 10
    want = {}
    for k, ts, v in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        want[k] = (ts, v)
    got = increments.latest(spark, path, ["k"]).collect()
    assert {r.k: (r.ts, r.v) for r in got} == want and len(got) == len(want)
    increments.compact(spark, path, ["k"])
    assert {r.k: (r.ts, r.v) for r in increments.latest(spark, path, ["k"]).collect()} == want
    assert [x for x in os.listdir(f"{tmp_path}/t/changes") if x.startswith("batch=")] == ["batch=9"]
    assert increments.take_in(spark, source, ROW, ["k"], ["ts", "v"], path) == 0


def test_increments_take_one_file_at_a_time(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    rows = [(i % 7, i, str(i)) for i in range(100)]
    spark.createDataFrame(rows, ROW).repartition(4).write.parquet(source)
    assert increments.take_in(spark, source, ROW, ["k"], ["ts"], path, files_at_once=1) == 100
    assert len([x for x in os.listdir(f"{tmp_path}/t/changes") if x.startswith("batch=")]) == 4
    assert {r.k: r.ts for r in increments.latest(spark, path, ["k"]).collect()} == {k: max(i for i in range(100) if i % 7 == k) for k in range(7)}


def test_increments_hold_no_state_of_the_keys(spark, tmp_path):
    """An earlier record that arrives late loses when it is read; nothing grows beside the rows themselves."""
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/t"
    for rows in ([(1, 5, "new"), (2, 1, "a"), (3, None, "n")], [(1, 3, "late"), (2, 2, "b"), (3, 0, "z")], [(2, 2, "a")]):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        increments.take_in(spark, source, ROW, ["k"], ["ts", "v"], path)
    want = {1: (5, "new"), 2: (2, "b"), 3: (0, "z")}
    for _ in range(2):
        assert {r.k: (r.ts, r.v) for r in increments.latest(spark, path, ["k"]).collect()} == want
        increments.compact(spark, path, ["k"])
    assert not os.path.exists(f"{tmp_path}/t/progress/state")


# --- numbered lines


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    """Two files, each cut into many blocks; blank lines count but are left out."""
    rnd = random.Random(2)
    want = []
    for name, end in (("a.jsonl", "\n"), ("b c.jsonl", "\r\n")):
        lines = [rnd.choice(["", "  ", "é" * rnd.randrange(30), f"line {i} " + "x" * rnd.randrange(60)]) for i in range(300)]
        (tmp_path / name).write_bytes((end.join(lines) + (end if name == "a.jsonl" else "")).encode())
        want += [(name, i, x) for i, x in enumerate(lines, 1) if x.strip()]
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", 500)
    own.conf.set("spark.sql.files.openCostInBytes", 0)
    got = jsonl.lines(own, f"file://{tmp_path}")
    assert jsonl.placed_lines(own, f"file://{tmp_path}").select("path", "place.block").distinct().count() > 16
    assert sorted((os.path.basename(r.path), r.line_no, r.line) for r in got.collect()) == sorted(want)
    assert jsonl.lines(spark, f"file://{tmp_path}/none").count() == 0


def test_tolerant_lines_have_their_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'\n{"a": 1}\nnull\n  \n{"a": 2}\n{"a": \n\xff{"a": 3}\n{"a": 4}')
    got = jsonl.tolerant(spark, f"file://{tmp_path}", "a int")
    assert sorted((r.line_no, r.rec.a) for r in got.collect()) == [(2, 1), (5, 2), (8, 4)]


# --- table functions


def test_table_functions_equal_the_data_frame_forms(spark):
    table_functions.register(spark)
    rnd = random.Random(3)
    body = lambda: "\n\n".join("word " * rnd.randrange(1, 120) for _ in range(rnd.randrange(1, 8)))
    books = [(i, "".join(f"Chapter {k}\n\n{body()}\n\n" for k in range(1, 6))) for i in range(8)] + [(90, None), (91, ""), (92, body())]
    df = spark.createDataFrame(books, "novel int, text string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.sql("SELECT novel, c.* FROM {b}, LATERAL book_chapters(text, 300, 900) AS c", b=df)) == rows(
        splitting.split_chapters(df, least=300, most=900)
    )
    assert rows(spark.sql("SELECT novel, c.* FROM {b}, LATERAL text_pieces(text, 400) AS c", b=df)) == rows(
        splitting.sub_chunks(df, "novel", "text", 400)
    )
    from loomspan.functions.text import chunk_windows

    plain = df.select("novel", F.explode(chunk_windows(F.col("text"), 700, 500)).alias("w")).select("novel", "w.chunk_idx", "w.start", "w.chunk")
    assert rows(spark.sql("SELECT novel, c.* FROM {b}, LATERAL text_windows(text, 700, 500) AS c", b=df)) == rows(plain)


def test_pieces_leave_a_few_texts_at_a_time(spark, tmp_path):
    """Python holds the pieces of some texts, not of a whole batch; batches are bounded by bytes."""
    import pyarrow as pa

    from loomspan.plans import base

    got = {}

    class Source:
        schema = spark.createDataFrame([], "k long, t string").schema

        def mapInArrow(self, run, kinds):
            n = 1000
            whole = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(["ab\n\ncd"] * n)], names=["k", "t"])
            got["rows"] = [b.num_rows for b in run(iter([whole]))]

    splitting._split(Source(), lambda t: splitting.paragraphs(t, 4), 0, "idx")
    assert sum(got["rows"]) == 2000 and max(got["rows"]) <= 2 * splitting.SLICE
    spark.range(1).write.parquet(f"{tmp_path}/t.parquet")
    base.table(spark, str(tmp_path), "t")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{4 << 20}b"
