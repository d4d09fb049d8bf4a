"""The running fold: in one pass, resumed, and as a stream."""

import random

import pytest

from loomspan.operators import folds

ROW = "k string, o int, t string"
JOIN = lambda state, text: f"{state}{text}"


def chapters(n_keys=5, n=40, seed=1):
    rnd = random.Random(seed)
    return [(f"key{k}", o, rnd.choice("abcdef")) for k in range(n_keys) for o in range(1, n + 1 - 5 * k)]


def one_pass(rows, start=""):
    out, now = {}, {}
    for k, o, t in sorted(rows):
        now[k] = now.get(k, start) + (t or "")
        out[k, o] = now[k]
    return out


def states(df):
    got = [((r.k, r.o), r.state) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_fold_holds_one_state(spark):
    """The state of a key goes through all its rows, in order, whatever the batches; none leaks to the next key."""
    df = spark.createDataFrame([(k % 3, k, str(k)) for k in range(3000)][::-1], "k int, o int, t string")
    got = folds.fold(df, "k", "o", "t", lambda state, text: str(int(state or 0) + int(text)))
    want, sums = {}, {}
    for k in range(3000):
        sums[k % 3] = sums.get(k % 3, 0) + k
        want[k] = sums[k % 3]
    assert {r.o: int(r.state) for r in got.collect()} == want


@pytest.mark.parametrize("stop", [0, 1, 17, 100])
def test_resumed_fold_equals_one_pass(spark, stop):
    rows = chapters()
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), ROW).repartition(4)
    first = folds.fold(df.where(f"o <= {stop}"), "k", "o", "t", JOIN, start=">")
    rest = folds.fold(df, "k", "o", "t", JOIN, stored=first, start=">")
    done, new = states(first), states(rest)
    assert not done.keys() & new.keys() and done | new == one_pass(rows, ">")
    assert all(o > stop for _, o in new)


def test_resume_goes_on_from_the_last_state_there_is(spark):
    """A chapter missing among the stored ones is made up for from the last stored state; stored nulls leave none."""
    df = spark.createDataFrame([("a", o, str(o)) for o in range(1, 7)] + [("b", 1, "1"), ("c", 1, None), (None, 2, "x")], ROW)
    stored = spark.createDataFrame(
        [("a", 1, "A"), ("a", 3, "AC"), ("a", 4, None), ("b", 9, None), ("z", 1, "Z")], "k string, o int, state string"
    )
    got = states(folds.fold(df, "k", "o", "t", JOIN, stored=stored, start="-"))
    assert got == {
        ("a", 2): "AC2", ("a", 5): "AC25", ("a", 6): "AC256", ("b", 1): "-1", ("c", 1): "-", (None, 2): "-x",
    }
    assert folds.fold(df.limit(0), "k", "o", "t", JOIN, stored=stored.limit(0)).collect() == []


def run(stream, path, name):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/{name}"
    ).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_fold_starts_from_stored_chapters(spark, tmp_path):
    rows, path, kind = chapters(4, 18), f"file://{tmp_path}", "k string, o int, t string"
    df = spark.createDataFrame(rows, ROW)
    other = spark.newSession()
    other.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folds.fold(df.where("o <= 6"), "k", "o", "t", JOIN).write.parquet(f"{path}/stored")
    stored = other.read.parquet(f"{path}/stored")
    stream = lambda: folds.fold_stream(other.readStream.schema(kind).parquet(f"{path}/in"), "k", "o", "t", JOIN, stored)
    df.where("o BETWEEN 5 AND 10").coalesce(1).write.mode("append").parquet(f"{path}/in")  # two arrive again
    run(stream(), path, "cp")
    df.where("o > 10").coalesce(1).write.mode("append").parquet(f"{path}/in")
    run(stream(), path, "cp")  # stopped, and on from its own checkpoint
    got = states(spark.read.parquet(f"{path}/out"))
    assert got == {p: s for p, s in one_pass(rows).items() if p[1] > 6}
