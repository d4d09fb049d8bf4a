"""Running state through ordered chapters, resumable from what is stored.

What ``step`` makes of chapter k goes into chapter k + 1: sequential within a key by
definition, parallel over keys.  A run that was stopped goes on from the stored chapters, in
batches (:func:`fold`) or as a stream whose keyed state starts from them (:func:`fold_stream`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def last_states(stored: DataFrame, key: str, order: str, state: str = "state") -> DataFrame:
    """``(key, order, state)`` a key: the last chapter's state, the one before where a chapter left none.

    ``order`` is that of the last stored chapter, state or not.
    """
    there = F.col(state).isNotNull()
    return stored.groupBy(key).agg(
        F.max(order).alias(order), F.max_by(F.col(state), F.when(there, F.col(order))).alias(state)
    )


def fold(
    df: DataFrame, key: str, order: str, text: str, step: Callable[[str, str], str], stored: DataFrame | None = None,
    start: str = "",
) -> DataFrame:
    """``(key, order, state)`` of the chapters that are not stored yet.

    Without ``stored`` each key starts from ``start``.  With it, (key, order, state) of chapters done
    before, those chapters are left out and a key starts from its last stored state; a chapter that
    is missing among the stored ones is made up for from there too.

    Rows come sorted by (key, order), so a task holds one state and one slice of rows, however many
    chapters a key has.  The stored states meet the chapters in the same sort, ahead of the key's
    first, so resuming costs no more than the shuffle of one row a key.
    """
    kind, okind = df.schema[key].dataType.simpleString(), df.schema[order].dataType.simpleString()
    rows = df.select(
        F.col(key).alias("k"), F.lit(1).alias("new"), F.col(order).alias("o"), F.col(text).cast("string").alias("t")
    )
    if stored is not None:
        done = stored.select(F.col(key).alias("k"), F.col(order).alias("o")).distinct()
        begun = last_states(stored, key, order).select(
            F.col(key).cast(kind).alias("k"), F.lit(0).alias("new"), F.lit(None).cast(okind).alias("o"),
            F.col("state").alias("t"),
        )
        rows = rows.join(done, ["k", "o"], "left_anti").select("k", "new", "o", "t").unionByName(begun)
    rows = rows.repartition("k").sortWithinPartitions("k", "new", "o")

    def run(batches):
        import pyarrow as pa

        at, state = object(), start
        for b in batches:
            for lo in range(0, b.num_rows, 400):
                part, out = b.slice(lo, 400), []
                for k, new, t in zip(*(part.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                    if k != at:
                        at, state = k, start
                    state = step(state, t or "") if new else start if t is None else t
                    out.append(state)
                chosen = pa.array([bool(n) for n in part.column(1).to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(out, pa.string())], names=["k", "o", "state"]
                ).filter(chosen)

    return rows.mapInArrow(run, f"k {kind}, o {okind}, state string").toDF(key, order, "state")


class Running(StatefulProcessor):
    """Keyed state of the fold: the state and the last chapter that went into it."""

    def __init__(self, key: str, order: str, text: str, step: Callable[[str, str], str], start: str):
        self.key, self.order, self.text, self.step, self.start = key, order, text, step, start

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "last long, state string")

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        last, state = self.now.get() if self.now.exists() else (None, self.start)
        fresh = sorted(
            (int(r[self.order]), r[self.text] or "") for r in rows if last is None or int(r[self.order]) > last
        )
        for place, text in fresh:
            state, last = self.step(state, text), place
            yield Row(**{self.key: key[0], self.order: place, "state": state})
        if fresh:
            self.now.update((last, state))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.now.update((int(initialState[self.order]), self.start if initialState["state"] is None else initialState["state"]))

    def close(self) -> None:
        pass


def fold_stream(
    chapters: DataFrame, key: str, order: str, text: str, step: Callable[[str, str], str],
    stored: DataFrame | None = None, start: str = "",
) -> DataFrame:
    """The fold over a stream: a key's state lives in the state store between batches.

    It starts from the stored chapters' last states where there are any.  Chapters of a key must
    arrive in order across batches; within a batch they are sorted, and one that has gone into the
    state already, as a file that arrives twice brings it, is passed over.  The session's state store
    must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), as Spark asks of keyed state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chapters.schema}
    begun = None
    if stored is not None:
        begun = last_states(stored, key, order).select(
            F.col(key).cast(kinds[key]).alias(key), F.col(order).cast("long").alias(order), "state"
        ).groupBy(key)
    return chapters.groupBy(key).transformWithState(
        Running(key, order, text, step, start), f"{key} {kinds[key]}, {order} long, state string", "append", "none", begun
    )
