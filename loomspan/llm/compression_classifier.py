"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on good and one on bad labelled text.  A text
is cut into short blocks (all of it), so that the dictionary and not the text itself is what
matches are found in; every block is compressed once with each dictionary, and
the normalised difference of the summed sizes, (bad - good) / (bad + good), tells which
kind the text is closer to.  A logistic curve fitted on other labelled rows turns it into
a probability.

The model is fitted on bounded samples: ``CLASS_ROWS`` labelled rows for each class and
fold, of them ``DICT_BLOCKS`` blocks of ``BLOCK`` bytes a dictionary.  Blocks are cut by bytes of
UTF-8 in learning and in scoring.  ``BLOCK`` was chosen by :func:`cross_validate` among the rows
that may be learned from.  Scoring is one pass over the texts without a shuffle; the model
is a few hundred kilobytes in the task's closure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_function

BLOCK = 128
LEVEL = 3
DICT_BYTES = 112_640
DICT_BLOCKS = 6000
CLASS_ROWS = 1500
#: Rows whose crc32(id as text) mod 3 is this never take part in learning.
HELD_OUT = 1


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float
    block: int = BLOCK

    def difference(self):
        """A function from text to its normalised compressed-size difference; empty text: 0."""
        import zstandard

        coders = []
        for d in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=LEVEL)
            coders.append(
                zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False).compress
            )
        good, bad = coders

        def of(text) -> float:
            data = memoryview((text or "").encode("utf-8"))
            g = b = 0
            for at in range(0, len(data), self.block):
                block = data[at : at + self.block]
                g += len(good(block))
                b += len(bad(block))
            return (b - g) / (b + g) if g + b else 0.0

        return of

    def probability(self, difference: float) -> float:
        import math

        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * difference + self.shift))))


def logistic(x, y, weight, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve in one variable, by Newton's method."""
    import numpy as np

    scale = float(np.std(x)) or 1.0
    z, a = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve(
            (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (weight * (y - p)) - ridge * a
        )
        a = a + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0] / scale), float(a[1])


def chosen_ids(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(l_id, y, f): a bounded hash sample of what may be learned from, per class and fold.

    Rows with one agreed label that are there and not held out.  Only ids are looked at, so no
    text moves; ``CLASS_ROWS`` rows for each of two classes and two folds at most.
    """
    agreed = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id")).agg(
        F.min(label_col).alias("y"), F.max(label_col).alias("y2")
    ).where("y = y2")
    there = agreed.where(fold("l_id") != HELD_OUT).join(docs.select(F.col(id_col).cast("long").alias("l_id")), "l_id", "left_semi").select(
        "l_id", F.col("y").cast("int").alias("y"), fold("l_id").cast("int").alias("f")
    )
    picked = None
    for y in (0, 1):
        for f in (0, 2):
            part = there.where(
                (F.col("y") == y) & (F.col("f") == f)
            ).orderBy(F.xxhash64("l_id"), "l_id").limit(CLASS_ROWS)
            picked = part if picked is None else picked.union(part)
    return materialize(picked, "chosen")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y, f) of the rows to learn from: a bounded sample."""
    ids = F.broadcast(chosen_ids(docs, labels, id_col, label_col))  # 4 * CLASS_ROWS rows at most
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return src.join(ids, F.col("id") == F.col("l_id")).select("id", "text", "y", "f")


def differences(rows: DataFrame, model: Model):
    """(difference, y) of labelled rows, measured where they lie; two numbers a row come back."""

    def run(batches):
        import pyarrow as pa

        of = model.difference()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([of(t) for t in b.column("text").to_pylist()], type=pa.float64()), b.column("y")],
                names=["d", "y"],
            )

    got = rows.select("text", "y").mapInArrow(run, "d double, y int").toPandas().sort_values(["d", "y"])
    return got["d"].to_numpy(), got["y"].to_numpy().astype(float)


def blocks_of(rows: DataFrame, block: int) -> DataFrame:
    """``(id, y, k, block)``: the UTF-8 bytes of the texts in pieces of ``block`` bytes; empty texts have none."""
    data = F.encode("text", "UTF-8")
    cut = F.expr(
        f"transform(sequence(0, greatest(octet_length(data) - 1, 0) div {block}), i -> substring(data, i * {block} + 1, {block}))"
    )
    return rows.select("id", "y", data.alias("data")).where(F.octet_length("data") > 0).select(
        "id", "y", F.posexplode(cut).alias("k", "block")
    )


def learn(words: DataFrame, curve: DataFrame, block: int = BLOCK) -> Model:
    """Dictionaries from the rows ``words``, the curve from the rows ``curve``; both (id, text, y), stored."""
    import numpy as np
    import zstandard

    found, pieces = [], blocks_of(words, block)
    order = (F.xxhash64("id", "k"), "id", "k")
    for y in (0, 1):
        # places are chosen first, among narrow rows; then only the chosen blocks move
        mine = pieces.where(F.col("y") == y)
        chosen = F.broadcast(mine.select("id", "k").orderBy(*order).limit(DICT_BLOCKS))
        rows = mine.join(chosen, ["id", "k"], "left_semi").orderBy(*order, "block").limit(DICT_BLOCKS)
        data = [bytes(r.block) for r in rows.select("block").collect()]
        try:
            found.append(
                zstandard.train_dictionary(
                    min(DICT_BYTES, max(512, sum(map(len, data)) // 8)), data, level=LEVEL
                ).as_bytes()
            )
        except zstandard.ZstdError:  # too little text for statistics: the text itself serves
            found.append(b"\n".join(data)[-DICT_BYTES:])
    bad, good = found
    x, y = differences(curve, Model(good, bad, 1.0, 0.0, block))
    # both classes weigh the same, so 0.5 lies midway whatever the label shares are
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    slope, shift = logistic(x, y, weight)
    return Model(good, bad, slope, shift, block)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model | None:
    """A model, or None where one class has no text to learn from.

    Of the rows that may be learned from, remainder 0 feeds the dictionaries and
    remainder 2 the calibration (where one lacks a class, both feed both).
    """
    rows = materialize(labelled(docs, labels, id_col, text_col, label_col), "labelled")
    have = {(r.y, r.f) for r in rows.where(F.length("text") > 0).select("y", "f").distinct().collect()}
    if not {y for y, _ in have} >= {0, 1}:
        return None
    part = lambda f: rows.where(F.col("f") == f) if {(y, g) for y in (0, 1) for g in (0, 2)} <= have else rows
    return learn(part(0), part(2))


def cross_validate(
    docs: DataFrame, labels: DataFrame, sizes, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> dict:
    """Block size -> mean log loss, classes weighing the same, over the rows that may be learned from.

    They are dealt into three folds anew; dictionaries, curve and measure take one each, in turn.
    """
    import numpy as np

    rows = materialize(labelled(docs, labels, id_col, text_col, label_col), "labelled")
    fold_of = F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")) % 3
    out = {}
    for block in sizes:
        loss = []
        for k in range(3):
            model = learn(rows.where(fold_of == k), rows.where(fold_of == (k + 1) % 3), block)
            x, y = differences(rows.where(fold_of == (k + 2) % 3), model)
            p = np.clip([model.probability(d) for d in x], 1e-6, 1 - 1e-6)
            loss.append(-(np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean()) / 2)
        out[block] = float(np.mean(loss))
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, difference, score, predicted)`` for every row of ``docs``.

    Null and empty texts have a difference of 0.  Without a model every score is 0.5.  A
    null id counts as not held out.
    """

    def make():
        of = model.difference() if model else None

        def one(text):
            d = of(text) if of else 0.0
            p = model.probability(d) if model else 0.5
            return {"difference": d, "score": p, "predicted": int(p >= 0.5)}

        return lambda texts: list(map(one, texts))

    value = text_function(make, "difference double, score double, predicted int")(F.col(text_col).cast("string"))
    out = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col) == HELD_OUT, F.lit(False)).alias("held_out"),
        value.alias("v"),
    )
    return out.select("id", "held_out", "v.difference", "v.score", "v.predicted")
