"""Toxicity by cumulative-link ordinal regression.

A text's features are sparse and binary: its distinct words and the four- and five-letter
beginnings of its longer words.  One weight vector serves all ordered thresholds:
P(grade <= k) = sigmoid(theta_k - eta), eta = the sum of the weights of the features there.
The output is the expected grade, 0 (clean) to 3 (severe).

Grades.  Labels say toxic or not.  The labelled toxic rows are graded 1 to 3 by terciles of
the evidence in their text for its length: the log odds of the indicative features there, as
the other half of the labelled rows has them, over the logarithm of the number of words.
So no row's own label decides its grade.

The model is fitted on a bounded sample: ``SAMPLE_ROWS`` labelled rows of each class, in
hash order.  Features are counted and screened where the texts lie; only what the
``FEATURES`` strongest are in which row comes to the driver, and an L1 penalty leaves a few
hundred weights.  ``MIN_ROWS`` and ``L1`` were chosen by :func:`cross_validate` among the rows
that may be learned from; rows kept for evaluation had no part in it.  Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices, text_function

SAMPLE_ROWS = 3000
FEATURES = 4096
GRADES = 3
MIN_ROWS = 4
L1 = 3e-5
ROUNDS = 1500
CACHE = 100_000


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word, as signed 32-bit numbers."""
    from zlib import crc32

    names = [b"w" + word.encode()]
    names += [b"p" + word[:n].encode() for n in (4, 5) if len(word) > n]
    return [crc32(n) - (1 << 31) for n in names]


def bare(token: str) -> str:
    """A token without what is no letter or digit at its ends."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def features(text) -> set[int]:
    """The distinct features of a whole text; null: none."""
    words = {bare(t) for t in set((text or "").lower().split())} - {""}
    return {f for w in words for f in word_features(w)}


@dataclass(frozen=True)
class Model:
    weights: dict
    thresholds: tuple

    def scorer(self):
        """A function from text to (expected grade, grade, P(grade > 0))."""
        import math

        of_token: dict = {}
        weights, cuts = self.weights, self.thresholds

        def hits(token):
            w = bare(token)
            return tuple(f for f in word_features(w) if f in weights) if w else ()

        def sigmoid(x):
            return 1 / (1 + math.exp(-x)) if x > -500 else 0.0

        def score(text):
            if len(of_token) > CACHE:
                of_token.clear()
            there = set()
            for t in set((text or "").lower().split()):
                got = of_token.get(t)
                if got is None:
                    got = of_token[t] = hits(t)
                there.update(got)
            eta = sum(weights[f] for f in sorted(there))
            over = [sigmoid(eta - c) for c in cuts]
            return sum(over), sum(p >= 0.5 for p in over), over[0]

        return score


def learn(ids: list, rows: list, words: list, toxic: list, weight: list, names, odds_of, l1: float = L1) -> Model:
    """Fit on arrays of feature places (into ``names``), numbers of words, labels (0/1) and row weights.

    ``odds_of`` gives the log odds of all features by a mask of rows.
    """
    from zlib import crc32

    import numpy as np

    n, width = len(rows), len(names)
    toxic, weight, words = np.asarray(toxic, dtype=bool), np.asarray(weight, dtype=float), np.maximum(
        np.asarray(words, dtype=float), 1
    )
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    col = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if sizes.sum() else np.zeros(0, dtype=np.int32)
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)
    per_row = lambda v: np.bincount(at, weights=v[col], minlength=n) if len(col) else np.zeros(n)
    # grades of the toxic rows: terciles of the evidence for the length, as the rows' other half has it
    half, evidence = np.array([crc32(str(i).encode()) >> 8 & 1 for i in ids], dtype=bool), np.zeros(n)
    for side in (False, True):
        others = half != side
        known = others if (toxic & others).any() and (~toxic & others).any() else np.ones(n, dtype=bool)
        found = per_row(np.maximum(odds_of(at, col, toxic, known), 0)) / np.log2(words + 1)
        evidence = np.where(half == side, found, evidence)
    cuts = np.quantile(evidence[toxic], [1 / 3, 2 / 3]) if toxic.any() else (0, 0)
    grade = np.where(toxic, 1 + (evidence > cuts[0]) + (evidence > cuts[1]), 0)
    top = int(grade.max()) if n else 0
    grades = np.arange(max(1, top))
    share = np.array([np.average(grade > k, weights=weight) if n else 0.5 for k in grades]).clip(1e-3, 1 - 1e-3)
    theta, w = -np.log(share / (1 - share)), np.zeros(width)
    theta = np.maximum.accumulate(theta + 1e-3 * grades)
    state = [np.zeros(width + len(theta)), np.zeros(width + len(theta))]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    weight = weight / max(weight.sum(), 1e-9)
    for t in range(1, ROUNDS + 1):
        eta = per_row(w)
        full = np.concatenate([[-np.inf], theta, [np.inf]])
        up, low = sig(full[np.minimum(grade + 1, len(full) - 1)] - eta), sig(full[grade] - eta)
        up[grade == len(theta)], low[grade == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-9)
        g_eta = weight * (up + low - 1)  # gradient of the log-likelihood
        g_w = np.bincount(col, weights=g_eta[at], minlength=width) if len(col) else np.zeros(width)
        g_t = np.array(
            [
                (weight * ((grade == k) * up * (1 - up) - (grade == k + 1) * low * (1 - low)) / p).sum()
                for k in range(len(theta))
            ]
        )
        g = np.concatenate([g_w, g_t])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        rate = 0.1 / np.sqrt(1 + t / 100)
        root = np.sqrt(state[1] / (1 - 0.99**t)) + 1e-6
        step = rate * state[0] / (1 - 0.9**t) / root
        w, theta = w + step[:width], theta + step[width:]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / root[:width], 0)
        theta = np.maximum.accumulate(theta)
    big = np.flatnonzero(np.abs(w) > 1e-3)
    return Model({int(names[k]): float(w[k]) for k in big}, tuple(map(float, theta)))


def agreed_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(l_id, y)``, stored: ids that are there, have one label only, and may be learned from.

    Ids whose crc32 (as text) mod 5 is 0 are kept for evaluation.
    """
    ident = F.col(id_col).cast("long").alias("l_id")
    agreed = labels.where(F.col(label_col).isNotNull()).groupBy(ident).agg(
        F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2")
    ).where("y = y2")
    agreed = agreed.where(
        F.crc32(F.col("l_id").cast("string").cast("binary")) % 5 != 0
    ).join(docs.select(ident), "l_id", "left_semi")
    return materialize(agreed.select("l_id", "y"), "labels")


def training_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, y, n, f)``, stored: label, number of tokens and features of the ``chosen`` (l_id, y) rows."""
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).join(F.broadcast(chosen), F.col("id") == F.col("l_id")).select("id", "text", "y")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 100):
            texts = batch.column("text").to_pylist()
            f = [sorted(features(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("y"),
                    pa.array([len((t or "").split()) for t in texts], pa.int64()),
                    pa.array(f, type=pa.list_(pa.int32())),
                ],
                names=["id", "y", "n", "f"],
            )

    return materialize(src.mapInArrow(run, "id long, y int, n long, f array<int>"), "features")


def screen(rows: DataFrame, min_rows: int = MIN_ROWS, most: int = FEATURES) -> list[int]:
    """The features whose presence tells most, strongest first; counted on the executors."""
    nt, nc = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    counts = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(
        F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")
    ).where(F.col("t") + F.col("c") >= min_rows)
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    strength = F.abs(odds) * F.sqrt(F.col("t") + F.col("c"))
    return [
        r.f
        for r in counts.select("f", strength.alias("s")).where("s > 0").orderBy(F.desc("s"), "f").limit(most).collect()
    ]


def fit_rows(rows: DataFrame, totals: dict, min_rows: int = MIN_ROWS, l1: float = L1) -> Model:
    """A model from :func:`training_rows`; ``totals``: how many labelled rows of each class stand behind the sample."""
    import numpy as np

    kept = sorted(screen(rows, min_rows))

    def run(batches):
        import pyarrow as pa

        place = {f: k for k, f in enumerate(kept)}
        for b in slices(batches):
            found = [[place[f] for f in row if f in place] for row in b.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(found, type=pa.list_(pa.int32()))], names=["id", "y", "n", "f"]
            )

    got = rows.select("id", "y", "n", "f").mapInArrow(run, "id long, y int, n long, f array<int>").toArrow().sort_by(
        [("id", "ascending"), ("y", "ascending"), ("n", "ascending")]
    )
    y = got.column("y").to_pylist()
    if not (0 in y and 1 in y):
        return Model({}, (50.0, 51.0, 52.0))

    def odds_of(at, col, toxic, known):
        in_toxic = np.bincount(col, weights=(toxic & known)[at].astype(float), minlength=len(kept))
        in_clean = np.bincount(col, weights=(~toxic & known)[at].astype(float), minlength=len(kept))
        return np.log((in_toxic + 0.5) / ((toxic & known).sum() + 1)) - np.log(
            (in_clean + 0.5) / ((~toxic & known).sum() + 1)
        )

    share = {k: totals[k] / y.count(k) for k in (0, 1)}
    return learn(
        got.column("id").to_pylist(), [np.asarray(x) for x in got.column("f").to_pylist()], got.column("n").to_pylist(),
        y, [share[k] for k in y], kept, odds_of, l1,
    )


def sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int
) -> tuple[DataFrame, dict]:
    agreed = agreed_labels(docs, labels, id_col, label_col)
    totals = {r.y: r["count"] for r in agreed.groupBy("y").count().collect()}
    parts = [agreed.where(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows) for y in (0, 1)]
    return training_rows(docs, parts[0].union(parts[1]), id_col, text_col), totals


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from labelled rows whose crc32(id as text) mod 5 is not 0 (those are for evaluation).

    Ids with contradicting labels are left out.  Without labelled rows of both kinds the
    model has no weights and finds nothing toxic.
    """
    rows, totals = sample(docs, labels, id_col, text_col, label_col, sample_rows)
    model = fit_rows(rows, totals)
    discard(rows)
    return model


def cross_validate(
    docs: DataFrame, labels: DataFrame, choices, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = 3,
) -> dict:
    """(min_rows, l1) -> mean of the two classes' error shares, by folds of the rows that may be learned from."""
    rows, totals = sample(docs, labels, id_col, text_col, label_col, SAMPLE_ROWS)
    part = F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")).cast("binary")) % folds
    out = {}
    for min_rows, l1 in choices:
        wrong, n = [0, 0], [0, 0]
        for k in range(folds):
            model = fit_rows(rows.where(part != k), totals, min_rows, l1)
            for r in rows.where(part == k).select("y", "f").collect():
                eta = sum(model.weights.get(f, 0.0) for f in r.f)
                n[r.y] += 1
                wrong[r.y] += (eta > model.thresholds[0]) != (r.y == 1)
        out[min_rows, l1] = (wrong[0] / max(n[0], 1) + wrong[1] / max(n[1], 1)) / 2
    return out


def verdict(model: Model):
    """Column function from a text to (severity, grade, p_toxic, toxic); null and empty texts have no features."""

    def make():
        of = model.scorer()

        def all_of(texts):
            got = map(of, texts)
            return [{"severity": s, "grade": g, "p_toxic": p, "toxic": p >= 0.5} for s, g, p in got]

        return all_of

    return text_function(make, "severity double, grade int, p_toxic double, toxic boolean")


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, severity, grade, p_toxic, toxic)`` for every row; see :func:`verdict`."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), verdict(model)(F.col(text_col).cast("string")).alias("v")
    ).select("id", "v.severity", "v.grade", "v.p_toxic", "v.toxic")
