"""Near copies by the Jaccard similarity of word shingles, exactly.

Method.  A text is the set of its five-word shingles, as 64-bit hashes.  A text of ``n``
shingles and a near copy (similarity 4/5 at least) differ in ``n // 5`` of its shingles at
most and in size by a quarter at most.  So, in any order of all shingles, of the first
``n // 5 + need(n)`` of each of two near copies at least the lesser ``need`` agree.

1. In the order of the hashes: texts of whose first shingles too few stand in another
   text's first shingles have no near copy.  Only a third of the shingles is shuffled.
2. The others are put in order by how many of them hold a shingle, rarest first, so that
   common passages make no candidates.  Pairs that share enough of the first shingles and
   fit in size are candidates, each found once; the whole sets decide.

Scale.  Shingles that very many texts hold are found in a sample of the texts, counted with
partial sums and broadcast, so that no task gets all rows of one; the sample only decides
the way a shingle is counted, not whether.  The ``FREQUENT`` most frequent go that way, so what
is left of any other is less than one in so many of all rows.  ``FEW`` of them or less stand in the
expressions; more are met by a broadcast join, with the same result.  Dense groups are thinned first: every text is
compared with the smallest id that holds one of its shingles, one pair a shingle and text,
as long as that takes out a tenth of them.  What is left is compared pair by pair.  No
candidate is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    ASCII_LOWER, BROADCAST_ROWS, HOT_ROWS, broadcast_if_small, discard, fresh, materialize, merge_if_long, row_hash,
    slices,
)

SHINGLE = 5
SEED = 42
#: One text in so many is looked at to find shingles that very many texts hold; of these, the most frequent.
SAMPLED, FREQUENT = 32, BROADCAST_ROWS
#: So many frequent shingles are written into the expressions.
FEW = 2000


def _need(n):
    """Of a text's first shingles, those that a near copy of its size or more shares at least."""
    return F.greatest(F.floor(n / 10), F.lit(1)).cast("int")


def _first(n):
    return (F.floor(n / 5) + _need(n)).cast("int")


def _least(n):
    """``need`` of the smallest set that can be a near copy of one of ``n``."""
    return _need(F.ceil(4 * n / 5))


def shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: bool = False) -> DataFrame:
    """``(id, n, hashes)``: the text's distinct shingles in order, or the ``first`` of them only.

    A-Z lower-cased; words are runs without ASCII white space; fewer than five words are one
    shingle.  Null and blank texts have none and no row.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash

        words_of = re.compile("[^ \t-\r]+").findall
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, 100):
            ids, sizes, sets = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text.translate(ASCII_LOWER)) if text else ()
                if words:
                    h = np.unique(
                        np.fromiter(
                            (
                                digest(" ".join(words[k : k + SHINGLE]), SEED)
                                for k in range(max(1, len(words) - SHINGLE + 1))
                            ),
                            dtype=np.uint64,
                        )
                    ).view(np.int64)
                    ids.append(i)
                    sizes.append(len(h))
                    sets.append(h[: len(h) // 5 + max(len(h) // 10, 1)] if first else h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.list_(pa.int64()))],
                names=["id", "n", "hashes"],
            )

    return src.mapInArrow(run, "id long, n int, hashes array<long>")


def _frequent(sets: DataFrame) -> list[int] | DataFrame:
    """Shingles that some ``HOT_ROWS`` sets or more hold, by a sample: a list, or a stored table ``h`` of many."""
    some = sets.where(
        F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(SAMPLED)) == 0
    ).select(F.explode("hashes").alias("h"))
    often = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS // SAMPLED)
    found = materialize(often.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h"), "frequent")
    first = [r.h for r in found.limit(FEW + 1).collect()]
    return first if len(first) <= FEW else found


def _split(sets: DataFrame, frequent: list[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, h) of the sets' shingles: those that are not frequent, and those that are."""
    rows = lambda c: sets.select("id", "n", F.explode(c).alias("h"))
    if isinstance(frequent, list):
        held = F.array(*map(F.lit, frequent)).cast("array<long>")
        return rows(F.array_except("hashes", held)), rows(F.array_intersect("hashes", held))
    known = F.broadcast(frequent)
    return tuple(rows("hashes").join(known, "h", how).select("id", "n", "h") for how in ("left_anti", "left_semi"))


def _shared(sets: DataFrame, frequent: list[int] | DataFrame) -> DataFrame:
    """Rows (id, n, h, c, lead) of the sets' shingles that another set has too: their count ``c`` and the
    smallest id that holds them, ``lead`` (id, n).  The ``frequent`` ones are counted by partial sums."""
    by = Window.partitionBy("h")
    first = F.min(F.struct("id", "n"))
    cold, hot = _split(sets, frequent)
    cold = cold.withColumns({"c": F.count("*").over(by), "lead": first.over(by)}).where("c > 1")
    if isinstance(frequent, list) and not frequent:
        return cold.select("id", "n", "h", "c", "lead")
    counted = hot.groupBy("h").agg(F.count("*").alias("c"), first.alias("lead")).where("c > 1")
    return cold.select("id", "n", "h", "c", "lead").unionByName(
        hot.join(F.broadcast(counted), "h").select("id", "n", "h", "c", "lead")
    )


def _rare(sets: DataFrame, frequent: list[int] | DataFrame) -> DataFrame:
    """``(id, n, s)``: the first shingles of each set as (c, h, lead), rarest first, without those no other set has."""
    some = _shared(sets, frequent).groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("c", "h", "lead"))).alias("s")
    )
    room = _first(F.col("n")) - (F.col("n") - F.size("s"))
    return some.where(room >= _least(F.col("n"))).select(
        "id", "n", F.size("s").alias("all"), F.slice("s", F.lit(1), room).alias("s")
    )


def _candidates(rare: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, each once: sets that fit in size and agree in enough of their first shingles.

    Two near copies agree in one of their first ``n // 5 + 1`` shingles at least, too: those are the
    join's keys.  A pair is emitted for the first key that both have only, and only if it passes.
    """
    one = F.floor(F.col("n") / 5).cast("int") + 1 - (F.col("n") - F.col("all"))
    rows = rare.where(one > 0).select("id", "n", F.transform("s", lambda x: x["h"]).alias("q"), one.alias("k"))
    keyed = rows.select("id", "n", "q", "k", F.explode(F.slice("q", F.lit(1), F.col("k"))).alias("h"))
    a, b = (keyed.select(*[F.col(c).alias(c + side) for c in ("id", "n", "q", "k")], "h") for side in ("a", "b"))
    fit = (5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na"))
    keys = F.array_intersect(F.slice("qa", F.lit(1), F.col("ka")), F.slice("qb", F.lit(1), F.col("kb")))
    agree = F.size(F.array_intersect("qa", "qb")) >= F.least(_need(F.col("na")), _need(F.col("nb")))
    on = (a["h"] == b["h"]) & (F.col("ida") < F.col("idb")) & fit & (F.element_at(keys, 1) == a["h"]) & agree
    # the optimizer takes the rows of a set for one: without the hint it would broadcast them
    return a.hint("merge").join(b.hint("merge"), on).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 4/5 at least."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.select("a", "b").hint("merge").join(left, "a").hint("merge").join(right, "b").where(
        9 * both >= 4 * (F.col("na") + F.col("nb"))
    ).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` of the rows to leave out so that no two near copies stay: of a pair, the larger id.

    ``docs``: unique ids; rows with a null id are left alone (see :func:`drop_near_copies`).
    """
    docs = docs.where(F.col(id_col).isNotNull())
    firsts = materialize(shingles(docs, id_col, text_col, first=True), "firsts")
    some = _shared(firsts, _frequent(firsts)).groupBy("id", "n").agg(F.count("*").alias("k")).where(
        F.col("k") >= _least(F.col("n"))
    ).select("id")
    some = broadcast_if_small(materialize(some, "maybe"))
    discard(firsts)
    sets = materialize(
        shingles(docs.join(some, docs[id_col].cast("long") == some.id, "left_semi"), id_col, text_col), "sets"
    )
    frequent = _frequent(sets)
    gone = None
    near = lambda a, b: (5 * a >= 4 * b) & (5 * b >= 4 * a)
    while True:
        rare = materialize(_rare(sets, frequent), "rare")
        n = rare.count()
        led = rare.select(F.col("id").alias("b"), "n", F.explode("s.lead").alias("l")).select(
            F.col("l.id").alias("a"), F.col("l.n").alias("na"), "b", "n"
        )
        led = led.where((F.col("a") < F.col("b")) & near(F.col("na"), F.col("n"))).select("a", "b").distinct()
        out = materialize(_verified(led, sets).select(F.col("b").alias("id")).distinct(), "led")
        gone = out if gone is None else gone.union(out)
        left = rare.select("id").join(merge_if_long(out, out.count()), "id", "left_anti")
        before, sets = sets, materialize(sets.join(left, "id", "left_semi"), "sets")
        discard(before, rare)
        if 10 * out.count() <= n:
            break
    rare = materialize(_rare(sets, frequent), "rare")
    pairs = _candidates(rare)
    out = materialize(gone.union(_verified(pairs, sets).select(F.col("b").alias("id"))).distinct(), "near_copies")
    discard(sets, rare)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows :func:`near_copies` names.  No two rows may agree in all columns.

    Rows whose id is null or repeated are told apart, and ordered, by a 64-bit hash of all
    their columns: two of n such rows take each other's place with a probability below
    n^2 / 2^65.
    """
    ident = F.col(id_col).cast("long")
    docs = materialize(docs, "once")
    key, also, hashed = (fresh(docs, k) for k in ("__key", "__id", "__hash"))
    clash = materialize(
        docs.groupBy(ident.alias(also)).agg(F.count("*").alias("n")).where(
            (F.col("n") > 1) | F.col(also).isNull()
        ).select(also),
        "clash",
    )
    if clash.limit(1).count():
        marked = docs.join(
            broadcast_if_small(clash).withColumn(hashed, F.lit(True)), ident.eqNullSafe(F.col(also)), "left"
        )
        keyed = marked.withColumn(key, F.when(F.col(hashed), row_hash(docs)).otherwise(ident)).drop(also, hashed)
    else:
        keyed = docs.withColumn(key, ident)
    gone = broadcast_if_small(near_copies(keyed, key, text_col)).withColumnRenamed("id", key)
    return keyed.join(gone, key, "left_anti").select(docs.columns)
