"""Hard negatives by blocked dense products.

For each anchor its best rows of the same label (positives), and for each of these the best
rows of another label whose score lies in a window below the positive's.

* Components are floored to whole numbers, so a score is an integer.  A block product in
  float64 is exact as long as every sum stays below 2^53, which is checked block by block;
  beyond that whole-number products take its place.
* Anchors lie in block files of ``ANCHORS`` rows in the shared folder, hashed there, sorted,
  written and read by the executors.  A task takes a group of candidates (``GROUP_BYTES``) and
  lets all anchor blocks pass by, one in memory at a time: the anchors' number bounds neither
  a task's memory nor what the driver sees, and each pass reads the candidates once.
* First pass: the best positives of an anchor in each group, merged by rank (best-k lists
  merge).  They are stored beside the anchors' blocks.  Second pass: the best negatives in the
  window of each positive, a group at a time, merged in the same way.

What is shuffled is at most k rows for each anchor (and positive) and group of candidates, and
Spark's group limit cuts them to k for each task before they move.  The work is the product of
anchors and candidates by the operator's definition; the groups are dealt to as many tasks as
there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Rows of an anchor block; bytes of a group of candidates; columns of one product.
ANCHORS = 512
GROUP_BYTES = 32 << 20
COLUMNS = 4096
#: Below this sum of products float64 is exact.
EXACT = 1 << 53
LOWEST = -(1 << 63)


def usable(rows: DataFrame, anchors: Column, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``(id, label, vec, anchor)`` of the rows that take part: nothing null, every component finite."""
    short = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    vec = F.col(vector_col) if short else F.col(vector_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)


def matrix(vectors, scale: float):
    """Rows of an Arrow list array as whole numbers in float64; shorter rows end in zeros."""
    import numpy as np

    if not len(vectors):
        return np.zeros((0, 0))

    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), int(sizes[0]))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def products(a, b):
    """Exact inner products of all rows of ``a`` with all rows of ``b``, as int64.

    Sums of 2^63 or more, which a long cannot hold, become the nearest long.
    """
    import numpy as np

    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * wide
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if wide else np.zeros((len(a), len(b)), dtype=object)
    return np.clip(exact, LOWEST + 1, (1 << 63) - 1).astype(np.int64)


def keep_best(score, ident, new, ids, allowed):
    """Best lists of rows x k (best first) with the cells of ``new`` that are ``allowed`` taken in.

    Higher scores come first, ties by the smaller id.  Columns come in rising order of id, over all
    calls for the same lists, so a cell that only ties with a full list's last place is out.
    """
    import numpy as np

    rows, k = score.shape
    at, column = np.nonzero(allowed & (new > score[:, -1:]))
    if not len(at):
        return score, ident
    touched = np.unique(at)
    row = np.concatenate([np.repeat(touched, k), at])
    value = np.concatenate([score[touched].ravel(), new[at, column]])
    name = np.concatenate([ident[touched].ravel(), ids[column]])
    # -LOWEST would overflow; ~x orders like -x
    order = np.lexsort((name, ~value, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    kept = order[place < k].reshape(len(touched), k)
    score[touched], ident[touched] = value[kept], name[kept]
    return score, ident


def lower(p, percent: int):
    """Least whole s with 100 s >= percent p, without an overflow."""
    return percent * (p // 100) - (-(percent * (p % 100)) // 100)


def upper(p, percent: int):
    """Greatest whole s with 100 s <= percent p, without an overflow."""
    return percent * (p // 100) + (percent * (p % 100)) // 100


def block_file(root, block: int):
    return f"{root}/{block}.arrow"


def write_blocks(rows: DataFrame, path: str) -> None:
    """One Arrow file for each value of ``block``, rows in the order of the other columns but ``vec``.

    A file is written under another name and renamed: it is whole or not there, and a task that
    runs twice writes the same again.
    """
    order = [c for c in rows.columns if c not in ("block", "vec")]

    def run(key, part):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part = part.sort_by([(c, "ascending") for c in order]).combine_chunks()
        name = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, part.schema) as file:
            file.write_table(part)
        store.move(name, block_file(root, key[0].as_py()))
        return pa.table({"block": [key[0].as_py()], "n": [part.num_rows]})

    written = rows.groupBy("block").applyInArrow(run, "block long, n long")
    materialize(written, "blocks")


def block_reader(path: str, blocks: int):
    """Inside a task: a function from a block's number to its table, None where the block is empty.

    ``path`` is read through the file system that all executors share.  The last block read stays.
    """
    import pyarrow as pa
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    names = [block_file(root, k) for k in range(blocks)]
    held: dict = {}

    def read(block: int):
        if block not in held:
            held.clear()
            held[block] = None
            if store.get_file_info(names[block]).type != fs.FileType.NotFound:
                with store.open_input_file(names[block]) as f:
                    held[block] = pa.ipc.open_file(f).read_all().combine_chunks()
        return held[block]

    return read


def groups(batches, scale: float, group_bytes: int):
    """Candidates as (ids, labels, matrix) in groups of about ``group_bytes``, ids rising within each."""
    import pyarrow as pa

    def group(parts):
        t = pa.Table.from_batches(parts).sort_by("id").combine_chunks()
        return t["id"].to_numpy(), t["label"].to_numpy(), matrix(t["vec"].combine_chunks(), scale)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= group_bytes:
            yield group(held)
            held, size = [], 0
    if size:
        yield group(held)


def first_pass(path: str, blocks: int, k: int, scale: float, group_bytes: int):
    """Task of the first pass: candidates to ``(block, row, anchor_id, id, score)``, best k a group and anchor."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        read = block_reader(path, blocks)
        for ids, labels, vectors in groups(batches, scale, group_bytes):
            for block in range(blocks):
                if (t := read(block)) is None:
                    continue
                own, own_label = t["id"].to_numpy(), t["label"].to_numpy()
                anchors = matrix(t["vec"].combine_chunks(), scale)
                score = np.full((len(own), k), LOWEST)
                ident = np.zeros((len(own), k), np.int64)
                for at in range(0, len(ids), COLUMNS):
                    some = slice(at, at + COLUMNS)
                    allowed = (own_label[:, None] == labels[None, some]) & (own[:, None] != ids[None, some])
                    score, ident = keep_best(score, ident, products(anchors, vectors[some]), ids[some], allowed)
                row, place = np.nonzero(score > LOWEST)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), block, np.int64)), pa.array(row.astype(np.int64)), pa.array(own[row]),
                        pa.array(ident[row, place]), pa.array(score[row, place]),
                    ],
                    names=["block", "row", "anchor_id", "id", "score"],
                )

    return run


def second_pass(
    path: str, found: str, blocks: int, positives: int, k: int, low: int, high: int, scale: float, group_bytes: int
):
    """Task of the second pass: ``(block, row, place, anchor_id, positive_id, positive_score, id, score)``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        read, read_found = block_reader(path, blocks), block_reader(found, blocks)
        for ids, labels, vectors in groups(batches, scale, group_bytes):
            for block in range(blocks):
                t, mates = read(block), read_found(block)
                if t is None or mates is None:
                    continue
                own, own_label = t["id"].to_numpy(), t["label"].to_numpy()
                anchors = matrix(t["vec"].combine_chunks(), scale)
                at_row, at_place = mates["row"].to_numpy(), mates["place"].to_numpy() - 1
                p, p_id = np.zeros((len(own), positives), np.int64), np.zeros((len(own), positives), np.int64)
                there = np.zeros((len(own), positives), bool)
                p[at_row, at_place], p_id[at_row, at_place] = mates["score"].to_numpy(), mates["id"].to_numpy()
                there[at_row, at_place] = True
                least, most = lower(p, low), upper(p, high)
                score = np.full((positives, len(own), k), LOWEST)
                ident = np.zeros((positives, len(own), k), np.int64)
                for at in range(0, len(ids), COLUMNS):
                    some = slice(at, at + COLUMNS)
                    new = products(anchors, vectors[some])
                    other = own_label[:, None] != labels[None, some]
                    for j in range(positives):
                        allowed = other & there[:, j, None] & (new >= least[:, j, None]) & (new <= most[:, j, None])
                        score[j], ident[j] = keep_best(score[j], ident[j], new, ids[some], allowed)
                place, row, rank = np.nonzero(score > LOWEST)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), block, np.int64)), pa.array(row.astype(np.int64)),
                        pa.array(place.astype(np.int64) + 1), pa.array(own[row]), pa.array(p_id[row, place]),
                        pa.array(p[row, place]), pa.array(ident[place, row, rank]), pa.array(score[place, row, rank]),
                    ],
                    names=["block", "row", "place", "anchor_id", "positive_id", "positive_score", "id", "score"],
                )

    return run


def best(df: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each key, by falling score and rising id."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80,
    high: int = 100, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label",
    vector_col: str = "embedding", group_bytes: int = GROUP_BYTES, block_rows: int = ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows that fulfil ``anchors`` (a condition on the columns of ``rows``; by default
    ids divisible by 100).  An anchor's positives are its best ``positives`` rows of the same label
    under another id; for each, up to ``negatives`` rows of another label with low * p <= 100 * s
    <= high * p, best first; ties go to the smaller id.  Nothing is returned for a positive without
    such rows.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no
    part.  Vectors of different lengths are compared as if the shorter ended in zeros.  Repeated
    rows are candidates each; repeated anchors that agree in id, label and vector are one, others
    are anchors each, under the same id.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    anchor = F.pmod(F.col(id_col).cast("long"), F.lit(100)) == 0 if anchors is None else anchors
    stored = materialize(
        usable(rows, anchor, id_col, label_col, vector_col).repartition(spark.sparkContext.defaultParallelism), "vectors"
    )
    asked = stored.where("anchor")
    blocks = max(1, -(-asked.count() // block_rows))
    chosen = asked.select("id", "label", F.xxhash64("vec").alias("key"), "vec").distinct()
    at = shared_path(spark, "anchors")
    write_blocks(chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "key"), F.lit(blocks))), at)
    candidates = stored.select("id", "label", "vec")
    hits = candidates.mapInArrow(
        first_pass(at, blocks, positives, scale, group_bytes), "block long, row long, anchor_id long, id long, score long"
    )
    mates = best(hits, ["block", "row"], positives, "place").select(
        "block", "row", F.col("place").cast("long").alias("place"), "id", "score"
    )
    found = shared_path(spark, "positives")
    write_blocks(mates, found)
    near = candidates.mapInArrow(
        second_pass(at, found, blocks, positives, negatives, low, high, scale, group_bytes),
        "block long, row long, place long, anchor_id long, positive_id long, positive_score long, id long, score long",
    )
    return best(near, ["block", "row", "place"], negatives, "rank").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
