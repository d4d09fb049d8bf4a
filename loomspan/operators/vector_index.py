"""A partitioned vector index, searched exactly under the chapter mask.

Each novel's vectors are dealt to cells around sampled centroids, cells to rings by the distance
from the centroid, rings to blocks of about ``BLOCK`` rows.  A block is one row of a table: its
centroid, the least and greatest distance in it, its least chapter, its members.

By the triangle inequality no member of a block with distances lo..hi is nearer to a query at
distance d from the centroid than max(d - hi, lo - d), which bounds its cosine.  A search

1. bounds all blocks of the query's novel that hold a visible chapter (heads only, no members),
2. scores the query's ``SEEDS`` most promising blocks, which gives a lower bound of its k-th best,
3. scores the other blocks whose bound reaches it, and ranks all that was scored.

No block that could hold one of the k best is left out, so results are those of a full scan.

Scale.  What moves are packs, rows of some hundred vectors: blocks, and queries gathered by the
block they need.  A block that many queries need meets many packs of queries, so no task gets a
whole block's or novel's work; equal vectors, however many, are dealt to blocks by hash.  A novel
has at most some ``CENTROIDS`` cells, so the work per vector is bounded when the index is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import EPS, TOP_K

BLOCK, CENTROIDS, RINGS = 512, 512, 4
#: Queries of a pack, and blocks that a query looks at first.
PACK, SEEDS = 256, 2
#: Vectors with a smaller norm lie in blocks that are never passed over: there EPS counts.
TINY = 1e-3
#: Bounds are looser by this much than computed ones; scores are compared to this accuracy.
MARGIN = 1e-8
INDEX = (
    "novel string, block long, centroid array<double>, lo double, hi double, least_chapter int, n long, "
    "members array<struct<chapter:int,chunk_idx:long,vec:array<double>>>"
)
QUERY = "struct<query_id:long,query_chapter:int,qvec:array<double>>"
HIT = "novel string, query_id long, chapter int, chunk_idx long, sim double"


# --- inside tasks


def rows_of_vectors(column):
    """Matrix of an Arrow list array of equally long lists, null lists as zeros."""
    import numpy as np

    size = max((len(x) for x in column if x.is_valid), default=0)
    if column.null_count == 0:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    return np.array([x.as_py() or [0.0] * size for x in column], dtype=np.float64).reshape(len(column), size)


def units(m):
    """(unit vectors, norms, whether the norm is tiny)."""
    import numpy as np

    size = np.sqrt((m * m).sum(axis=1))
    tiny = size < TINY
    return m / np.where(tiny, 1.0, size)[:, None], size, tiny


def distances(a, b):
    """Distances of all rows of ``a`` from all rows of ``b``; exact where they are equal."""
    import numpy as np

    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def in_packs(batches):
    """Rows of Arrow batches one at a time: a dict of one-row arrays' values, lists as Arrow arrays."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i] for k, name in enumerate(b.schema.names)}


# --- making


def packed(df: DataFrame, keys: list[str], columns: list[str], rows: int, name: str) -> DataFrame:
    """One row of about ``rows`` rows for each key and part: ``columns`` as an array of structs.

    Parts are as many as the key's rows ask for and are dealt by hash, so no key is one row or task.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("__parts"))
    part = F.pmod(F.xxhash64(*columns), F.col("__parts")).alias("__part")
    return df.join(counts, keys).select(*keys, part, F.struct(*columns).alias("__row")).groupBy(*keys, "__part").agg(
        F.collect_list("__row").alias(name)
    ).drop("__part")


def centroids(chunks: DataFrame, block: int = BLOCK, most: int = CENTROIDS) -> DataFrame:
    """``(novel, centers)``: sampled vectors of each novel, one in ``block`` and about ``most`` in all.

    Drawn by hash, so a task that runs again draws the same; each novel has one at least, unless all
    its vectors are tiny.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    usable = chunks.where(norm >= TINY).select(
        "novel", "vec", F.shiftrightunsigned(F.xxhash64("vec", F.lit("draw")), 11).alias("u")
    )
    counts = usable.groupBy("novel").agg(F.count("*").alias("n"), F.min("u").alias("least"))
    rate = F.least(F.lit(1.0 / block), F.lit(float(most)) / F.col("n"))
    drawn = usable.join(counts, "novel").where(
        (F.col("u") < F.lit(float(1 << 53)) * rate) | (F.col("u") == F.col("least"))
    )
    # equal vectors have equal hashes: of copies one is drawn
    return drawn.select("novel", "vec").distinct().groupBy("novel").agg(F.collect_list("vec").alias("centers"))


def assigned(chunks: DataFrame, centers: DataFrame) -> DataFrame:
    """``(novel, chapter, chunk_idx, vec, cell, dist, centroid)``: the nearest centroid; cell -1 for tiny vectors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for r in in_packs(batches):
            members = r["members"].values
            vecs = members.field("vec")
            m, _, tiny = units(rows_of_vectors(vecs))
            cell, dist = np.full(len(m), -1), np.zeros(len(m))
            centre = [None] * len(m)
            if r["centers"].is_valid:
                c = units(rows_of_vectors(r["centers"].values))[0]
                far = distances(m, c)
                near = far.argmin(axis=1)
                own = c[near]
                cell = np.where(tiny, -1, near)
                # once more, plainly: equal vectors get equal distances
                dist = np.where(tiny, 0.0, np.sqrt(((m - own) ** 2).sum(axis=1)))
                centre = [None if t else x for t, x in zip(tiny, own.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["novel"].as_py()] * len(m), pa.string()), members.field("chapter"),
                    members.field("chunk_idx"), vecs, pa.array(cell, pa.int32()), pa.array(dist),
                    pa.array(centre, pa.list_(pa.float64())),
                ],
                names=["novel", "chapter", "chunk_idx", "vec", "cell", "dist", "centroid"],
            )

    packs = packed(chunks, ["novel"], ["chapter", "chunk_idx", "vec"], BLOCK, "members")
    return packs.join(centers, "novel", "left").mapInArrow(
        run, "novel string, chapter int, chunk_idx long, vec array<double>, cell int, dist double, centroid array<double>"
    )


def build(chunks: DataFrame, path: str, block: int = BLOCK, most: int = CENTROIDS, rings: int = RINGS) -> DataFrame:
    """Write the index of ``(novel, chapter, chunk_idx, vec)`` to ``path`` and return it; see :data:`INDEX`.

    Rows without a vector are left out.  Null chapters are never visible, so those rows are too.
    """
    spark = chunks.sparkSession
    src = chunks.select(
        F.col("novel").cast("string"), F.col("chapter").cast("int"), F.col("chunk_idx").cast("long"),
        F.col("vec").cast("array<double>"),
    ).where("vec IS NOT NULL AND chapter IS NOT NULL")
    placed_at, blocks_at = f"{path}/assigned", f"{path}/blocks"
    assigned(src, centroids(src, block, most)).write.mode("overwrite").parquet(placed_at)
    placed = spark.read.parquet(placed_at)
    cuts = [i / rings for i in range(1, rings)]
    edges = placed.groupBy("novel", "cell").agg(F.percentile_approx("dist", cuts, 1000).alias("edges"))
    ringed = placed.join(edges, ["novel", "cell"]).withColumn(
        "ring", F.size(F.filter("edges", lambda e: e < F.col("dist")))
    ).drop("edges")
    keys = ["novel", "cell", "ring"]
    counts = ringed.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("parts"))
    part = F.pmod(F.xxhash64("chapter", "chunk_idx", "vec"), F.col("parts")).alias("part")
    dealt = ringed.join(counts, keys).select(*keys, part, "chapter", "chunk_idx", "vec", "dist", "centroid")
    dealt.groupBy(*keys, "part").agg(
        F.first("centroid").alias("centroid"), F.min("dist").alias("lo"), F.max("dist").alias("hi"),
        F.min("chapter").alias("least_chapter"), F.count("*").alias("n"),
        F.collect_list(F.struct("chapter", "chunk_idx", "vec")).alias("members"),
    ).select(
        "novel", F.xxhash64(*keys, "part").alias("block"), "centroid", "lo", "hi", "least_chapter", "n", "members"
    ).write.mode("overwrite").parquet(blocks_at)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``; its heads are read without the members."""
    return spark.read.schema(INDEX).parquet(f"{path}/blocks")


# --- searching


def bounds(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``(novel, query_id, block, bound)`` for the blocks that may hold a chunk the query may see.

    ``bound`` is no less than any member's cosine.  Heads and queries meet in packs.
    """
    heads = packed(
        index.select("novel", "block", "centroid", "lo", "hi", "least_chapter"), ["novel"],
        ["block", "centroid", "lo", "hi", "least_chapter"], BLOCK, "heads",
    )
    asked = packed(queries, ["novel"], ["query_id", "query_chapter", "qvec"], PACK, "asked")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for r in in_packs(batches):
            heads, asked = r["heads"].values, r["asked"].values
            q, _, q_tiny = units(rows_of_vectors(asked.field("qvec")))
            centre = heads.field("centroid")
            loose = np.array([not x.is_valid for x in centre])
            c = rows_of_vectors(centre)
            c = np.zeros((len(loose), q.shape[1])) if c.shape[1] != q.shape[1] else c
            d = distances(q, c)
            lo, hi = (heads.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi"))
            # what the squares lose is made good by the margin, ten times over
            gap = np.maximum(0.0, np.maximum(d - hi, lo - d) - 10 * MARGIN)
            bound = np.where(loose[None, :] | q_tiny[:, None], 2.0, 1.0 - gap * gap / 2 + MARGIN)
            seen = heads.field("least_chapter").to_numpy()[None, :] <= asked.field("query_chapter").to_numpy()[:, None]
            at, block = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["novel"].as_py()] * len(at), pa.string()), asked.field("query_id").take(pa.array(at)),
                    heads.field("block").take(pa.array(block)), pa.array(bound[at, block]),
                ],
                names=["novel", "query_id", "block", "bound"],
            )

    return heads.join(asked, "novel").mapInArrow(run, "novel string, query_id long, block long, bound double")


def best_of(k: int):
    """A function of batches with ``members`` and ``asked``: the best ``k`` of each query and row, and near-ties."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for r in in_packs(batches):
            members, asked = r["members"].values, r["asked"].values
            m, q = rows_of_vectors(members.field("vec")), rows_of_vectors(asked.field("qvec"))
            norms = np.sqrt((m * m).sum(axis=1)) + EPS
            q_norms = np.sqrt((q * q).sum(axis=1)) + EPS
            chapter = members.field("chapter").to_numpy()
            rough = (q @ m.T) / (q_norms[:, None] * norms[None, :])
            rough[chapter[None, :] > asked.field("query_chapter").to_numpy()[:, None]] = -np.inf
            if rough.shape[1] > k:
                kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            else:
                kth = np.full(len(rough), -np.inf)
            at, member = np.nonzero((rough >= kth[:, None] - MARGIN) & (rough > -np.inf))
            # once more, row by row: equal vectors get equal scores wherever they lie
            sim = (m[member] * q[at]).sum(axis=1) / (q_norms[at] * norms[member])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["novel"].as_py()] * len(at), pa.string()), asked.field("query_id").take(pa.array(at)),
                    members.field("chapter").take(pa.array(member)), members.field("chunk_idx").take(pa.array(member)),
                    pa.array(sim),
                ],
                names=["novel", "query_id", "chapter", "chunk_idx", "sim"],
            )

    return run


def scored(index: DataFrame, wanted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:data:`HIT`: the best ``k`` visible members, ties and near-ties too, of each (query, block) in ``wanted``."""
    pairs = wanted.select("novel", "query_id", "block").join(queries, ["novel", "query_id"])
    packs = packed(pairs, ["novel", "block"], ["query_id", "query_chapter", "qvec"], PACK, "asked")

    return packs.join(index.select("novel", "block", "members"), ["novel", "block"]).mapInArrow(best_of(k), HIT)


def scanned(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:data:`HIT`: the best ``k`` visible chunks, ties and near-ties too, of each query and pack of chunks.

    Both have vectors of one length, finite and without nulls.  A broadcast holds the queries' packs; a
    task multiplies matrices of a pack each.
    """
    members = packed(
        chunks.select("novel", F.col("chapter").cast("int"), F.col("chunk_idx").cast("long"), F.col("vec").cast("array<double>"))
        .where("chapter IS NOT NULL"),
        ["novel"], ["chapter", "chunk_idx", "vec"], BLOCK, "members",
    )
    asked = packed(
        queries.select(
            "novel", F.col("query_id").cast("long"), F.col("query_chapter").cast("int"), F.col("qvec").cast("array<double>")
        ).where("query_chapter IS NOT NULL"),
        ["novel"], ["query_id", "query_chapter", "qvec"], PACK, "asked",
    )
    return members.join(F.broadcast(asked), "novel").mapInArrow(best_of(k), HIT)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each query with their ``rank``; ties by chapter, then chunk."""
    from pyspark.sql import Window

    order: list[Column] = [F.round("sim", 9).desc(), F.col("chapter"), F.col("chunk_idx")]
    w = Window.partitionBy("novel", "query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, work: str, k: int = TOP_K, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """``(hits, looked)``: the best ``k`` visible chunks of each query, and the (query, block) pairs scored.

    ``queries``: (novel, query_id, query_chapter, qvec) with distinct ids in a novel.  ``work`` is a
    fresh folder in the shared store for what lies between the steps.  Queries without a vector or a
    chapter find nothing.
    """
    from pyspark.sql import Window

    spark = index.sparkSession
    asked = queries.select(
        F.col("novel").cast("string"), F.col("query_id").cast("long"), F.col("query_chapter").cast("int"),
        F.col("qvec").cast("array<double>"),
    ).where("qvec IS NOT NULL AND query_chapter IS NOT NULL")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    order = Window.partitionBy("novel", "query_id").orderBy(F.col("bound").desc(), "block")
    pairs = kept(bounds(index, asked).withColumn("place", F.row_number().over(order)), "bounds")
    first = kept(scored(index, pairs.where(F.col("place") <= seeds), asked, k), "seeds")
    floor = ranked(first, k).where(F.col("rank") == k).select("novel", "query_id", F.col("sim").alias("floor"))
    rest = kept(
        pairs.where(F.col("place") > seeds).join(floor, ["novel", "query_id"], "left").where(
            F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - MARGIN)
        ).select("novel", "query_id", "block"),
        "wanted",
    )
    hits = first.unionByName(scored(index, rest, asked, k))
    looked = pairs.where(F.col("place") <= seeds).select("novel", "query_id", "block").unionByName(rest)
    return ranked(hits, k), looked
