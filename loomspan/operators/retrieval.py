"""Phase- and chapter-aware retrieval: masks, cosine top-k, trailing windows, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_K = 6
TRAILING = 5
EPS = 1e-12
#: Queries that one pass may hold; more of them go through :mod:`loomspan.operators.vector_index`.
QUERY_BLOCK = 20_000


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine with a little added to both norms, so that zero vectors give zero."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return dot / (((na if na is not None else norm(a)) + EPS) * ((nb if nb is not None else norm(b)) + EPS))


def masked_top_k(chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k most similar chunks that a query may see (chunk chapter <= query chapter).

    ``chunks``: (novel, chapter, chunk_idx, vec); ``queries``: (novel, query_id, query_chapter,
    qvec), a stated set.  Up to ``QUERY_BLOCK`` of them, as counted, are broadcast: one pass over the
    chunks, in packs whose products are matrices, each giving its best k per query before the shuffle
    of the ranking.  Vectors with nulls, of other lengths or not finite are met one by one.  More
    of them are looked up in an index made for the purpose, which passes over the blocks that cannot
    hold a query's best (:mod:`loomspan.operators.vector_index`).  The mask comes before the
    ranking: fewer than k visible chunks give fewer rows.
    """
    n, size = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    if n > QUERY_BLOCK:
        from ..sinks.paths import scratch
        from . import vector_index

        spark = chunks.sparkSession
        index = vector_index.build(chunks, scratch(spark, "index"))
        return vector_index.search(index, queries, scratch(spark, "search"), k)[0]
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = dict(chunks.dtypes) | dict(queries.dtypes)
    if kinds["novel"] != "string" or not {kinds[c] for c in ("chunk_idx", "query_id")} <= whole or not (
        {kinds[c] for c in ("chapter", "query_chapter")} <= whole - {"bigint"}
    ):
        return _ranked(_one_by_one(chunks, queries), k)
    from .vector_index import scanned

    plain = lambda c: F.coalesce(
        (F.size(c) == (size or 0)) & F.forall(c, lambda x: F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)
    )
    odd, asked = ~plain("vec"), queries.where(plain("qvec"))
    hits = scanned(chunks.where(~odd), asked, k).unionByName(
        _one_by_one(chunks.where(odd), queries)
    ).unionByName(_one_by_one(chunks.where(~odd), queries.where(~plain("qvec"))))
    return _ranked(hits, k)


def _one_by_one(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The cosine of every query and chunk it may see."""
    normed = chunks.withColumn("vnorm", norm(F.col("vec")))
    asked = F.broadcast(queries.withColumn("qnorm", norm(F.col("qvec"))).withColumnRenamed("novel", "__novel"))
    hit = normed.join(asked, (F.col("novel") == F.col("__novel")) & (F.col("chapter") <= F.col("query_chapter")))
    return hit.select(
        "novel", "query_id", "chapter", "chunk_idx",
        cosine(F.col("vec"), F.col("qvec"), F.col("vnorm"), F.col("qnorm")).alias("sim"),
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("novel", "query_id").orderBy(F.round("sim", 9).desc(), "chapter", "chunk_idx")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trailing_window(
    summaries: DataFrame, queries: DataFrame, key: str, chapter: str, query_chapter: str, n: int = TRAILING
) -> DataFrame:
    """Per query the chapters of the trailing window that are there, in order, and those that are missing.

    Each query expands to n chapters at most and meets the summaries by (key, chapter).
    """
    first = F.greatest(F.lit(1), F.col(query_chapter) - n + 1)
    want = queries.where(F.col(query_chapter) >= 1).withColumn(
        "__c", F.explode(F.sequence(first, F.col(query_chapter)))
    )
    have = summaries.select(F.col(key), F.col(chapter).alias("__c"), F.lit(True).alias("__there")).distinct()
    joined = want.join(have, [key, "__c"], "left")
    there = F.collect_list(F.when(F.col("__there"), F.col("__c")))
    gone = F.collect_list(F.when(F.col("__there").isNull(), F.col("__c")))
    return joined.groupBy(key, query_chapter).agg(
        F.array_sort(there).alias("chapters"), F.array_sort(gone).alias("missing")
    )


def summary_context(pieces: Column, missing: Column) -> Column:
    """Context text: labelled chapters, then a note on the gaps; null where there is nothing."""
    blocks = F.transform(
        pieces, lambda p: F.concat(F.lit("[Chapter "), p["chapter"].cast("string"), F.lit("]\n"), F.trim(p["summary"]))
    )
    note = F.when(
        F.size(missing) > 0,
        F.concat(
            F.lit("[note] Missing summaries for chapters: ["),
            F.array_join(F.transform(missing, lambda c: c.cast("string")), ", "), F.lit("]"),
        ),
    )
    all_parts = F.array_compact(F.concat(blocks, F.array(note)))
    return F.when(F.size(all_parts) > 0, F.array_join(all_parts, "\n\n"))


#: Context builders by mode; users add their own.
BUILDERS: dict = {}


def builder(mode: str):
    """Registers a context builder: a function from trials to trials with a ``context`` column."""

    def add(f):
        BUILDERS[mode] = f
        return f

    return add


@builder("vanilla")
def no_context(trials: DataFrame) -> DataFrame:
    return trials.withColumn("context", F.lit(None).cast("string"))


def build_context(mode: str, trials: DataFrame, **inputs) -> DataFrame:
    """Contexts of a mode; an unknown mode is an error."""
    if mode not in BUILDERS:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(sorted(BUILDERS))}")
    return BUILDERS[mode](trials, **inputs)


@builder("summary")
def summary_contexts(trials: DataFrame, summaries: DataFrame, n: int = TRAILING) -> DataFrame:
    """The trailing chapters' summaries, in order, and a note on the missing ones."""
    want = trials.select("novel", "query_chapter").distinct().where("query_chapter >= 1").withColumn(
        "chapter", F.explode(F.sequence(F.greatest(F.lit(1), F.col("query_chapter") - n + 1), F.col("query_chapter")))
    )
    got = want.join(summaries.select("novel", "chapter", "summary"), ["novel", "chapter"], "left")
    piece = F.when(F.col("summary").isNotNull(), F.struct("chapter", "summary"))
    gone = F.when(F.col("summary").isNull(), F.col("chapter"))
    ctx = got.groupBy("novel", "query_chapter").agg(
        summary_context(F.array_sort(F.collect_list(piece)), F.array_sort(F.collect_list(gone))).alias("context")
    )
    return trials.join(ctx, ["novel", "query_chapter"], "left")


@builder("arc")
def arc_contexts(trials: DataFrame, axes: DataFrame) -> DataFrame:
    """The character's axes as they may be seen at the query chapter, as JSON.

    ``axes``: one row per axis with (novel, character, trajectory, ...).
    """
    from .arcs import curate

    points = trials.select("novel", "character", "query_chapter").distinct()
    seen = curate(axes.join(points, ["novel", "character"]), "query_chapter")
    fields = [c for c in seen.columns if c not in ("novel", "character", "query_chapter")]
    ctx = seen.groupBy("novel", "character", "query_chapter").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("context")
    )
    return trials.join(ctx, ["novel", "character", "query_chapter"], "left")


@builder("rag")
def rag_contexts(trials: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The top chunks of each query, best first.  ``queries`` as in :func:`masked_top_k`, by ``query_id``."""
    top = masked_top_k(chunks.select("novel", "chapter", "chunk_idx", "vec"), queries, k)
    texts = top.join(chunks.select("novel", "chapter", "chunk_idx", "text"), ["novel", "chapter", "chunk_idx"])
    ctx = texts.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "chapter", "text"))),
                lambda x: F.concat(F.lit("[Chapter "), x["chapter"].cast("string"), F.lit("]\n"), x["text"]),
            ),
            "\n\n",
        ).alias("context")
    )
    return trials.join(ctx, "query_id", "left")


#: Halvings of the chapter line: nodes cover 1, 2, 4, ... chapters.
LEVELS = 20


def cover(lo: Column, hi: Column, levels: int = LEVELS) -> Column:
    """The fewest nodes (level, node) that cover the chapters lo..hi; node k of level l holds k * 2^l and on."""
    node = lambda level, at: F.struct(level.alias("level"), at.cast("long").alias("node"))
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("out"))

    def step(s, level):
        open_ = s["lo"] <= s["hi"]
        left = open_ & (F.pmod(s["lo"], F.lit(2)) == 1)
        right = open_ & (F.pmod(s["hi"], F.lit(2)) == 0)
        more = F.concat(
            F.when(left, F.array(node(level, s["lo"]))).otherwise(none),
            F.when(right, F.array(node(level, s["hi"]))).otherwise(none),
        )
        return F.struct(
            F.when(open_, F.shiftright(F.when(left, s["lo"] + 1).otherwise(s["lo"]), 1)).otherwise(s["lo"]).alias("lo"),
            F.when(open_, F.shiftright(F.when(right, s["hi"] - 1).otherwise(s["hi"]), 1)).otherwise(s["hi"]).alias("hi"),
            F.concat(s["out"], more).alias("out"),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)
    # what is left of a very wide range: nodes of the top level, side by side
    top = F.when(
        done["lo"] <= done["hi"],
        F.transform(F.sequence(done["lo"], done["hi"]), lambda k: node(F.lit(levels), k)),
    ).otherwise(none)
    return F.concat(done["out"], top)


def in_range(
    events: DataFrame, phases: DataFrame, key: str, chapter: str, lo: str, hi: str, order: str, most: int = 30,
    levels: int = LEVELS,
) -> DataFrame:
    """Events whose chapter lies in a phase's range, the first ``most`` by order, with their ``place``.

    An event stands in one node of each level of the chapter line; of a node only the first ``most``
    events count, for whatever range it is part of, and they are kept before anything is joined.  A
    range is some nodes, and meets them by (key, level, node): what is joined is in proportion to
    what is found, however wide ranges overlap.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__level")
    spread = events.where(F.col(chapter).isNotNull()).select("*", at)
    spread = spread.withColumn("__node", F.expr(f"shiftright(CAST(`{chapter}` AS BIGINT), __level)"))
    first = Window.partitionBy(key, "__level", "__node").orderBy(order)
    kept = spread.withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most).drop("__place")
    ranges = phases.where(F.col(lo) <= F.col(hi))
    wanted = ranges.select("*", F.explode(cover(F.col(lo), F.col(hi), levels)).alias("__n")).select(
        "*", F.col("__n.level").alias("__level"), F.col("__n.node").alias("__node")
    ).drop("__n")
    joined = kept.join(wanted, [key, "__level", "__node"]).drop("__level", "__node")
    w = Window.partitionBy(key, lo, hi).orderBy(order)
    return joined.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
