"""SimHash near-duplicate detection through a segment-popcount embedding.

Method.  A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is
the vector of the segments' bit counts (0, 1 or 2).  The Manhattan distance of two
embeddings is a lower bound of the Hamming distance of the fingerprints, since a
segment whose counts differ by ``k`` differs in ``k`` bits at least.

Grid join.  The 32 axes are dealt to G groups.  Two points within Manhattan distance 4 can
differ in 4 groups at most, so they share a cell of at least one of the C(G, 4) grids that
each leave out 4 groups.  Every distinct fingerprint goes to its cell in each grid; cells
are joined by key, the Manhattan bound and the exact Hamming distance are the join's
condition, and a pair is emitted in the first of the grids it shares only.  What the join
emits is therefore links and nothing else, and all of them whatever G is.

Choice of G.  More groups mean more rows a fingerprint and fewer tests a row: a cell's key
carries 1.5 bits a segment kept.  :func:`groups_for` takes the G whose rows and expected
tests cost least together for the number of fingerprints there are, a shuffled row counting
as ``ROW_TESTS`` tests: 6 groups (15 rows) up to a million, 8 (70 rows) up to some hundred
millions, 10 (210 rows) up to ten billions, then 12 (495 rows).

Scale.  Equal texts meet as one fingerprint before any join, so groups of copies cost
one row however large they are; a fingerprint that many rows share is joined back by
broadcast, not by shuffling its rows to one task.  Components are found by hooking and
contracting links between distinct fingerprints; nothing is collected.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    ASCII_LOWER, broadcast_if_small, discard, fresh, join_by_group, materialize, merge_if_long, row_hash, text_function,
)

SEED = 42
MAX_BITS = 4
SHINGLE = 4
SEGMENTS = 32
#: Numbers of groups to choose from, and how many tests of a pair take the time of a shuffled row.
GROUPS = (6, 8, 10, 12)
ROW_TESTS = 12
#: Entropy of the bit count of two random bits.
SEGMENT_BITS = 1.5


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint (a long) of each row's whole text.

    A-Z lower-cased; words are runs without ASCII white space; ``shingle`` words a shingle,
    repeats count.  Fewer words than that: the whole sequence is one shingle.  Null, empty or
    blank text: 0.
    """

    def make():
        import re

        import numpy as np
        import xxhash

        words_of = re.compile("[^ \t-\r]+").findall
        digest = xxhash.xxh64_intdigest

        def fp(text):
            words = words_of(text.translate(ASCII_LOWER)) if text else ()
            if not words:
                return 0
            n = max(1, len(words) - shingle + 1)
            # a long text goes through in slices, so that its bit matrix stays small
            ones = np.zeros(64, dtype=np.int64)
            for lo in range(0, n, 16384):
                h = np.array(
                    [digest(" ".join(words[i : i + shingle]), SEED) for i in range(lo, min(n, lo + 16384))], dtype="<u8"
                )
                ones += np.unpackbits(
                    h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
                ).sum(axis=0, dtype=np.int64)
            return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])

        return lambda texts: list(map(fp, texts))

    return text_function(make, "long")(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp long)`` per row of ``docs``; null ids stay null."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), fingerprint(F.col(text_col).cast("string"), shingle).alias("fp")
    )


def embedding(fp):
    """The 32 two-bit segment counts, packed two bits each into one long."""
    odd = F.lit(0x5555555555555555)
    low = fp.bitwiseAND(odd)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    # a half adder in each pair of bits: 0 + 0 = 00, 0 + 1 = 01, 1 + 1 = 10
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def manhattan(a, b):
    """Manhattan distance of two packed embeddings with counts 0..2.

    01 against 00 or 10 is a distance of 1, 00 against 10 of 2.  In the exclusive or
    these are 01 or 11 (distance 1) and 10 (distance 2).
    """
    x = a.bitwiseXOR(b)
    odd = F.lit(0x5555555555555555)
    low = x.bitwiseAND(odd)
    high = F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    both = low.bitwiseAND(high)
    return F.bit_count(low) + 2 * F.bit_count(high) - 2 * F.bit_count(both)


def _long(n: int) -> int:
    """An unsigned 64-bit mask as a signed long."""
    return n - (1 << 64) if n >> 63 else n


def groups_for(points: int) -> int:
    """The number of groups with the least cost for so many fingerprints."""
    rows = lambda g: comb(g, MAX_BITS)
    cost = lambda g: rows(g) * (ROW_TESTS + points / 2 ** (SEGMENT_BITS * SEGMENTS * (g - MAX_BITS) / g))
    return min(GROUPS, key=cost)


def _masks(groups: int) -> list[int]:
    """Mask in the embedding of each group's segments."""
    return [_long(sum(3 << (2 * i) for i in range(SEGMENTS) if i * groups // SEGMENTS == g)) for g in range(groups)]


def _grids(groups: int) -> list[tuple[int, int]]:
    """(groups of a grid as a bit mask, mask of their segments in the embedding)."""
    masks = [m & (1 << 64) - 1 for m in _masks(groups)]
    return [
        (sum(1 << g for g in keep), _long(sum(masks[g] for g in keep)))
        for keep in combinations(range(groups), groups - MAX_BITS)
    ]


def links(fps: DataFrame, groups: int | None = None) -> DataFrame:
    """``(a, b)``, a < b: pairs of distinct fingerprints that differ in 1 to 4 bits.

    ``fps``: one column ``fp``; nulls are left out, repeats count once.  ``groups``: see
    :func:`groups_for`; by default chosen by the count.  Both sides of the join are the same
    (fp, grid, cell) rows, so that one shuffle serves both; the embedding is a few bit
    operations and is made again where a pair is tested.
    """
    points = fps.where("fp IS NOT NULL").select("fp").distinct()
    groups = groups or groups_for(points.count())
    grids = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(m).alias("m")) for g, m in _grids(groups)])
    cells = points.select("fp", F.explode(grids).alias("grid")).select(
        "fp", F.col("grid.g").alias("g"), embedding(F.col("fp")).bitwiseAND(F.col("grid.m")).alias("cell")
    )
    a = cells.select(F.col("fp").alias("a"), F.col("g").alias("ga"), F.col("cell").alias("ca"))
    b = cells.select(F.col("fp").alias("b"), F.col("g").alias("gb"), F.col("cell").alias("cb"))
    ea, eb, g = embedding(F.col("a")), embedding(F.col("b")), F.col("ga")
    # the pair's own grid is that of its first equal groups: no group below the grid's last one
    # that the grid leaves out is equal too
    smear = g
    for k in (1, 2, 4, 8):
        smear = smear.bitwiseOR(F.shiftright(smear, k))
    left_out = F.shiftright(smear, 1).bitwiseAND(F.bitwise_not(g))
    x = ea.bitwiseXOR(eb)
    first = F.lit(True)
    for k, mask in enumerate(_masks(groups)):
        first = first & ~((left_out.bitwiseAND(F.lit(1 << k)) != 0) & (x.bitwiseAND(F.lit(mask)) == 0))
    on = (
        (F.col("ga") == F.col("gb"))
        & (F.col("ca") == F.col("cb"))
        & (F.col("a") < F.col("b"))
        & (manhattan(ea, eb) <= MAX_BITS)
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        & first
    )
    # the optimizer takes the rows of a point for one: without the hint it would broadcast them
    return a.hint("merge").join(b.hint("merge"), on).select("a", "b")


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``(node, root)`` for every node that has a link.

    ``nodes`` (node, label not null): a component's root is its smallest label.
    ``pairs`` (a, b).  Each round hooks every node to its smallest neighbour, follows the
    hooks to their ends by doubling, and contracts the links: those inside a tree and
    repeats go, so a dense group costs its links once and next to nothing afterwards.
    Rounds are written to the shared folder.
    """
    lab = nodes.select("node", "label")
    known = merge_if_long(lab, lab.count())
    left, right = known.select(
        F.col("node").alias("a"), F.col("label").alias("u")
    ), known.select(F.col("node").alias("b"), F.col("label").alias("v"))
    edges = materialize(
        pairs.select("a", "b").join(left, "a").join(right, "b").select("u", "v").where("u <> v").distinct(), "links"
    )
    roots = None
    for _ in range(max_rounds):
        ends = edges.select(
            F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        hooks = materialize(
            ends.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("root")), "hooks"
        )
        trees = hooks.count()
        for _ in range(max_rounds):
            up = merge_if_long(hooks, trees).select(F.col("u").alias("root"), F.col("root").alias("far"))
            before, hooks = hooks, materialize(
                hooks.join(up, "root").select(
                    "u", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")
                ),
                "hooks",
            )
            discard(before)
            if not hooks.where("moved").limit(1).count():
                break
        to = merge_if_long(hooks, trees).select("u", "root")
        further = to.select(F.col("u").alias("root"), F.col("root").alias("far"))
        before, roots = roots, materialize(
            to if roots is None else roots.join(further, "root", "left").select(
                "u", F.coalesce("far", "root").alias("root")
            ),
            "roots",
        )
        discard(before)
        at_u, at_v = to.select("u", F.col("root").alias("x")), to.select(
            F.col("u").alias("v"), F.col("root").alias("y")
        )
        before, edges = edges, materialize(
            edges.join(at_u, "u").join(at_v, "v").where("x <> y").select(
                F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")
            ).distinct(),
            "links",
        )
        discard(before, hooks)
        if not edges.limit(1).count():
            return lab.join(roots, F.col("label") == F.col("u")).select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    Fingerprints link at 4 or fewer differing bits; equal ones always do.
    ``component_id`` is the smallest id that can be reached, the row's own included; rows
    whose id is null get the component's smallest id, or null where no member has one.
    Repeated rows give repeated result rows.  An empty table gives an empty result.
    """
    marks = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return with_components(marks).select(
        "id", "fp", F.when(F.col("root.k") == 0, F.col("root.v")).alias("component_id")
    )


def with_components(marks: DataFrame) -> DataFrame:
    """Stored rows with ``id`` and ``fp`` (and more columns), and the ``root`` of their component.

    ``root`` is (0, smallest id), or (1, smallest fingerprint) where no member has an id.
    """
    groups = materialize(marks.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "groups")
    pairs = materialize(links(groups.select("fp")), "pairs")
    # (0, id) sorts before (1, fp): a component with any id is named by an id
    label = F.when(
        F.col("first").isNotNull(), F.struct(F.lit(0).alias("k"), F.col("first").alias("v"))
    ).otherwise(F.struct(F.lit(1).alias("k"), F.col("fp").alias("v")))
    reach = components(
        groups.select(F.col("fp").alias("node"), label.alias("label")), pairs
    ).withColumnRenamed("root", "far")
    named = materialize(
        groups.join(reach, groups.fp == reach.node, "left").select("fp", "n", F.coalesce("far", label).alias("root")),
        "named",
    )
    discard(groups, pairs)
    return join_by_group(marks, named, "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`.

    The row with the smallest id stays; null ids come last, rows of one id are ordered by a
    hash of all their columns, and of rows that agree in all columns one stays.  So a row is
    judged by its own text: rows of one id with different texts are rows of their own.
    """
    row = row_hash(docs)
    marks = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("id"), row.alias("row"),
            fingerprint(F.col(text_col).cast("string")).alias("fp"),
        ),
        "marks",
    )
    found = materialize(with_components(marks).select("id", "row", "root"), "roots")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "row")
    kept = found.groupBy("root").agg(F.min(order).alias("k"), F.count("*").alias("n"))
    # components of one row lose nothing and are left out of what follows
    lost = materialize(kept.where("n > 1"), "lost")
    rest = materialize(
        join_by_group(found, lost, "root").select(
            "id", "row", F.col("k.id").eqNullSafe(F.col("id")) & (F.col("k.row") == F.col("row"))
        ).toDF("id", "row", "stays"),
        "members",
    )
    gone = materialize(rest.where("NOT stays").select("id", "row").distinct(), "gone")
    twice = materialize(
        rest.where("stays").groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1").select("id", "row"),
        "repeated",
    )
    discard(marks, found, rest, lost)
    out = without_rows(docs, gone, id_col)
    if not twice.limit(1).count():
        return out
    again, same = named_rows(docs, twice, id_col)
    return out.join(again, same, "left_anti").unionByName(
        materialize(docs.join(again, same, "left_semi").distinct(), "once")
    )


def named_rows(docs: DataFrame, named: DataFrame, id_col: str):
    """The stored rows (id, row) of ``named`` under names that ``docs`` lacks, and the condition to meet them."""
    ident, row = fresh(docs, "__id"), fresh(docs, "__row")
    there = broadcast_if_small(named).withColumnsRenamed({"id": ident, "row": row})
    return there, F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & (row_hash(docs) == F.col(row))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows named by ``gone``: stored (id, row), ``row`` being :func:`row_hash`."""
    named, same = named_rows(docs, gone, id_col)
    return docs.join(named, same, "left_anti")


def hex16(fp):
    """A long as 16 lower-case hexadecimal digits, unsigned."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
