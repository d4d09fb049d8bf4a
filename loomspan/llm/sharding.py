"""Sharding by sampled splitters.  Native.

Law ``bytes``: the shards' sizes are near equal.  Rows are ordered by the key (hash of
the text, hash of the id).  A sample of keys, drawn with a probability in proportion to
the row's size, gives quantile boundaries; rows are partitioned into ranges between
them, and ranges that came out overfull are subdivided by splitters from a denser sample
of their own.  Exact sizes of all ranges then give each row its exact place on one line
of bytes, and the line is cut into equal shards.

Equal texts share the first part of the key and so lie side by side.  A splitter is kept
clear of a run of equal texts unless the run holds several splitters itself, as a group
of copies with a third of all rows does; such a group is cut by the second part of the
key.  A group that fits in a fiftieth of a shard is not split
between shards.

Scale.  No text is shuffled: what moves is (id, size, checksum, two hashes).  Ranges are
as many as the rows need (``range_rows`` each), up to ``MAX_RANGES``; beyond that many rows
ranges grow and their sorts spill.  Overfull ranges are subdivided, and looked at again, until
none is left or nothing more can be cut: rows that agree in id and text have one key.
Splitters (twice ``MAX_RANGES`` at most), a sample of ``SAMPLES_PER_RANGE`` keys for each,
range totals and shard starts are all that the driver sees or broadcasts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
RANGES_PER_SHARD = 8
RANGE_ROWS = 500_000
#: Bounds of what the driver sees: ranges, and sampled keys for each of them.
MAX_RANGES = 20_000
SAMPLES_PER_RANGE = 24
OVERFULL = 2.0
ROUNDS = 6


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, crc, h1, h2)``: size is the text's UTF-8 bytes plus 16, null: 16."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    # two seeds' worth of mixing: the second hash orders equal texts and draws the sample
    return docs.select(
        ident.alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(ident, F.lit("order")).alias("h2"),
    )


def draw(rows: DataFrame, rate: float) -> list[tuple[int, int]]:
    """Sampled keys: a row is drawn with probability min(1, rate * size), by its own hash."""
    u = F.shiftrightunsigned(F.xxhash64("id", "h1", F.lit("draw")), 11) / F.lit(float(1 << 53))
    return sorted((r.h1, r.h2) for r in rows.where(u < F.col("size") * F.lit(rate)).select("h1", "h2").collect())


def boundaries(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of a sorted size-weighted sample.

    A boundary in a run of equal first keys moves to the run's start, except that further
    boundaries in the same run stay where they are: that run is larger than a range.
    """
    low = -(1 << 63)
    picked = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    out = []
    for h1, h2 in picked:
        out.append((h1, h2) if out and out[-1][0] == h1 else (h1, low))
    return sorted(set(out))


def range_of(splitters: list[tuple[int, int]]):
    """Number of splitters at or below (h1, h2): a binary search in one constant array."""
    if not splitters:
        return F.lit(0)
    keys = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in splitters])), "array<struct<a:long,b:long>>")
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    key = F.struct(F.col("h1").alias("a"), F.col("h2").alias("b"))
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, s: F.when(F.get(keys, at + s - 1) <= key, at + s).otherwise(at),
    )


def splitters_for(
    rows: DataFrame, total: int, largest: int, ranges: int, oversample: int = SAMPLES_PER_RANGE,
    overfull: float = OVERFULL, rounds: int = ROUNDS,
) -> list[tuple[int, int]]:
    """Boundaries of about ``ranges`` ranges of equal bytes, overfull ones subdivided until none is left.

    ``rows``: stored (h1, h2, size, id).  A range is overfull above ``overfull`` times its share, or
    the largest row where that is more.  Each round draws eight times as dense a sample, of the
    overfull ranges only.
    """
    rate, fair = ranges * oversample / max(total, 1), total / ranges
    splitters = boundaries(draw(rows, rate), ranges)
    for k in range(1, rounds + 1):
        placed = rows.withColumn("range", range_of(splitters))
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        fat = sizes.where((F.col("bytes") > overfull * max(fair, largest)) & (F.col("n") > 1)).collect()
        room = 2 * MAX_RANGES - len(splitters)
        if not fat or room <= 0:
            break
        much = sum(r.bytes for r in fat)
        over = draw(
            placed.where(F.col("range").isin([r.range for r in fat])), min(rate * 8**k, oversample * MAX_RANGES / much)
        )
        cuts = set(boundaries(over, max(2, round(2 * much / fair)))) | ({over[len(over) // 2]} if over else set())
        more = sorted({*splitters, *sorted(cuts - {*splitters})[:room]})
        if more == splitters:
            break
        splitters = more
    return splitters


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``(id, size, crc, shard, slot)`` for every row: shards of near equal bytes.

    ``slot`` runs from 0 without gaps in each shard.  Null ids and texts are rows like any
    other.  Rows that agree in id and text are told apart by nothing and take neighbouring
    slots in any order.  An empty table gives an empty result; with fewer rows than
    shards some shards stay empty.
    """
    rows = materialize(keyed(docs, id_col, text_col), "keys")
    n, total, largest = rows.agg(
        F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))
    ).first()
    ranges = max(1, min(MAX_RANGES, max(shards * ranges_per_shard, n // range_rows)))
    placed = rows.withColumn("range", range_of(splitters_for(rows, total, largest, ranges)))
    within = Window.partitionBy("range")
    order = within.orderBy("h1", "h2", "id")
    local = materialize(
        placed.select(
            "id", "size", "crc", "range",
            (F.row_number().over(order) - 1).cast("long").alias("place"),
            (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
            F.sum("size").over(Window.partitionBy("range", "h1")).alias("group_bytes"), "h1",
        ).withColumn("group_start", F.min("before").over(Window.partitionBy("range", "h1"))),
        "ranges",
    )
    # one row a range, 2 * MAX_RANGES + 1 at most: offsets on the line of all rows
    totals = local.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    line = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("range").alias("r"), F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("bytes_at"),
        F.coalesce(F.sum("rows").over(line), F.lit(0)).alias("rows_at"),
    )
    whole = F.col("group_bytes") <= total // (50 * shards)
    middle = F.when(
        whole, 2 * F.col("group_start") + F.col("group_bytes")
    ).otherwise(2 * F.col("before") + F.col("size")) + 2 * F.col("bytes_at")
    # whole numbers: the middle of the group (or row) on the line picks the shard
    number = F.least(
        F.lit(shards - 1),
        F.expr(f"CAST(m * CAST({shards} AS DECIMAL(10, 0)) AS DECIMAL(38, 0)) div {2 * max(total, 1)}"),
    ).cast("int")
    on_line = local.join(F.broadcast(offsets), F.col("range") == F.col("r")).withColumn("m", middle.cast("decimal(25,0)")).select(
        "id", "size", "crc", number.alias("shard"), (F.col("rows_at") + F.col("place")).alias("row")
    )
    on_line = materialize(on_line, "line")
    starts = on_line.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "s")
    return on_line.join(F.broadcast(starts), F.col("shard") == F.col("s")).select(
        "id", "size", "crc", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
