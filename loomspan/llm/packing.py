"""Best-fit packing of token sequences by the sum of squares.

Rule (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the sum-of-squares algorithm
for bin packing", J. ACM 2006): let N(g) be the number of open sequences with residual
gap g.  A piece goes where the sum of N(g)^2 over all gaps becomes smallest, a fresh
sequence being one of the choices; ties go to the smallest gap left.

The rule fixes the place, not the order.  A packer knows all its pieces, so it tries a
few orders (longest first; shuffled above or below a share of the capacity) and keeps the
one with the fewest sequences, stopping at the lower bound.

Scale.  Texts are tokenised where they are read; what moves is one short row a piece.
Packers take ``items_per_packer`` pieces each at most, dealt by hash, so neither a packer's
memory nor its time grows with the input.  What the packers leave in sequences that are
not full is packed again, together, and takes the place of theirs where that makes fewer
sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
ITEMS_PER_PACKER = 40_000
#: Second round: pieces of sequences that are not full, a packer.
ITEMS_PER_REPACKER = 100_000
PIECE = "id long, piece int, start long, length long, crc long"


def vocabulary_file(vocabulary: str, suffix: str) -> str:
    import os

    import public_tokenizers

    return vocabulary + suffix if os.path.exists(vocabulary + suffix) else public_tokenizers.path(vocabulary + suffix)


def special_tokens(vocabulary: str = VOCABULARY) -> list[str]:
    """The strings that ``tokenizers`` turns into special ids."""
    from tokenizers import Tokenizer

    return [
        t.content
        for t in Tokenizer.from_file(vocabulary_file(vocabulary, ".json")).get_added_tokens_decoder().values()
    ]


def encoder(vocabulary: str = VOCABULARY, special: list[str] | None = None):
    """A function from text to uint32 ids, equal to those of ``tokenizers`` with ``<vocabulary>.json``.

    The same vocabulary's ranks in ``tiktoken`` give the same ids several times faster;
    only a text that spells a special token goes through ``tokenizers`` itself.
    ``vocabulary`` is a path without its suffix, or a name the tokenizer folder knows.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    special = special_tokens(vocabulary) if special is None else special
    slow = None
    with open(vocabulary_file(vocabulary, ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str):
        nonlocal slow
        if any(s in text for s in special):
            if slow is None:
                from tokenizers import Tokenizer

                slow = Tokenizer.from_file(vocabulary_file(vocabulary, ".json"))
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    return ids


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, crc[, ids])``: whole texts' ids and an end id 0, cut.

    Null text: empty, one piece with the end id alone.  Repeated rows give repeated pieces.
    """
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    special = special_tokens(vocabulary)

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        ids_of = encoder(vocabulary, special)
        for batch in slices(batches):
            seen: dict = {}
            out: list = []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text not in seen:
                    all_ids = np.append(ids_of(text), 0).astype("<u4")
                    parts = [
                        (k, s, n, zlib.crc32(all_ids[s : s + n].tobytes()))
                        for k, (s, n) in enumerate(cut(len(all_ids), capacity))
                    ]
                    seen[text] = [p + (all_ids[p[1] : p[1] + p[2]].astype("i4"),) for p in parts] if keep_ids else parts
                out += [(ident, *p) for p in seen[text]]
            cols = list(zip(*out, strict=True)) or [()] * (6 if keep_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=False)],
                names=["id", "piece", "start", "length", "crc", "ids"][: len(cols)],
            )

    return src.mapInArrow(run, PIECE + (", ids array<int>" if keep_ids else ""))


def sum_of_squares(lengths, capacity: int = CAPACITY):
    """(sequence, offset) for each length, in the given order."""
    import numpy as np

    count = np.zeros(capacity + 1, dtype=np.int64)  # N(g); a full sequence (gap 0) is closed
    open_at: list = [[] for _ in range(capacity + 1)]
    sequence, offset, made = [], [], 0
    for s in map(int, lengths):
        best = capacity
        if s < capacity:
            # N(g) falls by one, N(g - s) rises by one: the change is 2 (N(g - s) - N(g)) + 2; closing adds no square
            change = count[0 : capacity - s] - count[s:capacity]
            rise = np.where(count[s:capacity] > 0, 2 * change + 2, np.iinfo(np.int64).max)
            if len(rise) and count[s] > 0:
                rise[0] = 1 - 2 * count[s]
            k = int(rise.argmin()) if len(rise) else -1
            if k >= 0 and rise[k] <= 2 * count[capacity - s] + 1:
                best = s + k
        if best == capacity:
            number = made
            made += 1
        else:
            number = open_at[best].pop()
            count[best] -= 1
        left = best - s
        if left:
            open_at[left].append(number)
            count[left] += 1
        sequence.append(number)
        offset.append(capacity - best)
    return sequence, offset


def orders(lengths, capacity: int, seed: int = 0):
    """Orders to take the pieces in: positions, one array for each attempt."""
    import numpy as np

    falling = np.argsort(-lengths, kind="stable")
    mixed = np.random.default_rng(seed).permutation(len(lengths))
    yield falling
    for share in (8, 4, 2, 16):
        bound = capacity // share
        large, small = falling[lengths[falling] >= bound], falling[lengths[falling] < bound]
        yield np.concatenate([large, mixed[lengths[mixed] < bound]])
        yield np.concatenate([mixed[lengths[mixed] >= bound], small])
    yield mixed


def best_of_orders(lengths, capacity: int = CAPACITY):
    """(sequence, offset) in the order of ``lengths``: the best attempt of :func:`orders`."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    least = -(-int(lengths.sum()) // capacity)
    best, number = None, None
    for order in orders(lengths, capacity):
        sequence, offset = sum_of_squares(lengths[order], capacity)
        made = max(sequence, default=-1) + 1
        if best is None or made < number:
            number, best = made, (order, sequence, offset)
        if number <= least:
            break
    order, sequence, offset = best
    out = np.empty((2, len(lengths)), dtype=np.int64)
    out[:, order] = sequence, offset
    return out[0], out[1]


def _dealt(cut_pieces: DataFrame, packers: int, capacity: int, tag: int) -> DataFrame:
    """``cut_pieces`` with sequence_id, offset and the sequence's gap, packed by so many packers."""
    kept = [c for c in cut_pieces.columns if c not in ("sequence_id", "offset", "gap")]
    dealt = cut_pieces.select(
        *kept, F.pmod(F.xxhash64("id", "piece", "crc", F.lit(tag)), F.lit(packers)).cast("long").alias("packer")
    )

    def place(key, rows):
        import numpy as np
        import pyarrow as pa

        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_of_orders(rows["length"].to_numpy(), capacity)
        fill = np.bincount(sequence, weights=rows["length"].to_numpy()).astype(np.int64)
        number = (tag << 60) + (key[0].as_py() << 28) + sequence
        for name, column in (("sequence_id", number), ("offset", offset), ("gap", capacity - fill[sequence])):
            rows = rows.append_column(name, pa.array(column, pa.int64()))
        return rows.drop_columns(["packer"])

    extra = ", ids array<int>" if "ids" in kept else ""
    # Arrow, not pandas: ids beyond 2^53 stay as they are beside a null
    return dealt.groupBy("packer").applyInArrow(place, f"{PIECE}{extra}, sequence_id long, offset long, gap long")


def pack(
    cut_pieces: DataFrame, capacity: int = CAPACITY, items_per_packer: int = ITEMS_PER_PACKER,
    items_per_repacker: int = ITEMS_PER_REPACKER,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    ``cut_pieces`` must be stored (it is read twice).  An empty table gives an empty result.
    """
    packers = max(1, -(-cut_pieces.count() // items_per_packer))
    first = materialize(_dealt(cut_pieces, packers, capacity, 0), "packed")
    out = first
    if packers > 1:
        open_ends = first.where("gap > 0")
        again = materialize(
            _dealt(open_ends, max(1, -(-open_ends.count() // items_per_repacker)), capacity, 1), "repacked"
        )
        sequences = lambda df: df.select("sequence_id").distinct().count()
        if sequences(again) < sequences(open_ends):
            out = first.where("gap = 0").unionByName(again)
        else:
            discard(again)
    return out.drop("gap")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
    text_col: str = "text", items_per_packer: int = ITEMS_PER_PACKER,
) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(materialize(pieces(docs, capacity, vocabulary, id_col, text_col), "pieces"), capacity, items_per_packer)
