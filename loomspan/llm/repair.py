"""Token ids as binary shards, compressed by Re-Pair grammars, with random access.

Rule (Larsson and Moffat, "Off-line dictionary-based compression", Proc. IEEE 2000): a
frequent pair of neighbouring ids is replaced by a new id, a nonterminal, and the rule is
stored; again and again, until no pair is frequent.  Here a round takes many pairs at once,
the most frequent first: where two chosen pairs overlap the more frequent one is replaced,
and a pair that loses too many of its places that way is left for a later round.

Each rule's expansion length is stored, and every ``STRIDE`` symbols the place in the
expanded text, so any stretch of ids is decoded without what stands before it.

Scale.  Documents are range-partitioned by id and sorted within a range; a task encodes its
documents in order and writes one file.  A file consists of blocks of at most ``BLOCK`` ids,
each with a grammar of its own, so a task's memory follows the block, not the range or the
longest document: a document that does not end in its block goes on in the next.  The
manifest has one row a block; running totals over tasks, then over a task's blocks, give each
document's place in the whole corpus.  Reading deals out blocks, not files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, slices
from .packing import VOCABULARY, encoder, special_tokens

END_ID = 2
#: Ids of a block, and pairs that one round may replace.
BLOCK = 1 << 22
PAIRS = 16_384
#: A rule must replace so many places; a round that saves less than a part in so many is the last.
LEAST_USES, LEAST_SAVING = 4, 128
#: Symbols between two stored places.
STRIDE = 256
MAGIC = b"REPAIR01"
#: Slots of the table in which a round looks its pairs up.
SLOTS = 1 << 17
MANIFEST = "path string, part int, block int, offset long, bytes long, symbols long, rules long, tokens long, docs long"
DOCUMENT = "id long, start long, n_tokens long, ids_crc32 long, path string, block int"
#: Block head: documents that begin here, rules, symbols, ids, ids of a document from before, first nonterminal, width.
HEAD = "<QQQQQQQ"


class RepairError(ValueError):
    """A file is not what its head and checksums say."""


# --- grammar


def frequent_pairs(keys, most: int, least: int):
    """The up to ``most`` most frequent keys with ``least`` places or more, rarest first."""
    import numpy as np

    ordered = np.sort(keys)
    edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(edge, len(ordered)))
    often = np.flatnonzero(count >= least)
    often = often[np.argsort(count[often], kind="stable")][-most:]
    return ordered[edge[often]]


def slot(keys):
    import numpy as np

    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def ranks(keys, chosen):
    """Rank from 1 of each key among ``chosen`` (rarest first), 0 for others.

    One table look-up a key: of chosen keys that share a slot the more frequent one stands.
    """
    import numpy as np

    table, rank = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
    at = slot(chosen)
    table[at], rank[at] = chosen, np.arange(1, len(chosen) + 1)  # of equal places the last value stays
    found = slot(keys)
    out = rank[found]
    out[table[found] != keys] = 0
    return out


def replaced(rank):
    """Places to replace, no two of them neighbours: a pair yields to a more frequent overlapping one."""
    import numpy as np

    before, after = np.append(0, rank[:-1]), np.append(rank[1:], 0)
    wins = (rank > 0) & (rank >= before) & (rank >= after)
    # neighbours that both win are one pair in a run, aaaa: every second place of the run, from its start
    at = np.flatnonzero(wins)
    if not len(at):
        return at
    begins = np.append(True, np.diff(at) > 1)
    run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def compress(ids, pairs: int = PAIRS, least: int = LEAST_USES):
    """``(first, rules, symbols)``: nonterminal ``first + k`` stands for the two symbols ``rules[k]``.

    Rules refer to ids below ``first`` and to earlier rules only.
    """
    import numpy as np

    symbols = np.asarray(ids, dtype=np.uint32)
    first = int(symbols.max(initial=0)) + 1
    made: list = []
    total = 0
    while len(symbols) > 1:
        keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
        chosen = frequent_pairs(keys, pairs, least)
        if not len(chosen):
            break
        rank = ranks(keys, chosen)
        at = replaced(rank)
        uses = np.bincount(rank[at], minlength=len(chosen) + 1)
        worth = uses >= least
        at = at[worth[rank[at]]]
        if not len(at):
            break
        worth[0] = False
        number = np.cumsum(worth) - 1  # of the rule that a rank gets
        new = chosen[worth[1:]]
        made.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        old = len(symbols)
        symbols = symbols.copy()
        symbols[at] = first + total + number[rank[at]]
        stays = np.ones(old, dtype=bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        total += len(new)
        if len(at) * LEAST_SAVING < old:
            break
    return first, np.concatenate(made) if made else np.zeros((0, 2), np.uint32), symbols


def levels(first: int, rules):
    """Bounds of runs of rules that refer to earlier runs only, so each run can be worked out at once."""
    import numpy as np

    bounds, at = [0], 0
    needs = np.maximum.accumulate(rules.max(axis=1).astype(np.int64) - first) if len(rules) else np.zeros(0)
    while at < len(rules):
        # rules up to the first that needs one of this run
        at = max(at + 1, int(np.searchsorted(needs, at, side="left")))
        bounds.append(at)
    return bounds


def expansion_lengths(first: int, rules):
    import numpy as np

    out = np.zeros(len(rules), dtype=np.int64)
    bounds = levels(first, rules)
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = rules[a:b].astype(np.int64)
        known = np.where(part >= first, out[np.maximum(part - first, 0)], 1)
        out[a:b] = known.sum(axis=1)
    return out


def spread(symbols, first: int, begin, size, flat):
    """Expansions of ``symbols``, side by side: rule k's ids are ``flat[begin[k]:begin[k] + size[k]]``."""
    import numpy as np

    rule = symbols >= first
    which = np.where(rule, symbols.astype(np.int64) - first, 0)
    if not len(size):
        return symbols.astype(np.uint32)
    length = np.where(rule, size[which], 1)
    ends = np.cumsum(length)
    out = np.repeat(symbols.astype(np.uint32), length)
    inside = np.repeat(rule, length)
    source = np.repeat(begin[which] - (ends - length), length)[inside] + np.flatnonzero(inside)
    out[inside] = flat[source]
    return out


class Grammar:
    """A block's rules, worked out: :meth:`expand` turns symbols back into ids."""

    def __init__(self, first: int, rules, size):
        import numpy as np

        self.first, self.size = first, size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.zeros(int(self.size.sum()), dtype=np.uint32)
        bounds = levels(first, rules)
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = spread(rules[a:b].ravel(), first, self.begin, self.size, self.flat)
            if len(part) != self.size[a:b].sum():
                raise RepairError("the rules do not have their lengths")
            self.flat[self.begin[a] : self.begin[a] + len(part)] = part

    def lengths(self, symbols):
        import numpy as np

        rule = symbols >= self.first
        if not len(self.size):
            return np.ones(len(symbols), np.int64)
        return np.where(rule, self.size[np.where(rule, symbols.astype(np.int64) - self.first, 0)], 1)

    def expand(self, symbols):
        return spread(symbols, self.first, self.begin, self.size, self.flat)


# --- blocks


def narrow(symbols, width: int) -> bytes:
    """Symbols of ``width`` bytes each, little-endian."""
    import numpy as np

    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def widen(data, width: int):
    import numpy as np

    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :width] = raw
    return out.view("<u4").ravel()


def block_bytes(ids, names, lengths, continued: int) -> tuple[bytes, int, int]:
    """A block and its numbers of symbols and rules.

    ``ids``: all ids, the first ``continued`` of them of a document that began earlier; ``names`` and
    ``lengths``: the documents that begin here, and how many of their ids stand here.
    """
    import struct
    import zlib

    import numpy as np

    first, rules, symbols = compress(ids)
    size = expansion_lengths(first, rules)
    places = (np.cumsum(spans := Grammar(first, rules, size).lengths(symbols)) - spans)[::STRIDE]
    width = max(1, -(-int(first + len(rules)).bit_length() // 8))
    known = np.array([n is not None for n in names], dtype=np.uint8)
    body = b"".join(
        (
            struct.pack(HEAD, len(names), len(rules), len(symbols), len(ids), continued, first, width), known.tobytes(),
            np.array([n or 0 for n in names], "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(),
            rules.astype("<u4").tobytes(), size.astype("<u4").tobytes(), places.astype("<u8").tobytes(),
            narrow(symbols, width),
        )
    )
    return MAGIC + struct.pack("<QI", len(body), zlib.crc32(body)) + body, len(symbols), len(rules)


class Block:
    """A block read back: ``names``, ``lengths``, ``continued``, ``tokens``, and :meth:`ids` of any stretch."""

    def __init__(self, raw: bytes):
        import struct
        import zlib

        import numpy as np

        head = len(MAGIC) + 12
        if raw[: len(MAGIC)] != MAGIC or len(raw) < head:
            raise RepairError("no block begins here")
        size, check = struct.unpack_from("<QI", raw, len(MAGIC))
        body = memoryview(raw)[head : head + size]
        if len(body) != size or zlib.crc32(body) != check:
            raise RepairError("a block is cut short or damaged")
        docs, rules, symbols, self.tokens, self.continued, first, self.width = struct.unpack_from(HEAD, body)
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int):
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        known = take("u1", docs)
        names = take("<i8", docs)
        self.names = [int(n) if k else None for n, k in zip(names, known, strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        pairs = take("<u4", 2 * rules).reshape(-1, 2)
        self.grammar = Grammar(first, pairs, take("<u4", rules))
        self.places = take("<u8", -(-symbols // STRIDE)).astype(np.int64)
        self.symbols, self.n_symbols = body[at:], symbols
        if len(self.symbols) != symbols * self.width:
            raise RepairError("a block does not have its symbols")

    def ids(self, start: int, stop: int):
        """The ids from ``start`` up to ``stop``: only the symbols around them are expanded."""
        import numpy as np

        start, stop = max(0, start), min(stop, self.tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.places, start, side="right")) - 1
        b = int(np.searchsorted(self.places, stop, side="left"))
        some = widen(self.symbols[a * STRIDE * self.width : min(b * STRIDE, self.n_symbols) * self.width], self.width)
        out = self.grammar.expand(some)
        begin = int(self.places[a])
        if len(out) < stop - begin:
            raise RepairError("a block does not have its ids")
        return out[start - begin : stop - begin]


# --- files


class Writer:
    """Collects documents in order and writes blocks of ``block`` ids; ``rows`` describes them."""

    def __init__(self, out, path: str, part: int, block: int):
        self.out, self.path, self.part, self.block = out, path, part, block
        self.rows: list = []
        self.clear()

    def clear(self):
        self.held, self.names, self.lengths, self.continued, self.size = [], [], [], 0, 0

    def add(self, name, ids):
        self.names.append(name)
        self.lengths.append(0)
        at = 0
        while at < len(ids):
            part = ids[at : at + self.block - self.size]
            self.held.append(part)
            if self.names:
                self.lengths[-1] += len(part)
            else:
                self.continued += len(part)
            self.size += len(part)
            at += len(part)
            if self.size == self.block:
                self.flush()

    def flush(self):
        import numpy as np

        if not self.size:
            return
        ids = np.concatenate(self.held)
        raw, symbols, rules = block_bytes(ids, self.names, self.lengths, self.continued)
        self.rows.append(
            (
                self.path, self.part, len(self.rows), self.out.tell(), len(raw), symbols, rules, len(ids),
                len(self.names),
            )
        )
        self.out.write(raw)
        self.clear()


def write_shards(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Encode every text, in rising order of the id, into files below ``path``; :data:`MANIFEST`, stored.

    Ids equal those of ``tokenizers`` (see :func:`loomspan.llm.packing.encoder`), followed by
    ``end_id``.  Null text: empty.  Null ids stand first; rows that share an id are ordered by a
    hash of the text, and rows that share that too follow each other in any order.  They are dealt
    out by their place in the input, so that no id, however frequent, is one task's alone.  An empty
    table gives an empty manifest.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("hash", F.xxhash64("text"))
    order = ["id", "hash", "place"]
    special = special_tokens(vocabulary)

    def run(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        of = encoder(vocabulary, special)
        store, root = fs.FileSystem.from_uri(path)
        name = f"shard-{uuid.uuid4().hex}.repair"
        out = writer = None
        for batch in slices(batches):
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    out = store.open_output_stream(f"{root}/_{name}", compression=None)
                    writer = Writer(out, name, TaskContext.get().partitionId(), block)
                writer.add(ident, np.append(of(text), np.uint32(end_id)))
        made: list = []
        if writer is not None:
            writer.flush()
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")
            made = writer.rows
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
        cols = list(zip(*made, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
            names=[x.split()[0] for x in MANIFEST.split(", ")],
        )

    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    return materialize(dealt.mapInArrow(run, MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all blocks before.  Totals a task, then a task's blocks."""
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("all").over(line), F.lit(0)).alias("part_at"))
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("own_at", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(
        offsets, "part"
    ).withColumn("start", F.col("part_at") + F.col("own_at"))


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """:data:`DOCUMENT` for each document of the files: ids are decoded and summed up block by block.

    A block's row gives the documents that begin in it; the last of them may go on in the
    following blocks of the file, of which only its own ids are decoded.  A file that does not have
    what its blocks say raises :class:`RepairError`.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    blocks = placed(manifest).select("path", "block", "offset", "bytes", "start").repartition(tasks)

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int32()]
        for batch in batches:
            for r in batch.to_pylist():
                out: list = []
                with store.open_input_file(f"{root}/{r['path']}") as file:
                    file.seek(r["offset"])
                    block = Block(file.read(r["bytes"]))
                    if int(block.lengths.sum()) + block.continued != block.tokens:
                        raise RepairError(f"{r['path']}: block {r['block']} does not have its documents")
                    ids = block.ids(0, block.tokens).astype("<u4")
                    at = block.continued
                    for name, n in zip(block.names, map(int, block.lengths), strict=True):
                        out.append([name, r["start"] + at, n, zlib.crc32(ids[at : at + n]), r["path"], r["block"]])
                        at += n
                    if out:
                        n, out[-1][3] = _rest(file, out[-1][3])
                        out[-1][2] += n
                cols = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
                    names=[x.split()[0] for x in DOCUMENT.split(", ")],
                )

    return blocks.mapInArrow(run, DOCUMENT)


def block_head(file):
    """``(bytes, ids, ids of a document from before)`` of the block at the file's position, None at its end."""
    import struct

    begin, lead = file.tell(), len(MAGIC) + 12
    head = file.read(lead + struct.calcsize(HEAD))
    file.seek(begin)
    if not head:
        return None
    if len(head) < lead + struct.calcsize(HEAD) or head[: len(MAGIC)] != MAGIC:
        raise RepairError("a block is cut short or damaged")
    fields = struct.unpack_from(HEAD, head, lead)
    return lead + struct.unpack_from("<Q", head, len(MAGIC))[0], fields[3], fields[4]


def _rest(file, check: int) -> tuple[int, int]:
    """Number of the ids with which a document goes on from the file's position, and the checksum with them."""
    import zlib

    n = 0
    while (head := block_head(file)) is not None and head[2]:
        block = Block(file.read(head[0]))
        ids = block.ids(0, block.continued).astype("<u4")
        n, check = n + len(ids), zlib.crc32(ids, check)
        if block.names:
            break
    return n, check


def ids_between(file, start: int, stop: int):
    """Random access in one file: its ids from ``start`` up to ``stop``, whatever documents they are of.

    Heads are skipped over until the block of ``start``; of blocks only the symbols around the
    stretch are expanded.
    """
    import numpy as np

    out, at, begin = [], 0, 0
    file.seek(0)
    while at < stop and (head := block_head(file)) is not None:
        size, tokens, _ = head
        if at + tokens > start:
            out.append(Block(file.read(size)).ids(start - at, stop - at))
        begin += size
        file.seek(begin)
        at += tokens
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write shards to the shared folder, read them back, return their documents."""
    path = shared_path(docs.sparkSession, "tokens")
    return read_documents(docs.sparkSession, path, write_shards(docs, path, **options))
