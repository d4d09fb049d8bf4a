"""Which texts hold which names, by signature: one scan of the texts, however many names.

A name's signature is one of its substrings of 3, 6, 12 or 24 bytes (the longest that fits), of all
the one that is rarest among the names.  A task looks the substrings of its texts up among the
signatures, all places of a batch at once, and only where one stands the name itself is compared.

Names lie in block files of about ``BLOCK_BYTES`` in the shared folder, dealt by hash, written and
read by the executors.  A task takes a group of texts (``GROUP_BYTES``) and lets all blocks pass by,
one in memory at a time.  So neither names nor texts go through the driver, nothing is broadcast,
and texts are neither shuffled nor multiplied; what leaves a task is one row a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.paths import scratch

BLOCK_BYTES, GROUP_BYTES, CHUNK = 8 << 20, 16 << 20, 4 << 20
#: Lengths of signatures; each is made of two of the length before.
SIZES = (3, 6, 12, 24)
#: Slots of the first look-up.
BITS = 20


def normalised(c: Column) -> Column:
    """Case and runs of white space do not matter."""
    return F.regexp_replace(F.lower(c.cast("string")), r"\s+", " ")


def grams(data, size: int):
    """64-bit hashes of all substrings of ``size`` bytes."""
    import numpy as np

    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = data.astype(np.uint64)
    h = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
    h *= np.uint64(0x9E3779B97F4A7C15)
    half = SIZES[0]
    while half < size:
        h = (h[:-half] ^ (h[:-half] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[half:] * np.uint64(0x94D049BB133111EB)
        half *= 2
    return h


def slot(h):
    import numpy as np

    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


class Names:
    """A block of names, ready to be looked for: ``sizes`` of signatures and the names below three bytes."""

    def __init__(self, ids: list, names: list[bytes]):
        import numpy as np

        self.ids, self.names = ids, names
        self.short = [k for k, n in enumerate(names) if len(n) < SIZES[0]]
        self.by_size = []
        for low, high in zip(SIZES, (*SIZES[1:], None), strict=True):
            own = np.array([k for k, n in enumerate(names) if len(n) >= low and (high is None or len(n) < high)], np.int64)
            if not len(own):
                continue
            lengths = np.array([len(names[k]) for k in own])
            starts = np.cumsum(lengths) - lengths
            h = grams(np.frombuffer(b"".join(names[k] for k in own), np.uint8), low)
            place = np.arange(len(h))
            name = np.searchsorted(starts, place, side="right") - 1
            inside = place + low <= starts[name] + lengths[name]
            h, place, name = h[inside], place[inside], name[inside]
            _, which, often = np.unique(h, return_inverse=True, return_counts=True)
            order = np.lexsort((place, often[which], name))
            first = order[np.append(True, name[order][1:] != name[order][:-1])]
            key, offset = h[first], place[first] - starts
            by_key = np.argsort(key, kind="stable")
            table = np.zeros(1 << BITS, bool)
            table[slot(key)] = True
            self.by_size.append((low, table, key[by_key], own[by_key], offset[by_key], lengths[by_key]))

    def found(self, data, starts):
        """(row, name) numbers, each pair once: the names in the rows of a buffer."""
        import numpy as np

        pairs = set()
        raw = data.tobytes()
        for size, table, keys, own, offsets, lengths in self.by_size:
            for at in range(0, max(1, len(data)), CHUNK):
                h = grams(data[at : at + CHUNK + size - 1], size)
                place = np.flatnonzero(table[slot(h)])
                h = h[place]
                left = np.searchsorted(keys, h, side="left")
                n = np.searchsorted(keys, h, side="right") - left
                hit = n > 0
                place, left, n = place[hit] + at, left[hit], n[hit]
                # names that share a signature are candidates each
                at_name = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(place, n) - offsets[at_name]
                row = np.searchsorted(starts, np.repeat(place, n), side="right") - 1
                fits = (begin >= starts[row]) & (begin + lengths[at_name] <= starts[row + 1])
                for r, b, k in zip(row[fits].tolist(), begin[fits].tolist(), own[at_name[fits]].tolist(), strict=True):
                    if (r, k) not in pairs and raw.startswith(self.names[k], b):
                        pairs.add((r, k))
        for r in range(len(starts) - 1):
            for k in self.short:
                if raw.find(self.names[k], starts[r], starts[r + 1]) >= 0:
                    pairs.add((r, k))
        return sorted(pairs)


def write_names(names: DataFrame, path: str, block_bytes: int) -> int:
    """``(i, n)`` as block files below ``path``; how many blocks there may be."""
    total = names.agg(F.coalesce(F.sum(F.octet_length("n") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))

    def run(key, part):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/_{uuid.uuid4().hex}"
        part = part.select(["i", "n"]).combine_chunks()
        with store.open_output_stream(name, compression=None) as out, pa.ipc.new_file(out, part.schema) as file:
            file.write_table(part)
        store.move(name, f"{root}/{key[0].as_py()}.arrow")
        return pa.table({"block": [key[0].as_py()]})

    written = names.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks))).groupBy("block").applyInArrow(run, "block long")
    written.write.format("noop").mode("overwrite").save()
    return blocks


def containment(
    texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_id: str, name_col: str,
    block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``(id, name id)`` where a text holds a name; case and runs of white space do not matter.

    Null texts hold nothing and null names stand nowhere; an empty name stands in every text.  Rows
    that share an id are texts each; names that share a text are names each.
    """
    spark = texts.sparkSession
    path = scratch(spark, "names")
    book = names.where(F.col(name_col).isNotNull()).select(F.col(name_id).alias("i"), normalised(F.col(name_col)).alias("n"))
    blocks = write_names(book, path, block_bytes)
    id_type, name_type = texts.schema[id_col].dataType.simpleString(), names.schema[name_id].dataType.simpleString()
    base = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        held: dict = {}

        def block(k: int):
            if k not in held:
                held.clear()
                held[k] = None
                name = f"{root}/{k}.arrow"
                if store.get_file_info(name).type != fs.FileType.NotFound:
                    with store.open_input_file(name) as f:
                        t = pa.ipc.open_file(f).read_all().combine_chunks()
                    held[k] = t["i"], Names(None, [x.encode() for x in t["n"].to_pylist()])
            return held[k]

        def hits(group):
            t = pa.Table.from_batches(group).combine_chunks()
            texts = t["t"].combine_chunks()
            parts = [x.as_buffer() for x in texts]
            starts = np.cumsum([0, *[p.size for p in parts]])
            data = np.frombuffer(b"".join(parts), np.uint8)
            for k in range(blocks):
                if (there := block(k)) is None:
                    continue
                pairs = there[1].found(data, starts)
                rows, found = (pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [t["id"].combine_chunks().take(rows), there[0].combine_chunks().take(found)], names=["id", "name"]
                )

        group, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 400):
                group.append(b.slice(at, 400))
                size += group[-1].nbytes
                if size >= group_bytes:
                    yield from hits(group)
                    group, size = [], 0
        if group:
            yield from hits(group)

    return base.mapInArrow(run, f"id {id_type}, name {name_type}").toDF(id_col, name_id)
