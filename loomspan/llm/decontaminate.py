"""Benchmark decontamination by q-gram lemma filtering.

Document texts and benchmark passages are normalised alike: lower case, every run of
characters that are neither letters nor digits becomes one space.  A passage of m
characters is found where a part of the text is within e = m // 10 edits of it.

Filter.  By the q-gram lemma such a part shares m + 1 - q (e + 1) q-grams with the passage
or more, and e edits move a shared q-gram by at most e diagonals.  Shared q-grams are
counted in bands of 2 (2e + 1) diagonals that overlap by half, so some band holds all of
an occurrence; bands below the bound are dropped.  q is 8 for passages of 40 characters
and more, 5 from 10; both leave the bound above zero.  Shorter passages must stand
exactly, between word ends.

Verification.  A region that passes is aligned with the passage inside the band; what
needs more than e edits is dropped.

Scale.  One pass over the documents, each row on its own, whole texts in overlapping
windows of bounded length; nothing is shuffled.  The benchmark goes out in blocks of at
most ``BLOCK_CHARS`` characters and ``BLOCK_ITEMS`` passages, a pass over the documents for
each, so no task holds more than one block: the work is documents times blocks, which for
benchmarks of up to some million characters is one pass.  A block's broadcast lives as long
as the result that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_function

LONG_Q, SHORT_Q, LONG_FROM, SHORT_FROM = 8, 5, 40, 10
BLOCK_CHARS = 4 << 20
#: A region's key holds the passage's number in 20 bits.
BLOCK_ITEMS = 1 << 20
WINDOW = 1 << 18
SPACE, WALL = 32, 1
HIT = "id long, item_id long, start long, end long, distance int, item_length int"


def budget(m: int) -> int:
    return m // 10


def gram(m: int) -> int:
    """The q of a passage's length; 0: too short for the lemma."""
    return LONG_Q if m >= LONG_FROM else SHORT_Q if m >= SHORT_FROM else 0


_codes = None


def code(point: int) -> int:
    """The normalised code of a code point."""
    c = chr(point)
    return ord(c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else SPACE


def code_table():
    """:func:`code` for the basic plane."""
    global _codes
    if _codes is None:
        import numpy as np

        _codes = np.array([code(i) for i in range(1 << 16)], dtype=np.uint32)
    return _codes


def normalise(text: str):
    """(codes, places): normalised code points and where each stood in the text."""
    import numpy as np

    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = code_table()[np.minimum(raw, 0xFFFF)]
    beyond = raw >= 1 << 16
    if beyond.any():
        points, which = np.unique(raw[beyond], return_inverse=True)
        codes[beyond] = np.array([code(int(i)) for i in points], dtype=np.uint32)[which]
    blank = codes == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run stays
    at = np.flatnonzero(keep)
    return codes[at], at


def trimmed(codes):
    """Codes without blanks at the ends."""
    import numpy as np

    at = np.flatnonzero(codes != SPACE)
    return codes[at[0] : at[-1] + 1] if len(at) else codes[:0]


def grams(codes, q: int):
    """Hashes of all q-grams, by doubling."""
    import numpy as np

    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base, one, have, total = 0x9E3779B97F4A7C15, codes.astype(np.uint64) + np.uint64(1), 1, None
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    done, left = 0, q
    while left:
        if left & 1:
            part = one[done : done + n] * power(done)
            total = part if total is None else total + part
            done += have
        left >>= 1
        if left:
            one = one[:-have] + one[have:] * power(have)
            have *= 2
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Postings of a block of passages."""

    def __init__(self, items: list):
        import numpy as np

        self.ids, self.codes, self.tiny = [], [], []
        for ident, text in items:
            c = trimmed(normalise(text)[0]) if text else ()
            if len(c):
                self.ids.append(ident)
                self.codes.append(c)
        sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.sizes, self.edits = sizes, sizes // 10
        self.width = 2 * self.edits + 1
        self.longest = int((sizes + self.edits).max()) if len(sizes) else 0
        self.tables = []
        for q in (LONG_Q, SHORT_Q):
            mine = [i for i, m in enumerate(sizes) if gram(m) == q]
            if mine:
                h = [grams(self.codes[i], q) for i in mine]
                flat, item, pos = np.concatenate(h), np.repeat(mine, [len(x) for x in h]), np.concatenate(
                    [np.arange(len(x)) for x in h]
                )
                order = np.argsort(flat, kind="stable")
                keys, first, count = np.unique(flat[order], return_index=True, return_counts=True)
                bits = np.zeros(1 << 22, dtype=bool)
                bits[keys >> np.uint64(42)] = True
                self.tables.append((q, keys, first, count, item[order], pos[order], bits))
        self.need = sizes + 1 - np.array([gram(m) for m in sizes], dtype=np.int64) * (self.edits + 1)
        self.tiny = [i for i, m in enumerate(sizes) if not gram(m)]
        self.automaton = self._automaton() if self.tiny else None

    def _automaton(self):
        """All tiny passages, with a blank on each side, in one automaton: a text is read once for them all."""
        import ahocorasick

        out, by = ahocorasick.Automaton(), {}
        for i in self.tiny:
            by.setdefault(f" {''.join(map(chr, self.codes[i]))} ", []).append(i)
        for word, items in by.items():
            out.add_word(word, (len(word), items))
        out.make_automaton()
        return out

    def regions(self, codes, doc_of):
        """(doc, item, band, example diagonal) of the bands that meet the bound."""
        import numpy as np

        for q, keys, first, count, item, pos, bits in self.tables:
            h = grams(codes, q)
            at = np.flatnonzero(bits[h >> np.uint64(42)])
            k = np.searchsorted(keys, h[at])
            k[k == len(keys)] = 0
            ok = keys[k] == h[at]
            at, k = at[ok], k[ok]
            if not len(at):
                continue
            n = count[k]
            post = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, what = np.repeat(at, n), item[post]
            diagonal = at - pos[post]
            # codes may lie before the text's start: bands are counted from a whole number of widths below it
            band = (diagonal + 4 * self.longest * self.width[what]) // self.width[what]
            key = (doc_of(at).astype(np.uint64) << np.uint64(44)) | (what.astype(np.uint64) << np.uint64(24))
            order = np.lexsort((band, key))
            key, band, diagonal, what, at = key[order], band[order], diagonal[order], what[order], at[order]
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
            c = np.diff(np.append(edge, len(key)))
            key, band, what = key[edge], band[edge], what[edge]
            both = c.copy()
            joined = np.flatnonzero((key[1:] == key[:-1]) & (band[1:] == band[:-1] + 1))
            both[joined] += c[joined + 1]
            for r in np.flatnonzero(both >= self.need[what]):
                last = edge[r] + c[r] + (c[r + 1] if both[r] > c[r] else 0)
                d, t = diagonal[edge[r] : last], at[edge[r] : last]
                # the lemma's q-grams stand at as many places of the passage, and of the text
                if min(len(np.unique(t - d)), len(np.unique(t))) < self.need[what[r]]:
                    continue
                seen, many = np.unique(d, return_counts=True)
                yield int(key[r] >> np.uint64(44)), int(what[r]), int(
                    band[r] - 4 * self.longest
                ) * int(self.width[what[r]]), int(seen[many.argmax()])


def banded(pattern, text, low: int, high: int, limit: int, anchored: bool = False):
    """Least edits of the whole pattern against a part of the text that starts on a diagonal
    low..high, and where that part ends; None beyond ``limit``.  ``anchored``: it starts on
    diagonal 0 exactly.

    Cells off the band by more than ``limit`` cannot matter.  Row i holds D(i, i + k) for the
    band's diagonals k; what exceeds the limit everywhere in a row ends the search.
    """
    import numpy as np

    low, high = low - limit, high + limit
    size, pad = high - low + 1, len(pattern) + abs(low) + abs(high) + 2
    # beyond its ends the text is a wall: a character set against it costs what leaving it out costs
    padded = np.full(len(text) + 2 * pad, WALL, dtype=np.int64)
    padded[pad : pad + len(text)] = text
    k = np.arange(low, high + 1)
    start = np.where(k >= 0, k, 1 << 20) if anchored else np.zeros(size, dtype=np.int64)
    row = start - k  # D minus its column: an insertion then changes nothing, and a running minimum makes them all
    for i, c in enumerate(pattern.tolist()):
        new = row + (padded[pad + low + i : pad + low + i + size] != c)
        np.minimum(new[:-1], row[1:] + 2, out=new[:-1])
        row = np.minimum.accumulate(new)
        if i % 16 == 15 and (row + k).min() > limit:
            return None
    row = row + k
    best = int(row.argmin())
    return (int(row[best]), min(len(text), int(k[best]) + len(pattern))) if row[best] <= limit else None


def find(index: Index, texts: list):
    """(text number, passage number, start, end, edits) of all occurrences; positions are the original text's."""
    import numpy as np

    parts = [normalise(t) if t else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)) for t in texts]
    sizes = np.array([len(c) for c, _ in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a wall after every text
    whole = np.full(begin[-1], WALL, dtype=np.uint32)
    for b, (c, _) in zip(begin, parts, strict=False):
        whole[b : b + len(c)] = c
    out: dict = {}
    overlap = index.longest + LONG_Q
    for lo in range(0, len(whole), WINDOW):
        codes = whole[lo : lo + WINDOW + overlap]
        for d, i, band, diagonal in index.regions(codes, lambda at: np.searchsorted(begin, at + lo, side="right") - 1):  # noqa: B023
            item, m, e = index.codes[i], int(index.sizes[i]), int(index.edits[i])
            text = parts[d][0]
            x = diagonal + lo - begin[d]
            if 0 <= x <= len(text) - m and (text[x : x + m] == item).all():
                out.setdefault((d, i), set()).add((0, int(x), int(x + m)))
                continue
            low = band + lo - int(begin[d])
            high = low + 2 * int(index.width[i]) - 1
            left = max(0, low - e)
            region = text[left : max(left, high + m + 2 * e + 1)]
            got = banded(item, region, low - left, high - left, e)
            if got:
                edits, end = got
                back = banded(item[::-1], region[:end][::-1], 0, 0, edits, anchored=True)
                out.setdefault((d, i), set()).add((edits, left + end - (back[1] if back else m), left + end))
    if index.automaton is not None:
        for d, (c, _) in enumerate(parts):
            for end, (size, items) in index.automaton.iter(f" {''.join(map(chr, c))} ") if len(c) else ():
                for i in items:
                    out.setdefault((d, i), set()).add((0, end + 1 - size, end - 1))
    for (d, i), found in sorted(out.items()):
        taken: list = []
        for edits, s, t in sorted(found):  # of overlapping finds the closest stays
            if all(t <= a or s >= b for a, b in taken):
                taken.append((s, t))
                place = parts[d][1]
                yield d, i, int(place[s]), int(place[t - 1]) + 1, edits


def _block(docs: DataFrame, items: list) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        import pyarrow as pa

        index = Index(held.value)
        for batch in slices(batches):
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            distinct = list(dict.fromkeys(texts))
            where = {t: k for k, t in enumerate(distinct)}
            by: dict = {}
            for d, i, s, t, edits in find(index, distinct):
                by.setdefault(d, []).append((index.ids[i], s, t, edits, int(index.sizes[i])))
            rows = [(ident, *hit) for ident, text in zip(ids, texts, strict=True) for hit in by.get(where[text], ())]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)],
                names=[x.split()[0] for x in HIT.split(", ")],
            )

    return docs.mapInArrow(run, HIT)


def blocks(
    benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
    block_items: int = BLOCK_ITEMS,
):
    """The benchmark's (item, text) in lists of at most so many characters and passages; one empty list where there are none."""
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where(F.length("text") > 0)
    block, held = [], 0
    for r in items.toLocalIterator():
        if block and (held + len(r.text) > block_chars or len(block) >= block_items):
            yield block
            block, held = [], 0
        block.append((r.item, r.text))
        held += len(r.text)
    yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row for each occurrence of a benchmark passage in a document.

    ``start`` and ``end`` are code points of the original text.  Null or empty texts and
    passages match nothing; passages without a letter or digit neither.  Repeated documents
    and repeated passages give a row each.  Null ids stay null.
    """
    src = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        part = _block(src, block)
        out = part if out is None else out.union(part)
    return out


def holds_passage(
    benchmark: DataFrame, text: Column, item_col: str = "item_id", item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> Column:
    """Whether a text holds a passage of the benchmark: a verdict for each row, whatever its id."""
    sc = benchmark.sparkSession.sparkContext

    def verdict(held):
        def make():
            index = Index(held.value)

            def of(texts):
                bad = {d for d, *_ in find(index, [t or "" for t in texts])}
                return [k in bad for k in range(len(texts))]

            return of

        return text_function(make, "boolean")(text)

    out = F.lit(False)
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        out = out | verdict(sc.broadcast(block))
    return out
