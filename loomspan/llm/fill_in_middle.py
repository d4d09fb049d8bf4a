"""Fill-in-middle transformation of whole texts, a batch at a time.

A text is cut into units (lines, words or characters); two cuts between units split it into
prefix, middle and suffix, which are put together again behind three marks, in the order
prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``).

The kernel works on the UTF-8 buffer of an Arrow batch, all texts of it at once: a table
gives each byte's class, the classes of two neighbouring bytes say where a unit begins, one
running sum counts the beginnings (a text's own count is the sum less the sum before the
text), and one binary search in that sum finds the cuts of all rows.  No text is walked
through in Python.

Scale.  A map over rows: nothing is shuffled.  Cuts depend on the id and the text alone, by
hashes made in the JVM, so a task that runs again gives the same rows.  Memory follows the
batch (``common.configure``); a text longer than that is a batch of its own and takes some
ten times its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

MARKS = ("<P>", "<S>", "<M>")
#: Classes of bytes: anything else, line feed, other ASCII white space, UTF-8 continuation.
OTHER, LINE_END, SPACE, CONTINUES = range(4)
#: For each unit, (class before, class here) at which one begins; texts always begin one.
BEGINS = {
    "line": [(LINE_END, here) for here in range(4)],
    "word": [(before, OTHER) for before in (LINE_END, SPACE)],
    "char": [(before, here) for before in range(4) for here in (OTHER, LINE_END, SPACE)],
}
RESULT = "id long, n long, form string, output string, prefix_chars long, middle_chars long"


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none is empty, holds another, or ends as one begins."""
    for a in marks:
        for b in marks:
            meets = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))
            if not a or (a is not b and a in b) or meets:
                raise ValueError(f"the marks {a!r} and {b!r} can overlap")
    if len(set(marks)) < 3:
        raise ValueError("the three marks must differ")


def byte_classes():
    """Class of each byte."""
    import numpy as np

    table = np.zeros(256, dtype=np.uint8)
    table[[9, 11, 12, 13, 32]] = SPACE
    table[10] = LINE_END
    table[0x80:0xC0] = CONTINUES
    return table


def buffer_of(texts):
    """(bytes, starts) of an Arrow string array without nulls: row i is bytes[starts[i]:starts[i + 1]]."""
    import numpy as np
    import pyarrow as pa

    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, starts, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    starts = np.frombuffer(starts, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def unit_starts(kinds, starts, unit: str):
    """Mask of the bytes that begin a unit."""
    import numpy as np

    rule = np.zeros((4, 4), dtype=bool)
    rule[tuple(zip(*BEGINS[unit], strict=True))] = True
    mask = np.ones(len(kinds), dtype=bool)
    mask[1:] = rule[kinds[:-1], kinds[1:]]
    mask[starts[:-1][starts[:-1] < starts[1:]]] = True
    return mask


def sums(mask):
    """Running count with a leading 0: ``sums(mask)[p]`` marks stand before byte p."""
    import numpy as np

    out = np.zeros(len(mask) + 1, dtype=np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def places(data, mark: bytes):
    """Where ``mark`` begins, anywhere in the buffer."""
    import numpy as np

    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    return at


def holding(data, starts, marks):
    """Mask of the rows in which one of the marks stands whole."""
    import numpy as np

    held = np.zeros(len(starts) - 1, dtype=bool)
    for mark in marks:
        at = places(data, mark)
        row = np.searchsorted(starts, at, side="right") - 1
        held[row[at + len(mark) <= starts[row + 1]]] = True
    return held


def spans(data, edges):
    """Arrow strings between neighbouring edges of one buffer."""
    import numpy as np
    import pyarrow as pa

    edges = np.ascontiguousarray(edges, dtype=np.int64)
    return pa.LargeStringArray.from_buffers(
        len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))
    )


def pick(form, *choices):
    """Of several Arrow arrays the one that ``form`` (0, 1, ...) names, row by row, as strings."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.choose(pa.array(form, pa.int64()), *choices).cast(pa.string())


def transform(texts, h, rate: int, spm: int, unit: str, marks: tuple[str, str, str]):
    """Kernel: (n, form, output, prefix_chars, middle_chars) of an Arrow string array, as Arrow arrays.

    ``h``: four arrays of unsigned numbers a row; they draw two cuts, whether a row is changed, and its order.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    data, starts = buffer_of(texts)
    kinds = byte_classes()[data]
    count = sums(unit_starts(kinds, starts, unit))
    before = count[starts[:-1]].astype(np.int64)
    n = count[starts[1:]] - before
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    # byte p begins unit k of its text where the sum behind p first is before + k + 1; behind a
    # text's last unit that is the next text's first byte, its own end
    cuts = np.searchsorted(
        count[1:], np.stack([before + np.minimum(first, second), before + np.maximum(first, second)]) + 1
    )
    del count
    chars = sums(kinds != CONTINUES)
    low, high = cuts
    plain = (starts[:-1] == starts[1:]) | holding(data, starts, [m.encode() for m in marks]) | (h[2] % 100 >= rate)
    edges = np.empty(3 * len(n) + 1, dtype=np.int64)
    edges[:-1:3], edges[1::3], edges[2::3], edges[-1] = starts[:-1], low, high, starts[-1]
    parts = spans(data, edges)
    prefix, middle, suffix = (parts.take(pa.array(np.arange(k, 3 * len(n), 3))) for k in range(3))
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    none = pa.scalar("", pa.large_string())
    code = np.where(plain, 0, np.where(h[3] % 100 < spm, 2, 1))
    output = pick(
        code, spans(data, starts), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
    )
    form = pa.array(np.array(["plain", "psm", "spm"], dtype=object)[code], pa.string())
    between = lambda a, b: pa.array((chars[b] - chars[a]).astype(np.int64), pa.int64(), mask=plain)
    return pa.array(n, pa.int64()), form, output, between(starts[:-1], low), between(low, high)


def rebuild(output, form, marks: tuple[str, str, str]):
    """Kernel: the texts that ``output`` was made from, by the marks and the form alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    data, starts = buffer_of(output)
    code = np.select([form == "psm", form == "spm"], [1, 2], 0)
    size = [len(m.encode()) for m in marks]
    at = np.empty((3, len(code)), dtype=np.int64)
    for k, mark in enumerate(marks):
        found = np.append(places(data, mark.encode()), len(data))
        at[k] = found[np.searchsorted(found, starts[:-1])]
    lead, second = np.where(code == 2, at[1], at[0]), np.where(code == 2, at[0], at[1])
    good = (lead == starts[:-1]) & (lead < second) & (second < at[2]) & (at[2] + size[2] <= starts[1:])
    if not (good | (code == 0)).all():
        raise ValueError("an output does not have the marks of its form")
    # five stretches a row: first mark, text, second mark, text, third mark; what follows is the middle
    edges = np.empty((len(code), 6), dtype=np.int64)
    edges[:, 0], edges[:, 2], edges[:, 4] = starts[:-1], second, at[2]
    edges[:, 1] = lead + np.where(code == 2, size[1], size[0])
    edges[:, 3] = second + np.where(code == 2, size[0], size[1])
    edges[:, 5] = at[2] + size[2]
    edges[code == 0, 1:] = starts[1:][code == 0, None]
    parts = spans(data, np.append(edges.ravel(), starts[-1]))
    one, two, middle = (parts.take(pa.array(np.arange(k, 6 * len(code), 6))) for k in (1, 3, 5))
    none = pa.scalar("", pa.large_string())
    return pick(
        code, spans(data, starts), pc.binary_join_element_wise(one, middle, two, none),
        pc.binary_join_element_wise(two, middle, one, none),
    )


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line",
    marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """:data:`RESULT` for every row: the transformed text, its form and the sizes of prefix and middle.

    ``n`` is the number of units.  With h1 to h4 the first four 8-digit groups of the hex sha256 of
    ``<seed>:<id>`` (a null id: ``<seed>:``), the prefix ends behind the smaller and the middle
    behind the larger of h1 and h2 modulo n + 1; ``rate`` percent of the rows are changed (h3), of
    these ``spm`` percent to suffix-prefix-middle (h4).  Rows keep their text (form ``plain``, sizes
    null) where it is null (taken as empty), empty, or holds a mark.  Rows of the same id and text
    get the same result; other columns are not looked at; an empty table gives an empty result.
    """
    check_marks(marks)
    if unit not in BEGINS:
        raise ValueError(f"unknown unit {unit!r}; known: {', '.join(BEGINS)}")
    ident = F.col(id_col).cast("long")
    named = docs.select(
        ident.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256).alias("hex"),
    )
    drawn = named.select(
        "id", "text", *[F.conv(F.substring("hex", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            h = np.array([b.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)])
            n, form, output, prefix, middle = transform(b.column(1), h, rate, spm, unit, marks)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n, form, output, prefix, middle], names=[x.split()[0] for x in RESULT.split(", ")]
            )

    return drawn.mapInArrow(run, RESULT)


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text behind the columns ``output`` and ``form``; an output without its marks is an error."""
    import pyarrow as pa

    check_marks(marks)

    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        parts = [
            rebuild(outputs.slice(at, 400), forms.slice(at, 400).to_numpy(zero_copy_only=False), marks)
            for at in range(0, len(outputs), 400)
        ]
        return pa.concat_arrays([pa.array([], pa.string()), *parts])

    run.__annotations__ = {"outputs": pa.Array, "forms": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(F.col(output), F.col(form))
