"""Chapters: splitting at headings, cutting at paragraphs, numbering, merging volumes.

The splits run in an Arrow table function, since they need Python's own regular expressions
(multi-line anchors, Unicode white space) and a position carried through the text.  Each
book is one row and independent of the others; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHAPTER_HEADINGS, MAX_CHAPTER, MIN_CHAPTER, VOLUME_HEADINGS, strip_wrapper


#: Texts whose pieces Python holds at once.
SLICE = 100


def paragraphs(text: str, most: int = MAX_CHAPTER) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last blank line that fits."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.rfind("\n\n", at, at + most)
        cut = at + most if cut <= at else cut
        out.append(text[at:cut].strip())
        at = cut
    rest = text[at:] if not at else text[at:].strip()
    return [p for p in (*out, rest) if p]


def choose(text: str, patterns):
    """The compiled pattern with the most matches, three at least; ties: the earlier."""
    import re

    counted = [(sum(1 for _ in re.finditer(p, text, re.M)), -i) for i, p in enumerate(patterns)]
    n, i = max(counted)
    return re.compile(patterns[-i], re.M) if n >= 3 else None


def chapters(text: str, least: int = MIN_CHAPTER, most: int = MAX_CHAPTER) -> list[str]:
    """Chapter bodies between headings; short ones are dropped, long ones cut.  Without headings: cut by size."""
    pattern = choose(text, CHAPTER_HEADINGS)
    if pattern is None:
        body = text.strip()
        return paragraphs(body, most) if body else []
    marks = [m.span() for m in pattern.finditer(text)]
    bodies = [text[end:start].strip() for (_, end), (start, _) in zip(marks, [*marks[1:], (len(text), 0)], strict=True)]
    return [p for b in bodies if len(b) >= least for p in paragraphs(b, most)]


def _split(src: DataFrame, split, first: int, number: str) -> DataFrame:
    """``(k, number, text)`` for the pieces ``split`` makes of each text of ``src`` (k, t), numbered from ``first``.

    Texts are taken a few at a time, so Python holds the pieces of ``SLICE`` texts and not of a batch.
    """
    kind = src.schema["k"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                rows = [
                    (k, i, c)
                    for k, t in zip(
                        b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True
                    ) for i, c in enumerate(split(t or ""), first)
                ]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cols[0], type=b.column(0).type), pa.array(cols[1], type=pa.int32()),
                        pa.array(cols[2], type=pa.string()),
                    ],
                    names=["k", number, "text"],
                )

    return src.mapInArrow(run, f"k {kind}, {number} int, text string")


def split_chapters(
    books: DataFrame, key: str = "novel", text: str = "text", least: int = MIN_CHAPTER, most: int = MAX_CHAPTER
) -> DataFrame:
    """``(key, chapter, text)`` with chapters numbered from 1; null and empty books have none."""
    src = books.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return _split(src, lambda t: chapters(t, least, most), 1, "chapter").withColumnRenamed("k", key)


def sub_chunks(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """``(key, idx, text)``: pieces cut at paragraph ends."""
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return _split(src, lambda t: paragraphs(t, most), 0, "idx").withColumnRenamed("k", key)


def renumber(chapters_df: DataFrame, book: str, volume: str, chapter: str) -> DataFrame:
    """Chapter numbers that run on through a book's volumes.

    Volume sizes are summed first, so the running offset is over volumes, not chapters.
    """
    sizes = chapters_df.groupBy(book, volume).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(book).orderBy(volume).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(book, volume, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    within = Window.partitionBy(book, volume).orderBy(chapter)
    return chapters_df.join(offsets, [book, volume]).withColumn(
        "number", F.col("__at") + F.row_number().over(within)
    ).drop("__at")


def renumber_headings(text: str, start: int) -> tuple[str, int]:
    """Replaces a volume's headings by "Chapter N", counting on from ``start``; the next number."""
    pattern = choose(text, VOLUME_HEADINGS)
    if pattern is None:
        return text, start
    number = start - 1

    def heading(_):
        nonlocal number
        number += 1
        return f"Chapter {number}"

    return pattern.sub(heading, text), number + 1


def merge_volumes(
    volumes: DataFrame, book: str = "novel", order: str = "volume", text: str = "text", renumbered: bool = False
) -> DataFrame:
    """``(book, text)``: wrappers cut off, volumes in order, three line breaks between."""
    clean = volumes.select(book, order, strip_wrapper(F.col(text)).alias("t"))
    joined = clean.groupBy(book).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "t"))), lambda x: x["t"]
        ).alias("parts")
    )
    if not renumbered:
        return joined.select(book, F.array_join("parts", "\n\n\n").alias("text"))

    kind = joined.schema[book].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, texts = whole.slice(at, SLICE), []
                for parts in b.column(1).to_pylist():
                    out, n = [], 1
                    for p in parts or ():
                        p, n = renumber_headings(p, n)
                        out.append(p)
                    texts.append("\n\n\n".join(out))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return joined.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", book)
