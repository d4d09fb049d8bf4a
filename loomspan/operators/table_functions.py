"""Chapters, pieces and windows of texts as table functions, for LATERAL in SQL.

    register(spark)
    SELECT novel, c.* FROM books, LATERAL book_chapters(text) AS c

They give the same rows as the DataFrame forms in :mod:`loomspan.operators.splitting`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.text import CHUNK_SIZE, CHUNK_STRIDE, MAX_CHAPTER, MIN_CHAPTER
from .splitting import chapters, paragraphs


class BookChapters:
    """(chapter, text): bodies between headings, numbered from 1; optionally other bounds of their length."""

    def eval(self, text: str, least: int = MIN_CHAPTER, most: int = MAX_CHAPTER):
        yield from enumerate(chapters(text or "", least, most), 1)


class TextPieces:
    """(idx, text): pieces of at most ``most`` characters, cut at the last blank line that fits."""

    def eval(self, text: str, most: int = MAX_CHAPTER):
        yield from enumerate(paragraphs(text or "", most))


class TextWindows:
    """(chunk_idx, start, chunk): overlapping windows; the first that reaches the end is the last."""

    def eval(self, text: str, size: int = CHUNK_SIZE, stride: int = CHUNK_STRIDE):
        if not text:
            return
        for k, at in enumerate(range(0, len(text), stride)):
            yield k, at, text[at : at + size]
            if at + size >= len(text):
                return


FUNCTIONS = {
    "book_chapters": (BookChapters, "chapter int, text string"),
    "text_pieces": (TextPieces, "idx int, text string"),
    "text_windows": (TextWindows, "chunk_idx int, start int, chunk string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session; rows go through Arrow."""
    for name, (make, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(make, returnType=schema, useArrow=True))
