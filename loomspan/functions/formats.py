"""Small display rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heat(v: Column) -> Column:
    """Score to [0, 1]: 20 and less is cold, 100 is hot."""
    return F.greatest(F.least((v - 20) / 80, F.lit(1.0)), F.lit(0.0))


def score_class(v: Column) -> Column:
    return F.when(v >= 70, "hi").when(v <= 35, "lo").otherwise("mid")


def one_decimal(v: Column) -> Column:
    """``.1f``, a null as two dashes."""
    return F.when(v.isNull(), "--").otherwise(F.format_string("%.1f", v))


def signed(v: Column) -> Column:
    """One decimal with its sign; a null as two dashes."""
    return F.when(v.isNull(), "--").otherwise(F.format_string("%+.1f", v))


def truncate_words(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to a word's end, with an ellipsis."""
    return F.when(
        F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s+\S*\z", ""), F.lit("…"))
    ).otherwise(text)


def join_names(names: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(names)
    head = F.concat(
        F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "),
        F.element_at(names, -1),
    )
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).when(
        n == 2, F.array_join(names, " and ")
    ).otherwise(head)


def compact_float(v: Column) -> Column:
    """A number without trailing zeros; points and signs that file names dislike replaced."""
    s = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return F.translate(s, ".", "p")
