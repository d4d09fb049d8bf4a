"""Quality rules with thresholds that adapt to each language and source.  Native.

Base measures and the two base rules are fixed by the caller's contract.  The method
adds fences for four rates that the base rules leave open: symbols, repeated lines and
upper-case letters (upper fences), and word length (upper and lower).

Fences.  A fence lies ``REACH`` times the distance from the median to a quartile beyond
that quartile, both read from a quantile sketch of the (language, source)'s own rows that
pass the base rules.  For exponential tails that leaves out one row in some thousands, and
up to a quarter of a group may be junk without moving its fence far.  Counts are smoothed by a
prior of a few words or lines (``RATES``, constants), so that short texts are no outliers by
chance and rates that are mostly zero still have a spread.

Chance.  A fence is a rate, a text has a number of words.  A text is outside only if its count is
also more than ``DEVIATIONS`` standard deviations above what the fence's rate gives at the text's own
length: a text without the measured thing is always inside, and in a group whose texts all
agree, where the fence has no reach, a short text of the same kind is inside too.  Counts
spread like Poisson's, with one more than expected allowed for; words' lengths are taken to spread
by half their mean.

Small groups.  Quantiles of a (language, source) are drawn towards its language's, and
those towards the corpus's, with the weight of ``PRIOR_ROWS`` rows: there is no step at
any group size.

Sketch.  A log-linear histogram over integers: a value keeps its ten leading bits, so a
quantile is off by 1/512 of its value at most.  Two sketches merge by adding counts; they
are kept per (language, source), merged to languages, and to the whole corpus.  Integer
arithmetic only: the same rows give the same fences in any order and partitioning.

Scale.  One pass over the texts, no shuffle of texts: the measures are written once and
the sketches are sums over (language, source, measure, bucket), combined before the
shuffle.  The fences are joined back on (language, source), broadcast only when their
counted rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, broadcast_if_small, materialize

SYMBOLS = "#*$%&|<>"
#: measure -> (count, of what, added to the count, added to the whole, a lower fence too); in 1/10,000
RATES = {
    "symbols": ("n_symbols", "n_words", 1, 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 10, False),
    "uppers": ("n_uppers", "word_chars", 5, 100, False),
    "word_len": ("word_chars", "n_words", 0, 0, True),
}
REACH = 10
DEVIATIONS = 3
PRIOR_ROWS = 100
SKETCH_BITS = 10


def measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The base measures of every whole text; one row per row of ``docs``.

    Null and empty texts have no words and no symbols.  ``n_repeat_words`` counts word
    positions inside any five-word window that occurs at least twice in the text.  Windows
    are compared by 64-bit hashes of their words' 64-bit hashes, within one text only: with
    n words, some two different windows or words agree with a probability below n^2 / 2^64,
    which is 2e-11 for 20,000 words and 5e-8 for a million.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), text.alias("text"),
        F.filter(F.split(text, WS_CLASS), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, WS_CHARS, "") != "").alias("lines"),
    )
    without = lambda x: F.length("text") - F.length(F.regexp_replace("text", x, ""))
    counts = base.select(
        "id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - without(WS_CLASS)).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        without(r"\p{Lu}+").cast("long").alias("n_uppers"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = counts.withColumn(
        "g",
        F.expr(
            "IF(size(h) >= 5, transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))), array())"
        ).cast("array<long>"),
    ).drop("h")
    # most texts repeat no window: only the others are sorted
    ranked = windows.withColumn(
        "s",
        F.expr(
            "IF(size(array_distinct(g)) < size(g), array_sort(transform(g, (x, i) -> struct(x AS g, i AS i))), NULL)"
        ),
    ).drop("g")
    starts = ranked.withColumn(
        "p",
        F.expr(
            "array_sort(transform(filter(transform(s, (x, k) -> struct(x.i AS i, (k > 0 AND get(s, k - 1).g = x.g) OR (k + 1 < size(s) AND get(s, k + 1).g = x.g) AS twice)), y -> y.twice), y -> y.i))"
        ),
    ).drop("s")
    covered = F.expr(
        "aggregate(p, struct(0L AS n, -5 AS last), (a, i) -> struct(a.n + least(5, i - a.last) AS n, i AS last), a -> a.n)"
    )
    return starts.select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_uppers", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates() -> dict:
    """The method's measures as whole numbers of 1/10,000, from the counts."""
    return {
        k: F.floor(10000 * (F.col(a) + more) / F.greatest(F.col(b) + prior, F.lit(1))).cast("long")
        for k, (a, b, more, prior, _) in RATES.items()
    }


def by_chance(name: str, lo, hi):
    """Whether a text's count lies within ``DEVIATIONS`` of what its fences, ``lo`` and ``hi``, give at its length."""
    count, whole, _, _, both = RATES[name]
    n = F.col(whole)
    at = lambda fence: (fence * n).cast("double") / F.lit(10000.0)
    if not both:
        return F.col(count) <= at(hi) + F.lit(float(DEVIATIONS)) * F.sqrt(at(hi) + F.lit(1.0))
    wide = lambda fence: F.lit(DEVIATIONS / 2) * at(fence) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))
    return F.col(count).between(at(lo) - wide(lo), at(hi) + wide(hi))


def bucket(v):
    """The lower end of the sketch's bucket for an integer >= 0: its leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rows: DataFrame) -> DataFrame:
    """``(lang, source, measure, bucket, n)`` over rows with the rate columns."""
    stack = ", ".join(f"'{k}', {k}" for k in RATES)
    return rows.selectExpr(
        "lang", "source", f"stack({len(RATES)}, {stack}) AS (measure, v)"
    ).groupBy("lang", "source", "measure", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Merge sketches to coarser keys: counts add up."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``(keys, measure, rows, q25, q50, q75)``: the buckets where the counts reach so many quarters."""
    by = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("up_to", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(4 * F.col("up_to") >= q * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "measure").agg(
        F.max("total").alias("rows"), at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75")
    )


def fences(rows: DataFrame, prior_rows: int = PRIOR_ROWS, reach: int = REACH) -> DataFrame:
    """``(lang, source, <measure>_lo, <measure>_hi ...)`` for every language and source of ``rows``."""
    fine = materialize(sketches(rows), "sketches")
    own = quartiles(fine, "lang", "source")
    lang = quartiles(merge(fine, "lang"), "lang").select(
        F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("rows").alias("l_rows"),
        *[F.col(f"q{k}").alias(f"l{k}") for k in (25, 50, 75)],
    )
    corpus = quartiles(merge(fine)).select(
        F.col("measure").alias("c"), *[F.col(f"q{k}").alias(f"c{k}") for k in (25, 50, 75)]
    )
    joined = own.join(
        lang, own.lang.eqNullSafe(lang.l) & (own.measure == lang.m), "left"
    ).join(corpus, F.col("measure") == F.col("c"), "left")
    drawn = lambda q, n, to: F.expr(f"({n} * {q} + {prior_rows} * {to}) div ({n} + {prior_rows})")
    q = joined.withColumns({f"l{k}": drawn(f"l{k}", "l_rows", f"c{k}") for k in (25, 50, 75)}).select(
        "lang", "source", "measure", *[drawn(f"q{k}", "rows", f"l{k}").alias(f"q{k}") for k in (25, 50, 75)]
    )
    out = []
    for name, (*_, both) in RATES.items():
        here = F.col("measure") == name
        out.append(F.max(F.when(here, F.col("q75") + reach * (F.col("q75") - F.col("q50")))).alias(f"{name}_hi"))
        out.append(
            F.max(
                F.when(
                    here,
                    F.greatest(F.col("q25") - reach * (F.col("q50") - F.col("q25")), F.lit(0)) if both else F.lit(0),
                )
            ).cast("long").alias(f"{name}_lo")
        )
    return q.groupBy("lang", "source").agg(*out)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    prior_rows: int = PRIOR_ROWS, reach: int = REACH,
) -> DataFrame:
    """Measures, rates, base verdict, fences and final verdict for each row of ``docs``.

    ``kept`` is false where ``base_failed``, else where a rate's bucket in the sketch lies
    outside its fences, and by more than chance; on its fence it is inside.  Null languages and sources are values of their own.  Repeated
    rows count as often as they stand.  Where no row passes the base rules there are no
    fences and nothing more to reject.  Extra input columns are ignored; an empty table
    gives an empty result.
    """
    m = measures(docs, id_col, text_col, lang_col, source_col)
    rows = materialize(m.withColumns(rates()).withColumn("base_failed", base_failed()), "measures")
    limits = materialize(
        fences(
            rows.where("NOT base_failed"), prior_rows, reach
        ).withColumnsRenamed({"lang": "f_lang", "source": "f_source"}),
        "fences",
    )
    limits = broadcast_if_small(limits)
    joined = rows.join(
        limits, rows.lang.eqNullSafe(limits.f_lang) & rows.source.eqNullSafe(limits.f_source), "left"
    ).drop("f_lang", "f_source")
    inside = F.lit(True)
    for k in RATES:
        lo, hi = F.col(f"{k}_lo"), F.col(f"{k}_hi")
        inside = inside & F.coalesce(bucket(F.col(k)).between(lo, hi) | by_chance(k, lo, hi), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)
