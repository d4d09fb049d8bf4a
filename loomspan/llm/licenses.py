r"""License scans by ordered signature rules.  Native.

A text becomes one line of words (A-Z lower-cased, words of digits, a-z and non-ASCII
characters, single spaces between and around), so a rule is indifferent to punctuation
and line breaks.  A rule is (label, priority, keywords, regular expression).

1. Prefilter: of each keyword the longest word is looked for among a text's words; a text
   with none of them is done.  Of the rest, a rule runs only where its whole keyword stands
   in the line.
2. Every place a rule matches is an interval with the rule's priority.
3. Suppression: intervals are taken by start, longest first, then priority.  One that
   lies inside an earlier one of the same or a higher priority is dropped.
4. Neighbours: a detection behind "not" counts as a bare name; an exception is joined to the license
   that stands right before it; two licenses of which the text says that one may choose are one
   detection, their labels joined by OR in alphabetical order.

All of it happens inside the row: no shuffle, no join, the same work for any grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_rules as R
from .common import let, lower_ascii, running
from .license_rules import BARE, GRANT, NAMED, RULES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

CONFIDENCE = {GRANT: 1.0, NAMED: 0.8, BARE: 0.5}


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keywords with bars between, expression), the expression bounded by whole words."""
    return [(label, p, key, f"(?<= )(?:{x})(?= )") for label, own in RULES.items() for p, key, x in own]


#: Words of keywords that stand in too many texts to tell anything.
COMMON = frozenset(
    """a and any are at be by can copy do file for free from has have if in is it mean not nd of on or part sa nc says
    some that the this to under up use used was we what which with without work you your""".split()
)


def telling_word(keyword: str) -> str:
    """The longest word of a keyword that is not common: the one that is looked for first."""
    return max(keyword.split(" "), key=lambda w: (w not in COMMON, len(w), w))


def gates() -> list[str]:
    """Words of which any text that a rule or phrase can match holds at least one."""
    return sorted(
        {telling_word(k) for _, _, keys, _ in rules() for k in keys.split("|")} | {telling_word(k) for k in PHRASES}
    )


def linked(line, spans):
    """``spans`` (s, e, p, label) by start, after step 4; see above.  Looks at neighbours only.

    Three columns' worth of steps, as functions from an array to an array, to be stored one by one.
    """
    span = "struct<s:int,e:int,p:int,label:string>"
    cut = lambda a, b: F.substring(line, a + 1, b - a)
    before = lambda d: cut(F.greatest(d["s"] - 60, F.lit(0)), d["s"])
    made = lambda s, e, p, label: F.struct(s.alias("s"), e.alias("e"), p.alias("p"), label.alias("label")).cast(span)
    exception = lambda d: F.startswith(d["label"], F.lit("WITH "))

    def denied(d):
        return made(d["s"], d["e"], F.when(before(d).rlike(R.NOT), F.least(d["p"], F.lit(BARE))).otherwise(d["p"]), d["label"])

    def merged(spans, joins, label):
        """Each two neighbours that ``joins`` become one; of three in a row the first two."""
        at = lambda i: F.get(spans, i)
        pair = lambda i: F.coalesce((i >= 0) & (i + 1 < F.size(spans)) & joins(at(i), at(i + 1)), F.lit(False))
        first = lambda i: pair(i) & ~pair(i - 1)
        return F.array_compact(
            F.transform(
                spans,
                lambda d, i: F.when(first(i - 1), F.lit(None)).when(
                    first(i),
                    made(d["s"], at(i + 1)["e"], F.greatest(d["p"], at(i + 1)["p"]), label(d, at(i + 1))),
                ).otherwise(d),
            )
        )

    def with_exceptions(spans):
        own = merged(
            spans,
            lambda a, b: exception(b) & ~F.contains(a["label"], F.lit("WITH ")) & cut(a["e"], b["s"]).rlike(R.WITH_GAP),
            lambda a, b: F.concat_ws(" ", a["label"], b["label"]),
        )
        return F.transform(
            own,
            lambda d: made(d["s"], d["e"], d["p"], F.when(exception(d), F.substring(d["label"], 6, 200)).otherwise(d["label"])),
        )

    def choices(spans):
        def joins(a, b):
            gap, after = cut(a["e"], b["s"]), F.substring(line, b["e"] + 1, 40)
            said = before(a).rlike(R.EITHER) | after.rlike(R.AT_YOUR_OPTION)
            offered = before(a).rlike(R.CHOICE) | before(a).rlike(R.DUAL)
            return (a["label"] != b["label"]) & ((gap.rlike(R.OR_GAP) & (said | offered)) | (gap.rlike(R.AND_GAP) & offered))

        return merged(
            spans, joins, lambda a, b: F.array_join(F.array_sort(F.array(a["label"], b["label"])), " OR ")
        )

    return [lambda spans: F.transform(spans, denied), with_exceptions, choices]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` per row.

    ``spans``: the detections that are left after all steps, as (start, end, priority, label) in
    characters of the line of words.  Null and empty texts have no words and no labels.
    ``score`` is the surest detection's confidence; a base phrase counts as a bare name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # of A-Z, lower() makes what the contract does; no other letter becomes a separator or ceases to be one,
    # so words are counted and looked up here, and only texts behind the gate are made into a line
    words = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("text"), F.split(F.lower(text), SEPARATORS).alias("words")
    )
    empty = lambda i: F.when(F.element_at("words", i) == "", 1).otherwise(0)
    n_words = F.size("words") - empty(1) - F.when(F.size("words") > 1, empty(-1)).otherwise(0)
    row = words.select(
        "id", n_words.cast("long").alias("n_words"),
        F.array_intersect("words", F.array(*map(F.lit, gates()))).alias("telling"), "text",
    )
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("text")), SEPARATORS, " ")), F.lit(" "))
    row = row.select("id", "n_words", "telling", F.when(F.size("telling") > 0, spaced).alias("line"))
    # base phrases: the parts between a phrase's places tell how many and where
    parts = {k: f"p{i}" for i, k in enumerate(PHRASES)}
    row = row.withColumns({v: F.split("line", f"(?<= ){k}(?= )", -1) for k, v in parts.items()})
    spaces = lambda s: F.length(s) - F.length(F.translate(s, " ", "")) - 1
    places = {k: F.coalesce(F.size(v) - 1, F.lit(0)) for k, v in parts.items()}
    n_base, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for k, v in parts.items():
        there = F.col("line").isNotNull() & (F.size(v) > 1)
        n_base = n_base + F.when(there, places[k]).otherwise(0)
        firsts.append(F.when(there, spaces(F.get(v, F.lit(0)))))
        lasts.append(F.when(there, F.col("n_words") - spaces(F.element_at(v, -1)) - len(k.split(" "))))
        labels.append(F.when(there, F.lit(PHRASES[k])))
    row = row.withColumns(
        {
            "n_base": n_base, "first_word": F.array_min(F.array(*firsts)).cast("long"),
            "last_word": F.array_max(F.array(*lasts)).cast("long"), "base": F.array_compact(F.array(*labels)),
        }
    ).drop(*parts.values())
    keys = lambda key: F.array(
        *[F.struct(F.lit(telling_word(k)).alias("w"), F.lit(f" {k} ").alias("t")) for k in key.split("|")]
    )
    book = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(p).alias("p"), keys(key).alias("key"), F.lit(x).alias("x"))
            for label, p, key, x in rules()
        ]
    )
    there = lambda k: F.array_contains(F.col("telling"), k["w"]) & F.col("line").contains(k["t"])
    row = row.withColumn("hits", F.when(F.col("line").isNotNull(), F.filter(book, lambda r: F.exists(r["key"], there))))
    # a rule's intervals, from the parts between its matches and the matches themselves: running
    # sums of their lengths by doubling, k log k for k matches
    span = "struct<s:int,e:int,p:int,label:string>"

    def places(r):
        def found(z):
            both = F.zip_with(
                z["gap"], z["hit"],
                lambda g, h: F.struct(
                    (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("int").alias("e"),
                    F.coalesce(F.length(h), F.lit(0)).alias("n"),
                ),
            )
            sums = lambda v: running(
                v,
                lambda earlier, here: F.struct(
                    (F.coalesce(earlier["e"], F.lit(0)) + here["e"]).alias("e"), here["n"].alias("n")
                ),
            )
            return F.transform(
                F.filter(let(both, sums), lambda x: x["n"] > 0),
                lambda x: F.struct(
                    (x["e"] - x["n"]).alias("s"), x["e"].alias("e"), r["p"].alias("p"), r["label"].alias("label")
                ).cast(span),
            )

        return let(
            F.struct(
                F.split("line", r["x"], -1).alias("gap"), F.regexp_extract_all("line", r["x"], F.lit(0)).alias("hit")
            ),
            found,
        )

    # by start, then longest, then priority, then label
    key = F.transform(
        F.flatten(F.transform("hits", places)),
        lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["p"]).alias("p"), d["label"].alias("label")),
    )
    ordered = F.transform(
        F.array_sort(key),
        lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["p"]).alias("p"), d["label"].alias("label")),
    )
    row = row.withColumn("dets", ordered)

    def outer(dets):
        """Of each priority, the furthest end so far among intervals of that priority or a higher one."""
        ends = F.transform(
            dets,
            lambda d: F.struct(*[F.when(d["p"] >= p, d["e"]).otherwise(F.lit(-1)).alias(f"e{p}") for p in CONFIDENCE]),
        )
        return let(
            ends,
            lambda v: running(
                v,
                lambda earlier, here: F.struct(
                    *[F.greatest(here[f"e{p}"], earlier[f"e{p}"]).alias(f"e{p}") for p in CONFIDENCE]
                ),
            ),
        )

    # an interval goes where an earlier one of its priority or a higher one reaches as far
    ahead = F.concat(F.array(F.struct(*[F.lit(-1).alias(f"e{p}") for p in CONFIDENCE])), outer(F.col("dets")))
    reach = lambda z: F.when(z["d"]["p"] == BARE, z["o"][f"e{BARE}"]).when(
        z["d"]["p"] == NAMED, z["o"][f"e{NAMED}"]
    ).otherwise(z["o"][f"e{GRANT}"])
    kept = F.filter(
        F.arrays_zip(F.col("dets").alias("d"), F.slice(ahead, F.lit(1), F.size("dets")).alias("o")),
        lambda z: reach(z) < z["d"]["e"],
    )
    row = row.withColumn("spans", F.transform(kept, lambda z: z["d"].cast(span)))
    for step in linked(F.col("line"), F.col("spans")):
        row = row.withColumn("spans", F.when(F.size("spans") > 0, step(F.col("spans"))))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<s:int,e:int,p:int,label:string>>"))
    sure = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        sure = F.greatest(sure, F.when(F.exists(spans, lambda d: d["p"] == p), F.lit(c)).otherwise(0.0))  # noqa: B023
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return row.select(
        "id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform(spans, lambda d: d["label"]))).alias("labels"),
        F.greatest(sure, F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[BARE])).otherwise(0.0)).alias("score"),
        spans.alias("spans"),
    )
