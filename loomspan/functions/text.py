"""Text rules as column expressions; regular expressions use Unicode classes where they must."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text chapters below this length are table-of-contents debris, above the next they are cut.
MIN_CHAPTER, MAX_CHAPTER = 300, 200_000
#: Chunk windows of the retrieval index.
CHUNK_SIZE, CHUNK_STRIDE = 1800, 1500
#: Longest chapter text that goes into a prompt.
PROMPT_CHAPTER = 60_000
#: What stands for an empty response.
EMPTY_RESPONSE = "(empty response)"
DRY_RUN_RESPONSE = "(dry-run, no API call)"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_think(text: Column) -> Column:
    """Without one leading think block."""
    return F.regexp_replace(text, r"(?is)\A\s*<think>.*?</think>\s*", "")


def think_block(text: Column) -> Column:
    """The leading think block's content; empty where there is none."""
    return F.regexp_extract(text, r"(?is)\A\s*<think>(.*?)</think>", 1)


def response_parts(text: Column, body_cap: int = 6000, think_cap: int = 2500) -> Column:
    """Struct (think, body, think_truncated, body_truncated, n_chars) of a raw response."""
    think, body = strip(think_block(text)), strip(strip_think(text))
    return F.struct(
        F.substring(think, 1, think_cap).alias("think"), F.substring(body, 1, body_cap).alias("body"),
        (F.length(think) > think_cap).alias("think_truncated"), (F.length(body) > body_cap).alias("body_truncated"),
        F.length(text).cast("long").alias("n_chars"),
    )


def prompt_chapter(text: Column) -> Column:
    """A chapter's text as far as a prompt takes it."""
    return F.substring(text, 1, PROMPT_CHAPTER)


def or_sentinel(text: Column) -> Column:
    """The stripped response, or the sentinel where nothing is left."""
    s = strip(strip_think(F.coalesce(text, F.lit(""))))
    return F.when(s == "", EMPTY_RESPONSE).otherwise(s)


def contains_normalised(text: Column, part: Column) -> Column:
    """Verbatim presence: case and runs of white space do not matter."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.contains(flat(text), flat(part))


def matches_search(query: str, *cols: str) -> Column:
    """Case-insensitive substring over several columns; nulls are skipped."""
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(query.lower()))


def word_count(text: Column) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("long")


def chunk_windows(text: Column, size: int = CHUNK_SIZE, stride: int = CHUNK_STRIDE) -> Column:
    """Array of (chunk_idx, start, chunk): overlapping windows; the last one reaches the end."""
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                i.alias("chunk_idx"), (i * stride).alias("start"),
                F.substring(text, i * stride + 1, F.lit(size)).alias("chunk"),
            )
        ),
    )


#: The archive's start and end marks: a fixed value.
_MARK = r"\*\*\* {} OF (?:THE|THIS) PROJECT GUTENBERG EBOOK"


def strip_wrapper(text: Column) -> Column:
    """Book text without the archive's header and footer; the end mark is looked for after the start's cut."""
    body = F.regexp_replace(text, r"(?is)\A.*?" + _MARK.format("START") + r"[^\n]+? \*\*\*", "")
    return strip(F.regexp_replace(body, r"(?is)" + _MARK.format("END") + r".*\z", ""))


def valid_download(
    content: Column, ebook_id: Column, max_bytes: int = 32 * 1024 * 1024, least_body: int = 1000
) -> Column:
    """Whether a fetched text is the right and whole book (see the download rules)."""
    # the number's and the marks' patterns are fixed values
    found = F.regexp_extract(F.substring(content, 1, 10_000), r"(?i)\bEBook\s*(?:#|No\.?\s*:)\s*(\d+)\b", 1)
    mark = r"\*\*\*\s+{} OF (?:THE|THIS) PROJECT GUTENBERG E(?:BOOK|TEXT)\b"
    # the first start mark, then an end mark behind it with enough text between
    head = F.regexp_instr(content, F.lit("(?i)" + mark.format("START")))
    rest = F.regexp_replace(content, r"(?is)\A.*?" + mark.format("START"), "")
    first_end = F.regexp_instr(content, F.lit("(?i)" + mark.format("END")))
    body = strip(F.regexp_replace(rest, r"(?is)" + mark.format("END") + r".*\z", ""))
    ok = (
        F.octet_length(content) <= max_bytes
    ) & (found != "") & (found.cast("long") == ebook_id) & (head > 0) & (first_end > head) & (F.length(body) >= least_body)
    return F.coalesce(ok, F.lit(False))


#: Chapter headings in their order of priority: fixed values.
CHAPTER_HEADINGS = (
    r"^Chapter\s+\d+[^\n]*$",
    r"^CHAPTER\s+[IVXLC]+[^\n]*$",
    r"^\n[IVXLC]+\n",
    r"^[\s\-]*CHAPTER\s+[A-Z]{2,}[^\n]*$",
    r"^Chapter\s+[A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)?\s*$",
    r"^\s+[IVXLC]+\.\s*$",
)
#: Headings that volume merging renumbers: fixed values.
VOLUME_HEADINGS = (
    r"^Chapter\s+\d+[^\n]*$",
    r"^[\s\-]*CHAPTER\s+[^\n]+$",
    r"^Chapter\s+[A-Z][a-z]+(?:[\s\-][A-Z][a-z]+)?\s*$",
)
#: Java flags that give the same lines and white space as the patterns were written for.
HEADING_FLAGS = "(?Umd)"


def heading_choice(text: Column, patterns=CHAPTER_HEADINGS, least: int = 3) -> Column:
    """Index of the pattern with the most matches (ties: the earlier), null below ``least``."""
    counts = F.array(
        *[
            F.struct(F.regexp_count(text, F.lit(HEADING_FLAGS + p)).alias("n"), F.lit(-i).alias("i"))
            for i, p in enumerate(patterns)
        ]
    )
    best = F.array_max(counts)
    return F.when(best["n"] >= least, -best["i"])


def last_line(text: Column) -> Column:
    """The last line that is not blank, stripped; empty where there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def parse_chapter(text: Column) -> Column:
    """Predicted chapter: the last line first, then the whole text; null for unknown."""
    x = r"(?i)chapter\s*[:\-]?\s*(\d+|unknown)"
    tail = F.regexp_extract(last_line(text), x, 1)
    token = F.lower(F.when(tail != "", tail).otherwise(F.regexp_extract(text, x, 1)))
    return F.when(token.rlike(r"^\d+$"), token.try_cast("int"))


def parse_presence(text: Column) -> Column:
    """"present", "absent" or null."""
    x = r"(?i)presence\s*[:\-]?\s*(present|absent)"
    low = F.lower(last_line(text))
    tail = F.regexp_extract(last_line(text), x, 1)
    token = F.lower(F.when(tail != "", tail).otherwise(F.regexp_extract(text, x, 1)))
    p, a = F.contains(low, F.lit("present")), F.contains(low, F.lit("absent"))
    return F.when(token != "", token).when(p & ~a, "present").when(a & ~p, "absent")


#: Refusals and the signs of action: fixed values.
REFUSAL = r"(?i)\b(as an ai|i cannot|i can't|i am unable|i'm unable|language model|cannot fulfill|i'm sorry, but)\b"
SPEECH = "[\"“”']"
ACTION = r"(?i)\*[^*]+\*|\b(turn|step|look|hand|eye|voice|walk|rise|stand)\w*"


def heuristic_reward(text: Column) -> Column:
    """Reference-free score: empty 0, refusal 0.05, else length, variety and substance."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    words = F.split(t, " ")
    n = F.size(words)
    length = F.when(n < 40, n / 40.0).when(n <= 400, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - (n - 400) / 400.0)
    )
    variety = F.size(F.array_distinct(F.transform(words, F.lower))) / n
    flag = lambda x: t.rlike(x).cast("int")
    substance = 0.5 * (flag(SPEECH) + flag(ACTION))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(REFUSAL), F.lit(0.05)).otherwise(
        F.least(F.lit(1.0), 0.5 * length + 0.3 * variety + 0.2 * substance)
    )


def unfence(text: Column) -> Column:
    """JSON text out of an optional code fence."""
    t = strip(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(t, r"\r\n|\n|\r"), lambda x: ~F.startswith(F.trim(x), F.lit("```")))
    return F.when(F.startswith(t, F.lit("```")), strip(F.array_join(lines, "\n"))).otherwise(t)


def search_url(author: Column, title: Column, year: Column) -> Column:
    """A scholarly search address for a citation; as in query strings a tilde stays and a star does not."""
    words = F.replace(F.url_encode(F.concat_ws(" ", author, title, year)), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), F.replace(words, F.lit("*"), F.lit("%2A")))


def token_estimate(text: Column) -> Column:
    """Characters over four, floored per text."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")
