"""Queries of the text rules, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text as X
from ..functions.formats import truncate_words
from ..operators import splitting
from .base import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    r"""SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 1 THEN ' <THINK>hm' || chr(10) || role || '</think>' || chr(10) || text ELSE text || '<think>x</think>' END, '(?is)\A\s*<think>.*?</think>\s*', '') AS body FROM conversations"""
)
def strip_think(spark, sf_dir):
    """One leading think block goes."""
    c = table(spark, sf_dir, "conversations")
    raw = F.when(
        F.col("turn") % 2 == 1, F.concat(F.lit(" <THINK>hm\n"), "role", F.lit("</think>\n"), "text")
    ).otherwise(F.concat("text", F.lit("<think>x</think>")))
    return c.select("conv_id", "turn", X.strip_think(raw).alias("body"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, text, UNNEST(range(0, CASE WHEN n <= 1800 THEN 1 ELSE CEIL((n - 1800) / 1500.0)::INT + 1 END)) AS i FROM n)
SELECT doc_id, i::INT AS chunk_idx, (i * 1500)::INT AS start, md5(substr(text, (i * 1500 + 1)::BIGINT, 1800)) AS digest FROM w""")
def chunk_windows(spark, sf_dir):
    """Overlapping windows that stop where one reaches the end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.chunk_windows(F.col("text"))).alias("w"))
    return d.select("doc_id", "w.chunk_idx", "w.start", F.md5(F.encode("w.chunk", "UTF-8")).alias("digest"))


@query(
    r"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM documents), b AS MATERIALIZED (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)"""
)
def verbatim_contains(spark, sf_dir):
    """Names in texts, by containment: signatures, one scan of the texts."""
    from ..operators.containment import containment

    return containment(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text"
    )


@query(
    "SELECT source, COUNT(*) AS n, MIN(length(text))::BIGINT AS shortest FROM documents WHERE length(text) >= 300 GROUP BY ALL"
)
def short_fragment_filter(spark, sf_dir):
    """fragments below the least length go."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= X.MIN_CHAPTER)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min(F.length("text")).cast("bigint").alias("shortest"))


_WORDS = r"CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - length(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ', '')) + 1 END"


@query(f"SELECT lang, COUNT(*) AS chapters, ROUND(AVG({_WORDS}), 6) AS mean_words FROM documents GROUP BY ALL")
def corpus_stats(spark, sf_dir):
    """Chapters and mean words."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("chapters"), F.round(F.avg(X.word_count(F.col("text"))), 6).alias("mean_words")
    )


@query(
    "SELECT role, COUNT(*) AS calls, SUM(length(text) // 4)::BIGINT AS tokens_in, ROUND(SUM(length(text) // 4) / 1e6 * 0.14 + COUNT(*) * 120 / 1e6 * 0.28, 9) AS usd FROM conversations GROUP BY ALL"
)
def token_cost_estimate(spark, sf_dir):
    """Tokens floored per text, then priced."""
    tokens = F.sum(X.token_estimate(F.col("text")))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("calls"), tokens.alias("tokens_in"),
        F.round(tokens / 1e6 * 0.14 + F.count("*") * 120 / 1e6 * 0.28, 9).alias("usd"),
    )


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), w AS (SELECT *, string_split(t, ' ') AS w FROM t)
SELECT conv_id, turn, ROUND(CASE WHEN t = '' THEN 0 WHEN regexp_matches(t, '(?i)\b(as an ai|i cannot|i can''t|i am unable|i''m unable|language model|cannot fulfill|i''m sorry, but)\b') THEN 0.05 ELSE
 LEAST(1.0, 0.5 * CASE WHEN len(w) < 40 THEN len(w) / 40.0 WHEN len(w) <= 400 THEN 1.0 ELSE GREATEST(0.0, 1 - (len(w) - 400) / 400.0) END + 0.3 * len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)
 + 0.2 * 0.5 * (regexp_matches(t, '["“”'']')::INT + regexp_matches(t, '(?i)\*[^*]+\*|\b(turn|step|look|hand|eye|voice|walk|rise|stand)\w*')::INT)) END, 6) AS reward FROM w""")
def heuristic_reward(spark, sf_dir):
    """Reference-free reward."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.round(X.heuristic_reward(F.col("text")).cast("double"), 6).alias("reward")
    )


@query(r"""WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Chapter 1: a' || chr(10) || 'x' || chr(10) || 'Chapter 2' || chr(10) || 'Chapter 3' || chr(10) WHEN 1 THEN 'CHAPTER I.' || chr(10) || 'CHAPTER V' || chr(10) || 'CHAPTER X' || chr(10) ELSE '' END || lower(text) AS t FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END::INT AS pattern FROM b""")
def heading_pattern_choice(spark, sf_dir):
    """The heading pattern with the most matches."""
    head = F.when(
        F.col("doc_id") % 3 == 0, "Chapter 1: a\nx\nChapter 2\nChapter 3\n"
    ).when(F.col("doc_id") % 3 == 1, "CHAPTER I.\nCHAPTER V\nCHAPTER X\n").otherwise("")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(X.heading_choice(F.concat(head, F.lower("text"))), F.lit(-1)).alias("pattern")
    )


@query("""WITH m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'OpenAI/GPT-5' WHEN 1 THEN 'x/deepseek-v4' WHEN 2 THEN 'meta/Llama-3' WHEN 3 THEN '' WHEN 4 THEN 'lab/My Model:1.0' ELSE 'a/' || c_name END AS m FROM customer)
SELECT c_custkey, CASE WHEN contains(lower(m), 'gpt') THEN 'gpt' WHEN contains(lower(m), 'deepseek') THEN 'deepseek' WHEN contains(lower(m), 'llama') THEN 'llama' WHEN m = '' THEN 'judge' ELSE substr(regexp_replace(regexp_extract(lower(m), '([^/]*)$', 1), '[^a-z0-9-]', '-', 'g'), 1, 32) END AS tag FROM m""")
def family_tag(spark, sf_dir):
    """Judge family."""
    k = F.col("c_custkey") % 6
    m = F.when(k == 0, "OpenAI/GPT-5").when(k == 1, "x/deepseek-v4").when(k == 2, "meta/Llama-3").when(k == 3, "").when(k == 4, "lab/My Model:1.0").otherwise(
        F.concat(F.lit("a/"), "c_name")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", ids.family_tag(m).alias("tag"))


@query(r"""WITH p AS (SELECT event_id, 'axis' || user_id || CASE event_id % 4 WHEN 0 THEN '_intext_a' WHEN 1 THEN '_inworld_a' WHEN 2 THEN '_outworld_b' ELSE '_none_a' END || (event_id % 10) AS id FROM events), x AS (SELECT event_id, id, regexp_extract(id, '_(intext|inworld|outworld)_', 1) AS a, regexp_extract(id, '_(intext|inworld|outworld)_a(\d+)$', 1) AS b FROM p)
SELECT event_id, CASE a WHEN 'intext' THEN 'in_text' WHEN 'inworld' THEN 'in_world' WHEN 'outworld' THEN 'out_of_world' END AS found, CASE b WHEN 'intext' THEN 'in_text' WHEN 'inworld' THEN 'in_world' WHEN 'outworld' THEN 'out_of_world' END AS anchored FROM x""")
def id_regex_parse(spark, sf_dir):
    """Probe types out of ids, searched and anchored."""
    k = F.col("event_id") % 4
    pid = F.concat(
        F.lit("axis"), F.col("user_id").cast("string"),
        F.when(k == 0, "_intext_a").when(k == 1, "_inworld_a").when(k == 2, "_outworld_b").otherwise("_none_a"),
        (F.col("event_id") % 10).cast("string"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", ids.probe_type(pid).alias("found"), ids.probe_type(pid, anchored=True).alias("anchored")
    )


@query(
    f"""SELECT p_partkey, p.i::INT AS phase, list_extract({list(ids.ERAS)}, ((('0x' || substr(sha1('axis' || p_partkey), 1, 8))::BIGINT % 7 + p.i) % 7 + 1)::INT) AS era FROM part, (SELECT UNNEST(range(0, 3)) AS i) p"""
)
def era_hash(spark, sf_dir):
    """The setting of an axis's phases by hash."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("phase"))
    return p.select(
        "p_partkey", "phase",
        ids.era(F.concat(F.lit("axis"), F.col("p_partkey").cast("string")), F.col("phase")).alias("era"),
    )


@query(
    r"SELECT doc_id, CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), '\s+\S*$', '') || '…' ELSE text END AS short FROM documents"
)
def truncate_words_query(spark, sf_dir):
    """Cut at a word's end."""
    return table(spark, sf_dir, "documents").select("doc_id", truncate_words(F.col("text"), 80).alias("short"))


@query(
    "SELECT p_type, COUNT(*) AS n FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), 'red widget') AND p_type IN ('ECONOMY', 'STANDARD') GROUP BY ALL"
)
def search_filter(spark, sf_dir):
    """search over several columns with a type filter."""
    p = table(spark, sf_dir, "part").where(
        X.matches_search("Red Widget", "p_name", "p_brand") & F.col("p_type").isin("ECONOMY", "STANDARD")
    )
    return p.groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN -1 WHEN turn % 3 = 0 THEN -1 ELSE turn::INT END AS chapter, CASE WHEN role = 'assistant' THEN 'absent' END AS presence FROM conversations"""
)
def expert_parsers(spark, sf_dir):
    """Chapter and presence out of a classifier's last line."""
    t = F.col("turn").cast("string")
    said = F.when(F.col("role") == "user", "no idea").when(
        F.col("turn") % 3 == 0, F.concat(F.lit("Chapter: 9\nso\nChapter: Unknown\n\n"))
    ).otherwise(F.concat(F.lit("Chapter 99 or\n chapter - "), t, F.lit("  \n")))
    where = F.when(
        F.col("role") == "assistant", "PRESENCE: present?\nno: presence - Absent"
    ).otherwise("present and absent")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce(X.parse_chapter(said), F.lit(-1)).alias("chapter"),
        X.parse_presence(where).alias("presence"),
    )


@query(
    "SELECT conv_id, turn, substr(sha1(text), 1, 16) AS prompt_hash, replace(replace('a/b:' || role, '/', '_'), ':', '_') AS safe FROM conversations"
)
def prompt_hashes(spark, sf_dir):
    """Prompt hashes and safe names."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ids.prompt_hash(F.col("text")).alias("prompt_hash"),
        ids.safe_model(F.concat(F.lit("a/b:"), "role")).alias("safe"),
    )


@query(
    """SELECT n_name, replace(lower(n_name || ' (Jr.), O''B'), ' ', '_') AS raw, regexp_replace(replace(lower(n_name || ' (Jr.), O''B'), ' ', '_'), '[,.''()]', '', 'g') AS slug FROM nation"""
)
def slugs(spark, sf_dir):
    """Slugs of names."""
    name = F.concat("n_name", F.lit(" (Jr.), O'B"))
    return table(spark, sf_dir, "nation").select(
        "n_name", F.replace(F.lower(name), F.lit(" "), F.lit("_")).alias("raw"), ids.slug(name).alias("slug")
    )


@query(
    r"""WITH r AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '<think>' || role || '</think> ' ELSE '' END || text AS t FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS think, length(t)::BIGINT AS n_chars, length(regexp_replace(regexp_replace(t, '(?is)\A\s*<think>.*?</think>\s*', ''), '^\s+|\s+$', '', 'g')) > 6000 AS truncated FROM r"""
)
def response_split(spark, sf_dir):
    """Think block, body and flags of a raw response."""
    raw = F.concat(
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>"), "role", F.lit("</think> "))).otherwise(""), "text"
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.response_parts(raw).alias("p")).select(
        "conv_id", "turn", "p.think", "p.n_chars", F.col("p.body_truncated").alias("truncated")
    )


@query(
    """WITH k AS (SELECT source, lang, doc_id FROM documents WHERE length(text) >= 300) SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY lang, doc_id)::BIGINT AS number FROM k"""
)
def renumber_global(spark, sf_dir):
    """Chapter numbers that run on through volumes."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= X.MIN_CHAPTER).select("source", "lang", "doc_id")
    return splitting.renumber(d, "source", "lang", "doc_id").select(
        "doc_id", F.col("number").cast("bigint").alias("number")
    )
