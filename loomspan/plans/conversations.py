"""Queries of conversations and training corpora, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C
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
    """SELECT conv_id, turn, COALESCE(CASE WHEN role = 'system' THEN text END, CASE WHEN trim(lpad('', (turn % 2)::INT, ' ')) <> '' THEN 'x' END, role) AS value FROM conversations"""
)
def first_present(spark, sf_dir):
    """P10: the first candidate column with a value."""
    c = table(spark, sf_dir, "conversations")
    df = c.select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.col("text")).alias("problem"),
        F.repeat(F.lit(" "), (F.col("turn") % 2).cast("int")).alias("question"), F.col("role").alias("input"),
    )
    return df.select("conv_id", "turn", C.first_present(df, C.PROBLEM).alias("value"))


@query(
    """WITH l AS (SELECT conv_id, MAX(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1) SELECT conv_id, turn, role FROM conversations JOIN l USING (conv_id) WHERE last IS NULL OR turn < last"""
)
def prompt_before_last_assistant(spark, sf_dir):
    """The turns before the last answer."""
    return C.turns_before_last_assistant(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query(
    """SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS reference, COUNT(*) AS n FROM conversations GROUP BY conv_id"""
)
def last_assistant(spark, sf_dir):
    """The last answer as the reference."""
    g = C.gather(table(spark, sf_dir, "conversations"))
    return g.select(
        "conv_id", C.reference(F.col("messages")).alias("reference"), F.size("messages").cast("bigint").alias("n")
    )


@query(
    """WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, md5(CASE WHEN t LIKE '%</s>' THEN t ELSE t || '</s>' END) AS digest, length(t)::BIGINT AS n FROM t"""
)
def sft_format(spark, sf_dir):
    """Conversations as training text."""
    g = C.gather(table(spark, sf_dir, "conversations")).select("conv_id", C.chat_text(F.col("messages")).alias("t"))
    return g.select(
        "conv_id", F.md5(C.with_eos(F.col("t"), "</s>").cast("binary")).alias("digest"),
        F.length("t").cast("bigint").alias("n"),
    )


@query("""WITH l AS (SELECT conv_id, MAX(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1), m AS (SELECT c.*, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS t, last IS NULL OR turn < last AS ahead FROM conversations c JOIN l USING (conv_id))
SELECT conv_id, md5(string_agg(t, '' ORDER BY turn)) AS text, md5(coalesce(string_agg(t, '' ORDER BY turn) FILTER (ahead), '') || '<|im_start|>assistant' || chr(10)) AS prompt FROM m GROUP BY 1""")
def chat_template(spark, sf_dir):
    """Training texts and prompts as a tokenizer's chat template has them."""
    g = C.gather(table(spark, sf_dir, "conversations"))
    text, prompt = C.sft_text(g, "</s>", C.CHATML), C.prompt_text(C.prompt_messages(F.col("messages")), C.CHATML)
    return text.select(
        "conv_id", F.md5(F.encode("text", "UTF-8")).alias("text"), F.md5(F.encode(prompt, "UTF-8")).alias("prompt")
    )


@query(
    """WITH t AS (SELECT conv_id, turn, text, role FROM conversations), c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS p, arg_max(text, turn) FILTER (role = 'assistant') AS a, arg_min(text, turn) FILTER (role = 'assistant') AS b FROM t GROUP BY 1) SELECT conv_id, length(p || chr(10) || chr(10))::BIGINT AS prompt_chars, md5(a) AS chosen, md5(b) AS rejected FROM c WHERE a IS NOT NULL AND p IS NOT NULL"""
)
def dpo_format(spark, sf_dir):
    """Preference rows."""
    g = C.gather(table(spark, sf_dir, "conversations"))
    said = lambda r: F.filter("messages", lambda m: m["role"] == r)
    rows = g.select(
        "conv_id", F.array_join(F.transform(said("user"), lambda m: m["content"]), " ").alias("prompt"),
        F.size(said("user")).alias("u"),
        F.element_at(F.when(F.size(said("assistant")) > 0, said("assistant")), -1)["content"].alias("chosen"),
        F.get(said("assistant"), F.lit(0))["content"].alias("rejected"),
    ).where("chosen IS NOT NULL AND u > 0")
    out = rows.select(
        "conv_id", F.concat(C.first_present(rows, C.PROMPT), F.lit("\n\n")).alias("prompt"),
        C.first_present(rows, C.CHOSEN).alias("chosen"), C.first_present(rows, C.REJECTED).alias("rejected"),
    )
    return out.select(
        "conv_id", F.length("prompt").cast("bigint").alias("prompt_chars"),
        F.md5(F.col("chosen").cast("binary")).alias("chosen"),
        F.md5(F.col("rejected").cast("binary")).alias("rejected"),
    )


@query(
    "SELECT COUNT(*) FILTER (length(text) <= 600) AS kept, COUNT(*) FILTER (length(text) > 600) AS dropped FROM conversations"
)
def max_prompt_len_filter(spark, sf_dir):
    """what a length limit keeps and drops."""
    return C.kept_and_dropped(table(spark, sf_dir, "conversations"), F.length("text"), 600)


@query("SELECT c_custkey FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 5")
def seeded_sample(spark, sf_dir):
    """A seeded sample of five."""
    return C.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, 5)


@query(
    """SELECT conv_id, COUNT(*) > 0 AND BOOL_AND(role IS NOT NULL AND text IS NOT NULL) AS conversational FROM conversations GROUP BY conv_id"""
)
def conversational(spark, sf_dir):
    """Whether messages are well formed."""
    return C.gather(table(spark, sf_dir, "conversations")).select(
        "conv_id", C.valid_messages(F.col("messages")).alias("conversational")
    )


@query(
    "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer ORDER BY place LIMIT 50"
)
def sorted_table(spark, sf_dir):
    """A sorted table's first page, blanks last."""
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    top = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).orderBy(
        F.col("v").desc_nulls_last(), "c_custkey"
    ).limit(50)
    from pyspark.sql import Window

    return top.select(
        "c_custkey",
        F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "c_custkey")).cast("bigint").alias("place"),
    )
