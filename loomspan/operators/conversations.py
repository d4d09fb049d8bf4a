"""Conversations and training corpora: prompts, references, formats, filters, samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate columns in their order: fixed values.
PROBLEM = ("problem", "question", "prompt", "input", "instruction")
SOLUTION = ("solution", "answer", "completion", "output", "response")
MESSAGES = ("messages", "conversation", "conversations")
PROMPT = ("prompt", "problem", "question", "input", "instruction")
CHOSEN = ("chosen", "chosen_response", "chosen_completion", "chosen_answer", "chosen_solution", "accepted", "winner")
REJECTED = ("rejected", "rejected_response", "rejected_completion", "rejected_answer", "rejected_solution", "loser")


def first_present(df: DataFrame, candidates) -> Column:
    """The first candidate column with a value: blank strings and empty lists are none.

    Raises KeyError where the frame has none of the columns; a row without a value is null.
    """
    have = [c for c in candidates if c in df.columns]
    if not have:
        raise KeyError(f"none of {', '.join(candidates)} in {', '.join(df.columns)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = []
    for c in have:
        kind = kinds[c]
        if kind == "string":
            out.append(F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", F.col(c)))
        elif kind.startswith("array<struct"):
            out.append(F.when(F.size(c) > 0, messages_text(F.col(c))))
        else:
            out.append(F.col(c).cast("string"))
    return F.coalesce(*out)


def messages_text(messages: Column) -> Column:
    """The last assistant message with content, else the last message."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.coalesce(
        F.element_at(F.when(F.size(said) > 0, said), -1)["content"],
        F.element_at(F.when(F.size(messages) > 0, messages), -1)["content"], F.lit(""),
    )


def valid_messages(messages: Column) -> Column:
    return F.coalesce(F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def last_assistant_index(messages: Column) -> Column:
    """0-based index of the last assistant message; null where there is none."""
    return F.array_max(
        F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    )


def prompt_messages(messages: Column) -> Column:
    """Messages before the last assistant message; all of them where there is none."""
    i = last_assistant_index(messages)
    return F.when(i.isNull(), messages).otherwise(F.slice(messages, F.lit(1), i))


def reference(messages: Column) -> Column:
    """Content of the last assistant message."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def with_eos(text: Column, eos: str | None) -> Column:
    return text if not eos else F.when(F.endswith(text, F.lit(eos)), text).otherwise(F.concat(text, F.lit(eos)))


@dataclass(frozen=True)
class ChatTemplate:
    """A tokenizer's chat template, as the marks around each message; ``{role}`` stands for the role.

    ``generation`` opens the answer that a model is to give.
    """

    before: str
    after: str
    start: str = ""
    generation: str = ""

    def text(self, messages: Column, generation: bool = False) -> Column:
        mark = lambda s, m: F.replace(F.lit(s), F.lit("{role}"), m["role"])
        body = F.array_join(
            F.transform(messages, lambda m: F.concat(mark(self.before, m), m["content"], mark(self.after, m))), ""
        )
        return F.concat(F.lit(self.start), body, F.lit(self.generation if generation else ""))


#: A widespread template, as an example of one.
CHATML = ChatTemplate("<|im_start|>{role}\n", "<|im_end|>\n", generation="<|im_start|>assistant\n")


def chat_text(messages: Column, eos: str | None = None, template: ChatTemplate | None = None) -> Column:
    """Messages as the tokenizer's template has them; without one, "role: content" blocks, a blank line between."""
    if template is not None:
        return template.text(messages)
    return with_eos(
        F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n\n"), eos
    )


def prompt_text(messages: Column, template: ChatTemplate | None = None) -> Column:
    """The prompt of a conversation as text, ready for an answer."""
    return F.concat(
        chat_text(messages), F.lit("\n\n")
    ) if template is None else template.text(messages, generation=True)


def sft_text(df: DataFrame, eos: str | None = None, template: ChatTemplate | None = None) -> DataFrame:
    """Supervised examples as one text: conversations as blocks, else prompt, blank line, completion."""
    if any(c in df.columns for c in MESSAGES):
        col = next(c for c in MESSAGES if c in df.columns)
        return df.withColumn("text", chat_text(F.col(col), eos, template))
    return df.withColumn(
        "text", with_eos(F.concat_ws("\n\n", first_present(df, PROBLEM), first_present(df, SOLUTION)), eos)
    )


def dpo_rows(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected); the prompt ends in a blank line."""
    return df.select(
        F.concat(first_present(df, PROMPT), F.lit("\n\n")).alias("prompt"), first_present(df, CHOSEN).alias("chosen"),
        first_present(df, REJECTED).alias("rejected"),
    )


def rollout_prompt(df: DataFrame) -> Column:
    """System and user prompt of a generation row: given ones, else scenario and question."""
    have = set(df.columns)
    pick = lambda *c: F.coalesce(
        *[F.when(F.trim(x) != "", F.col(x)) for x in c if x in have], F.lit(None).cast("string")
    )
    parts = [F.col(c) for c in ("scenario", "question") if c in have]
    user = F.coalesce(pick("gen_user"), F.concat_ws("\n\n", *parts)) if parts else pick("gen_user")
    return F.struct(pick("gen_system").alias("system"), user.alias("user"))


def not_yet_rolled_out(df: DataFrame, done: DataFrame, index: str = "index") -> DataFrame:
    """Rows whose index has no output yet."""
    return df.join(done.select(index), index, "left_anti")


def turns_before_last_assistant(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role"
) -> DataFrame:
    """The same as :func:`prompt_messages` over one row per turn."""
    last = F.max(F.when(F.col(role) == "assistant", F.col(turn))).over(Window.partitionBy(conv))
    return turns.withColumn("__last", last).where(
        F.col("__last").isNull() | (F.col(turn) < F.col("__last"))
    ).drop("__last")


def within_length(df: DataFrame, n: Column, most: int) -> DataFrame:
    """Rows whose prompt fits; see :func:`kept_and_dropped` for the report."""
    return df.where(n <= most)


def kept_and_dropped(df: DataFrame, n: Column, most: int) -> DataFrame:
    return df.agg(F.count_if(n <= most).alias("kept"), F.count_if(n > most).alias("dropped"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement, the same for the same seed: the lowest keyed hashes.  A top-k, no full sort."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def gather(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Turns to message arrays, in order.  A conversation is one training example and must fit a row."""
    m = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content")))
    )
    return turns.groupBy(conv).agg(
        F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )
