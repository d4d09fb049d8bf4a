"""Identifiers: what can be read out of them and how they are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags inside probe ids and the probe types they stand for: fixed values.
PROBE_TYPES = {"intext": "in_text", "inworld": "in_world", "outworld": "out_of_world"}
#: Judge families in the order they are looked for: fixed values.
FAMILIES = ("gpt", "deepseek", "claude", "qwen", "llama")
#: Settings that out-of-world probes are moved to, in order: fixed values.
ERAS = (
    "modern_urban", "industrial_early_20th", "mid_century", "pre_industrial_agrarian", "speculative_near_future",
    "pre_modern_imperial", "diasporic_contemporary",
)
DEFAULT_LIFE_STAGE = "adult"


def probe_type(probe_id: Column, anchored: bool = False) -> Column:
    """Probe type out of an id; null where it names none.  Anchored: the id must end in ``_a<n>``."""
    tag = F.regexp_extract(probe_id, r"_(intext|inworld|outworld)_" + (r"a(\d+)$" if anchored else ""), 1)
    return F.create_map(*[F.lit(x) for kv in PROBE_TYPES.items() for x in kv])[F.nullif(tag, F.lit(""))]


def family_tag(model: Column) -> Column:
    """Judge family, or a file-safe tail of the model's name."""
    low = F.lower(F.coalesce(model, F.lit("")))
    tail = F.element_at(F.split(low, "/"), -1)
    safe = F.substring(F.regexp_replace(F.when(tail == "", "judge").otherwise(tail), r"[^\p{L}\p{N}-]", "-"), 1, 32)
    out = None
    for f in FAMILIES:
        out = F.when(F.contains(low, F.lit(f)), f) if out is None else out.when(F.contains(low, F.lit(f)), f)
    return out.otherwise(safe)


def safe_model(model: Column) -> Column:
    return F.translate(model, "/:", "__")


def trial_id(probe_id: Column, phase: Column, mode: Column, model: Column) -> Column:
    return F.concat_ws("__", probe_id, F.concat(F.lit("p"), phase.cast("string")), mode, safe_model(model))


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16)


def era(axis_id: Column, phase: Column) -> Column:
    """Distinct settings for an axis's phases: a hash picks the first, the phase walks on."""
    n = len(ERAS)
    first = F.conv(F.substring(F.sha1(F.encode(axis_id, "UTF-8")), 1, 8), 16, 10).cast("long") % n
    return F.element_at(F.array(*map(F.lit, ERAS)), (F.pmod(first + phase, F.lit(n)) + 1).cast("int"))


def slug(name: Column) -> Column:
    """Lower case without , . ' ( ), spaces as underscores."""
    return F.translate(F.translate(F.lower(name), ",.'()", ""), " ", "_")


def character_slug(name: Column, known: Column) -> Column:
    """The slug a character list gives, else the rule's."""
    return F.coalesce(known[name], slug(name))


def result_file(name: Column) -> Column:
    """Struct (mode, model) of ``<mode>__<model>.jsonl``; null for other names."""
    x = r"^(.*?)__(.*)\.jsonl$"
    return F.when(
        name.rlike(x), F.struct(F.regexp_extract(name, x, 1).alias("mode"), F.regexp_extract(name, x, 2).alias("model"))
    )


def records_file(tag: Column, include_thought: Column, kind: str = "eval_records") -> Column:
    """Name of a judge's record file; the ablation without thoughts has its own."""
    return F.concat(F.lit(f"{kind}_"), tag, F.when(include_thought, "").otherwise("_nothought"), F.lit(".jsonl"))


def vocabulary_rank(value: Column, order) -> Column:
    """Place in a fixed vocabulary, for sorting; what it lacks comes last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def chapter_number(path: Column) -> Column:
    """N of ``chapter_N.txt``; null for other names."""
    n = F.regexp_extract(path, r"chapter_(\d+)\.txt$", 1)
    return F.when(n != "", n.cast("int"))


def midpoint(lo: Column, hi: Column) -> Column:
    """Middle chapter of a range, floored; 1 where the range is missing."""
    return F.coalesce(F.floor((lo + hi) / 2).cast("int"), F.lit(1))


def phase_fit(read: Column, target: Column, n: Column) -> Column:
    """"pass", "adjacent" or "off_phase" for the phase a reader took a response for."""
    inside = (read >= 0) & (read < n)
    return F.when(read.isNull() | ~inside, "off_phase").when(read == target, "pass").when(
        F.abs(read - target) == 1, "adjacent"
    ).otherwise("off_phase")
