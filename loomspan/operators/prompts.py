"""Prompt texts as column expressions.  ``concat_ws`` skips nulls, so an optional section that
is not there leaves no gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording that responses and hashes depend on: fixed values.
EXPERT_SYSTEM = "You are a helpful and accurate assistant."


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def filled(c: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    t = F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return F.when(t != "", t)


def system(character, novel, chapter, axis_type, target, context) -> Column:
    head = _s(
        "You are ", character, ', from "', novel, '". You are at the point in the story corresponding to chapter ',
        chapter, ".",
    )
    partner = F.when(
        (axis_type == "relational") & (F.coalesce(target, F.lit("")) != ""),
        _s("You are interacting with ", target, "."),
    )
    return F.concat_ws(
        "\n\n", head, partner, _s("Background you have access to:\n<context>\n", filled(context), "\n</context>")
    )


def user(scenario, question, hint=None) -> Column:
    base = _s("Scenario:\n", scenario, "\n\nQuestion:\n", question)
    if hint is None:
        return base
    return F.concat_ws("\n", base, _s("(HINT: ", filled(hint), ")"))


def future_hint(character) -> Column:
    return _s(
        "Note that the period of the question is in the future relative to ", character,
        "'s time point. Therefore, you should not answer the question or mention any facts that occurred after ",
        character, "'s time point.",
    )


def absent_hint(character) -> Column:
    return _s(
        "Note that ", character,
        " had not participated in the scene described in the question. Therefore, you should not imply that ",
        character, " was present in the scene.",
    )


def time_hint(character, predicted, query_chapter, presence) -> Column:
    """Hint of the narrative experts: future first; absence only where not future; else null."""
    future = F.coalesce(predicted > query_chapter, F.lit(False))
    return F.when(future, future_hint(character)).when(presence == "absent", absent_hint(character))


def or_none(c: Column) -> Column:
    """A blank optional field as "none"."""
    return F.coalesce(filled(c), F.lit("none"))


def phases_block(phases: Column, cap: int = 140) -> Column:
    """One line a phase, in order, its description capped."""
    line = lambda p: _s(
        "Phase ", p["phase_idx"], " (", p["label"], "): ",
        F.substring(F.coalesce(p["position_description"], F.lit("")), 1, cap),
    )
    return F.array_join(F.transform(F.array_sort(phases), line), "\n")


def contrasts_block(contrasts: Column) -> Column:
    line = lambda c: _s("Phase ", c["from_phase_idx"], " -> ", c["to_phase_idx"], ": ", c["contrast"])
    return F.array_join(F.transform(contrasts, line), "\n")


def candidates_block(events: Column, most: int = 30) -> Column:
    line = lambda e: _s("[", e["event_id"], "] ch. ", e["chapter"], ": ", e["description"])
    return F.array_join(F.transform(F.slice(events, 1, most), line), "\n")


def judge_user(character, novel, phase_label, scenario, question, action, speech, thought, response) -> Column:
    """A judge's request: the reference fields, blanks as "none", and the response."""
    return F.concat_ws(
        "\n\n", _s("Character: ", character, "\nNovel: ", novel, "\nPhase: ", or_none(phase_label)),
        _s("Scenario:\n", scenario), _s("Question:\n", question),
        _s(
            "Reference action: ", or_none(action), "\nReference speech: ", or_none(speech), "\nReference thought: ",
            or_none(thought),
        ),
        _s("Response:\n", response),
    )


def lifechoice(description: Column, memories: Column) -> Column:
    """Two labelled sections; null without a description."""
    return F.when(
        filled(description).isNotNull(),
        F.concat_ws("\n\n", _s("[Description]\n", filled(description)), _s("[Memories]\n", filled(memories))),
    )


def lifechoice_query(description: Column, scenario: Column, question: Column, cap: int = 30_000) -> Column:
    return F.substring(F.concat_ws("\n", description, scenario, question), 1, cap)
