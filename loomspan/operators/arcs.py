"""Arcs: visibility, votes, critics, timelines, stubs, and probes' nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import with_each

SPOILERS = ("literary_validation", "evidence_summary")
ENDING = ("pole_end", "arc_direction")
VOTES_NEEDED = 2


def visible_phases(trajectory: Column, query_chapter: Column) -> Column:
    """Phases that have begun by the query chapter; a phase without a range never has."""
    return F.filter(trajectory, lambda p: F.coalesce(p["lo"] <= query_chapter, F.lit(False)))


def curate(axes: DataFrame, query_chapter: str, trajectory: str = "trajectory") -> DataFrame:
    """Axes as a query may see them: no spoiler fields, visible phases only, and no ending while phases are hidden."""
    seen = visible_phases(F.col(trajectory), F.col(query_chapter))
    hidden = F.size(seen) < F.size(F.coalesce(F.col(trajectory), F.array().cast(axes.schema[trajectory].dataType)))
    out = axes.withColumn("__hidden", hidden).withColumn(trajectory, seen)
    for c in ENDING:
        if c in axes.columns:
            out = out.withColumn(c, F.when(~F.col("__hidden"), F.col(c)))
    return out.drop("__hidden", *SPOILERS)


def vote_totals(
    votes: DataFrame, axes: DataFrame, keys: list[str], annotator: str = "annotator", validity: str = "validity",
    order: list[Column] | None = None, needed: int = VOTES_NEEDED,
) -> DataFrame:
    """Votes per axis: the annotator's last vote counts, ``kept`` from ``needed`` valid ones.

    Axes without votes and votes without an axis are left out (see :func:`orphans`).
    """
    w = Window.partitionBy(*keys, annotator).orderBy(*(order or [F.col(validity).desc()]))
    last = votes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    agg = last.groupBy(*keys).agg(
        F.count_if(F.col(validity) == "valid").alias("valid_votes"), F.count("*").alias("n_annotators"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col(annotator).alias("k"), F.col(validity).alias("v"))))
        ).alias("votes"),
    )
    return axes.join(agg, keys).withColumn("kept", F.col("valid_votes") >= needed)


def file_validity(validity: Column, file_name: Column) -> Column:
    """In numbered annotation files a partial vote counts as valid."""
    return F.when(
        (validity == "partial") & file_name.rlike(r"_annotations[^/]*\d[^/]*\.json$"), "valid"
    ).otherwise(validity)


def orphans(votes: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.join(axes, keys, "left_anti").select(*keys).distinct()


def critic_tag(confirmed: Column) -> Column:
    """Confirmations of the ensemble as a tag: two make valid, one partial."""
    return F.when(confirmed >= 2, "valid").when(confirmed == 1, "partial").otherwise("none")


def critic_ensemble(axes: DataFrame, verdicts: DataFrame, evaluators: list, keys: list[str]) -> DataFrame:
    """A critic confirms with a true verdict and a citation; a missing one does not."""
    grid = with_each(axes, evaluator=evaluators).join(verdicts, [*keys, "evaluator"], "left")
    confirmed = F.coalesce(F.col("verdict"), F.lit(False)) & (F.coalesce(F.size("citations"), F.lit(0)) >= 1)
    return grid.groupBy(*keys).agg(
        F.count_if(confirmed).alias("confirmed"), F.count("verdict").alias("answered")
    ).withColumn("tag", critic_tag(F.col("confirmed")))


def timeline(phases: DataFrame, key: str, idx: str, lo: str, hi: str, last: DataFrame) -> DataFrame:
    """Segments of a timeline: a gap before each phase where chapters lie between, the phase itself
    (clamped to what is not yet covered, one wide at least), and a gap at the end.

    ``last``: (key, max_chapter).
    """
    w = Window.partitionBy(key).orderBy(idx)
    cursor = F.greatest(
        F.lit(1), F.coalesce(F.max(F.col(hi) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    )
    rows = phases.withColumn("__cursor", cursor)
    start = F.greatest(F.col(lo), F.col("__cursor"))
    segments = F.array_compact(F.array(
        F.when(
            F.col(lo) > F.col("__cursor"),
            F.struct(F.lit(True).alias("gap"), (F.col(lo) - F.col("__cursor")).cast("int").alias("width")),
        ),
        F.struct(F.lit(False).alias("gap"), F.greatest(F.col(hi) - start + 1, F.lit(1)).cast("int").alias("width")),
    ))
    inner = rows.select(
        key, F.col(idx).cast("int").alias("idx"), F.explode(segments).alias("s")
    ).select(key, "idx", "s.gap", "s.width")
    ends = phases.groupBy(key).agg(
        F.greatest(F.lit(1), F.max(F.col(hi) + 1)).alias("__end")
    ).join(last, key).where("__end <= max_chapter")
    return inner.union(
        ends.select(key, F.lit(None).cast("int"), F.lit(True), (F.col("max_chapter") - F.col("__end") + 1).cast("int"))
    )


def neighbours(df: DataFrame, by: list[str], order: list[str], col: str) -> DataFrame:
    """Position from 1 and the rows before and after."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns(
        {"position": F.row_number().over(w), "previous": F.lag(col).over(w), "next": F.lead(col).over(w)}
    )


def adjacent_pairs(df: DataFrame, by: list[str], order: str, col: str) -> DataFrame:
    """Each phase with the one after it."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(
        *by, F.col(order).alias("from_idx"), F.lead(order).over(w).alias("to_idx"), F.col(col).alias("from_value"),
        F.lead(col).over(w).alias("to_value"),
    ).where(F.col("to_idx").isNotNull())


def with_stub(families: DataFrame, axes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Axis fields by key; where the axis is missing, the family's own stand in, marked as a stub."""
    a = axes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in cols], F.lit(True).alias("__there"))
    j = families.join(a, key, "left")
    return j.withColumns(
        {c: F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)) for c in cols}
    ).withColumn("stub", F.col("__there").isNull()).drop("__there", *[f"__{c}" for c in cols])


def normalise_phases(responses: DataFrame, probe: str, idx: str, n: str, order: list[Column]) -> DataFrame:
    """Per probe the first response of each phase, in order; a probe without exactly 0..n-1 goes."""
    w = Window.partitionBy(probe, idx).orderBy(*order)
    first = responses.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    whole = Window.partitionBy(probe)
    inside = (F.min(idx).over(whole) == 0) & (
        F.max(idx).over(whole) == F.col(n) - 1
    ) & (F.count("*").over(whole) == F.col(n))
    return first.withColumn("__ok", inside).where("__ok").drop("__ok")


def unnest_trials(probes: DataFrame, include_unavailable: bool = False) -> DataFrame:
    """One row per probe and phase out of a probe file's families, with the defaults of missing fields."""
    f = probes.select("novel", "character", F.explode("families").alias("f"))
    p = f.select(
        "novel", "character", F.col("f.axis_id").alias("axis_id"),
        F.coalesce("f.axis_type", F.lit("intrapersonal")).alias("axis_type"), F.explode("f.probes").alias("p"),
    )
    r = p.select(
        "novel", "character", "axis_id", "axis_type", F.col("p.probe_id").alias("probe_id"),
        F.col("p.probe_type").alias("probe_type"), F.col("p.scenario").alias("scenario"),
        F.explode("p.phase_responses").alias("r"),
    )
    if not include_unavailable:
        r = r.where(~F.coalesce(F.col("r.unavailable"), F.lit(False)))
    return r.select(
        "novel", "character", "axis_id", "axis_type", "probe_id", "probe_type", "scenario",
        F.col("r.phase_idx").alias("phase_idx"), F.col("r.query_chapter").alias("query_chapter"),
    )


def weak_pairs(probes: DataFrame, probe: str, pairs: str, labels: str) -> DataFrame:
    """Weak pairs as rows, with the labels of both phases."""
    x = probes.select(probe, labels, F.explode(pairs).alias("w"))
    at = lambda c: F.get(F.col(labels), F.col(c))
    return x.select(
        probe, F.col("w.from_idx").alias("from_idx"), F.col("w.to_idx").alias("to_idx"), "w.separation",
        at("w.from_idx").alias("from_label"), at("w.to_idx").alias("to_label"),
    )


def drop_verdict(ptype: Column, anchor: Column, world: Column) -> Column:
    """Whether a probe goes: in-text probes by a failed anchor check, others by a failed world check."""
    return F.coalesce(F.when(ptype == "in_text", anchor).otherwise(world) == "fail", F.lit(False))


def verdict_or_fail(verdict: Column, error: Column, failed: str = "fail") -> Column:
    """A validator whose call failed counts as failed."""
    return F.when(error.isNotNull() | verdict.isNull(), failed).otherwise(verdict)


def annotations(responses: Column, ptype: Column, anchor: Column) -> Column:
    """Notes on a probe's responses that were read as another phase: adjacent ones, and in-text
    counterfactuals away from the anchor that missed theirs.  The wording is a fixed value.
    """
    at = lambda r: r["quality"]["phase_fit"]["most_likely_phase_idx"].cast("string")
    head = lambda r: F.concat(F.lit("P"), r["phase_idx"].cast("string"), F.lit(": "))

    def note(r):
        fit = r["quality"]["phase_fit"]["verdict"]
        tail = F.concat(
            head(r), F.lit("auto-marked plausible_tail (Q-PhaseFit placed response at P"), at(r), F.lit(")")
        )
        missed = F.concat(
            head(r), F.lit("① non-anchor counterfactual placed at P"), at(r), F.lit(" — kept for analysis, not dropped")
        )
        return F.when(fit == "adjacent", tail).when(
            (fit == "off_phase") & (ptype == "in_text") & (r["phase_idx"] != anchor), missed
        )

    return F.array_compact(F.transform(responses, note))


def generation_filter(
    axes: DataFrame, stage: str = "stage", tag: str = "validation_tag", wanted: list | None = None, key: str = "axis_id"
) -> DataFrame:
    """Axes to make probes for: human-validated ones are final, of others those the critics rejected
    go; optionally only the wanted ids.
    """
    keep = (F.col(stage) == "final_validated") | ~F.coalesce(F.col(tag) == "none_axis", F.lit(False))
    return axes.where(keep & F.col(key).isin(wanted) if wanted is not None else keep)


def flatten_events(blocks: DataFrame) -> DataFrame:
    """One row per event out of chapter blocks (novel, character, chapter, events); missing fields are empty."""
    e = blocks.select("novel", "character", "chapter", F.explode("events").alias("e")).where("e IS NOT NULL")
    return e.select(
        "novel", "character", "chapter", F.coalesce("e.event_id", F.lit("")).alias("event_id"),
        F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.characters_involved", F.array()).alias("characters_involved"),
    )


def annotation_votes(files: DataFrame) -> DataFrame:
    """Votes out of annotation files (path, entries map of axis key to (character, annotator_id, axis_id, validity)).

    The axis id is the key's where the entry has none; entries without character or annotator
    are skipped; of an annotator's votes the one in the last file by name counts.
    """
    e = files.select("path", F.explode("entries").alias("axis_key", "e"))
    v = e.select(
        "path", F.col("e.character").alias("character"), F.coalesce("e.axis_id", "axis_key").alias("axis_id"),
        F.col("e.annotator_id").alias("annotator"), file_validity(F.col("e.validity"), F.col("path")).alias("validity"),
    )
    full = v.where("coalesce(character, '') <> '' AND coalesce(annotator, '') <> '' AND coalesce(axis_id, '') <> ''")
    from .records import latest

    return latest(
        full, ["character", "axis_id", "annotator"], [F.col("path").desc()]
    ).select("character", "axis_id", "annotator", "validity")


def needs_retry(voice: Column, fit: Column) -> Column:
    return F.coalesce(voice == "fail", F.lit(False)) | F.coalesce(fit == "off_phase", F.lit(False))


def after_retry(voice: Column, fit: Column, new_called: Column, new_voice: Column, new_fit: Column) -> Column:
    """Struct (retry_count, unavailable, reason) of a phase after its one regeneration."""
    failing = needs_retry(voice, fit)
    still = needs_retry(new_voice, new_fit)
    return F.struct(
        F.when(failing, 1).otherwise(0).alias("retry_count"),
        (failing & (~new_called | still)).alias("unavailable"),
        F.when(failing & ~new_called, "regen call failed").when(
            failing & still, "validator still fails after retry"
        ).alias("unavailable_reason"),
    )


def typicality(fit: Column, typical: Column) -> Column:
    """An adjacent reading makes a response a plausible tail."""
    return F.when(fit == "adjacent", "plausible_tail").otherwise(typical)


def life_stages(given: DataFrame, axes: DataFrame, key: str, n: str) -> DataFrame:
    """A life stage for each phase of each axis: out-of-range ones go, missing ones are adult."""
    all_phases = axes.where(F.col(n) > 0).select(key, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("phase_idx"))
    return all_phases.join(given, [key, "phase_idx"], "left").withColumn(
        "life_stage", F.coalesce("life_stage", F.lit("adult"))
    )


def probe_view(probe: DataFrame) -> DataFrame:
    """Display form of a probe: references by phase with their verdicts, the probe's check notes, its weak pairs.

    ``probe``: (probe_id, phase_responses array, probe_check struct(anchor, world, discrimination)).
    """
    ref = lambda r: F.struct(
        r["phase_idx"].alias("phase_idx"), r["gt_action"].alias("action"), r["gt_speech"].alias("speech"),
        r["gt_thought"].alias("thought"), r["quality"]["voice"]["verdict"].alias("voice"),
        r["quality"]["phase_fit"]["verdict"].alias("fit"),
    )
    return probe.select(
        "probe_id",
        F.transform(
            F.array_sort("phase_responses", lambda a, b: (a["phase_idx"] - b["phase_idx"]).cast("int")), ref
        ).alias("refs"),
        F.coalesce("probe_check.anchor.note", "probe_check.world.note").alias("note"),
        F.coalesce("probe_check.discrimination.weak_pairs", F.array()).alias("weak_pairs"),
    )


def abstract_ready(phases: Column, n: Column) -> Column:
    """An out-of-world probe needs one abstract phase for each phase."""
    return F.coalesce(F.size(phases) == n, F.lit(False))


def name_by_slug(characters: DataFrame, slugs: DataFrame) -> DataFrame:
    """Names by slug; a slug the list lacks is spelled out with capitals."""
    known = characters.select(F.col("slug"), F.col("character").alias("__name"))
    return slugs.join(known, "slug", "left").withColumn(
        "character", F.coalesce("__name", F.initcap(F.translate("slug", "_", " ")))
    ).drop("__name")


def arc_view(arc: DataFrame, citations: int = 4) -> DataFrame:
    """Display form of an axis: critics as a list out of their map, citations trimmed."""
    critic = lambda e: F.struct(
        e["key"].alias("evaluator"), e["value"]["verdict"].alias("verdict"),
        F.slice(e["value"]["citations"], 1, citations).alias("citations"),
    )
    return arc.withColumn("critics", F.transform(F.array_sort(F.map_entries("evaluators")), critic)).drop("evaluators")
