"""Record hygiene: validation, last write wins, resume, joins with ground truth, gap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DRY_RUN_RESPONSE


def valid_score(v, scale: int) -> Column:
    """A finite number from 1 to the scale."""
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce(
        c.between(F.lit(1), F.lit(scale)) & ~F.isnan(c.cast("double")) & (c < F.lit(float("inf"))), F.lit(False)
    )


def typed_score(variant: Column, scale: int) -> Column:
    """A score out of parsed JSON: numbers only, neither booleans nor strings; null if illegal."""
    kind = F.schema_of_variant(variant)
    number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    v = F.when(number, F.try_variant_get(variant, "$", "double"))
    return F.when(valid_score(v, scale), v)


def validated_scores(df: DataFrame, raw: str, dims: list[str], scale: int) -> DataFrame:
    """Parses a JSON object of scores; ``average`` is recomputed, null unless all dims are legal."""
    if scale < 1:
        raise ValueError("the scale must be 1 or more")
    v = F.try_parse_json(F.col(raw))
    out = df.withColumn("__v", v)
    for d in dims:
        out = out.withColumn(d, typed_score(F.try_variant_get("__v", f"$.{d}", "variant"), scale))
    total = sum((F.col(d) for d in dims[1:]), F.col(dims[0]))
    return out.withColumn("average", total / len(dims)).drop("__v")


def is_dry_run(df: DataFrame) -> Column:
    flag = F.coalesce(F.col("dry_run"), F.lit(False)) if "dry_run" in df.columns else F.lit(False)
    return flag | F.coalesce(F.col("response") == DRY_RUN_RESPONSE, F.lit(False))


def usable(
    df: DataFrame, models: DataFrame, modes: DataFrame, parse_ok: str = "parse_ok", ptype: str = "ptype"
) -> DataFrame:
    """Records that parsed, of wanted models and modes, with a probe type."""
    return df.where(
        F.col(parse_ok) & F.col(ptype).isNotNull()
    ).join(models, "model", "left_semi").join(modes, "mode", "left_semi")


def canonical(df: DataFrame, aliases: DataFrame, col: str = "model") -> DataFrame:
    """Replaces aliased names: ``aliases`` has (alias, name)."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("name").alias("__n"))
    return df.join(a, F.col(col) == F.col("__a"), "left").withColumn(col, F.coalesce("__n", col)).drop("__a", "__n")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record per key in the given order (columns descending): last write wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_each(df: DataFrame, **values) -> DataFrame:
    """Every row once for each combination of the given short lists: an expansion in place, no join."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, options))))
    return df


def pending(trials: DataFrame, modes: list, models: list, done: DataFrame, id_of) -> DataFrame:
    """Every trial in every mode and model, less the finished ids."""
    grid = with_each(trials, mode=modes, model=models)
    return grid.withColumn("trial_id", id_of(grid)).join(done.select("trial_id"), "trial_id", "left_anti")


def finished(responses: DataFrame) -> DataFrame:
    """Ids that need no new call: no error, a response, and no preview."""
    good = F.col("error").isNull() & F.col("response").isNotNull() & ~is_dry_run(responses)
    return responses.where(good).select("trial_id").distinct()


def units(responses: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Responses with ground truth on both keys: per (keys, model) a map from mode to response."""
    return responses.join(truth, keys).groupBy(*keys, "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "response")))).alias("responses")
    )


def trajectories(rows: DataFrame, keys: list[str], phase: str, value: str, least: int = 2) -> DataFrame:
    """Values in phase order per key, where at least ``least`` phases are there."""
    grouped = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(phase).alias("phase"), F.col(value).alias("value")))).alias("phases")
    )
    return grouped.where(F.size("phases") >= least)


def manifest_filter(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records whose (probe, phase, mode) stands in a manifest's pair of modes."""
    pairs = manifest.selectExpr("probe_id", "phase_idx", "stack(2, arc_mode, other_mode) AS mode").distinct()
    return df.join(pairs, ["probe_id", "phase_idx", "mode"], "left_semi")


def missing_cells(rows: DataFrame, have: DataFrame, keys: list[str], **values) -> DataFrame:
    """Cells of the full grid (rows times short lists) that have no value."""
    return with_each(rows, **values).join(have.select(*keys).distinct(), keys, "left_anti")


def file_gaps(expected: DataFrame, files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, gap): expected files that are missing, and those without a usable row."""
    missing = expected.join(files, key, "left_anti").select(key, F.lit("missing").alias("gap"))
    empty = expected.join(files, key, "left_semi").join(rows, key, "left_anti").select(key, F.lit("empty").alias("gap"))
    return missing.unionByName(empty)
