"""Hierarchical scoring: pools, macro means, roll-ups, lifts and best modes.

Means are exact: scores are summed as decimals and divided once, so a result does not
depend on the order or partitioning of its rows.  Every aggregate here has a partial form,
so a shuffle carries one row per group and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE = "decimal(20,6)"


def exact_mean(value) -> Column:
    """Mean of the non-null values: decimal sum, one division."""
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(v.cast(SCORE)).cast("double") / F.count(v)


def row_mean(*dims: str, strict: bool = False) -> Column:
    """Mean of the dimensions that are present in a row; null if none (strict: unless all) are."""
    cols = [F.col(d).cast("double") for d in dims]
    there = F.filter(F.array(*cols), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)
    return F.when(F.size(there) >= (len(dims) if strict else 1), mean)


def pool(df: DataFrame, keys: list[str], value: str, name: str = "mean") -> DataFrame:
    """Pooled mean and count of a value per key."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(exact_mean(value).alias(name), F.count("*").alias("n"))


def macro_mean(df: DataFrame, outer: list[str], inner: list[str], value: str, name: str = "mean") -> DataFrame:
    """Two levels: the pooled mean of each (outer, inner), then their unweighted mean per outer.

    An inner group without a value does not count.
    """
    return pool(df, [*outer, *inner], value, "m").groupBy(*outer).agg(F.avg("m").alias(name), F.count("*").alias("n"))


def summary(df: DataFrame, keys: list[str], dims: list[str], digits: int = 3) -> DataFrame:
    """Rounded means of each dimension, of the rows' averages, and the count."""
    rows = df.withColumn("__avg", row_mean(*dims, strict=True))
    return rows.groupBy(*keys).agg(
        *[F.round(exact_mean(d), digits).alias(d) for d in dims], F.round(exact_mean("__avg"), digits).alias("average"),
        F.count("*").alias("n"),
    )


def phase_bucket(n: str) -> Column:
    """Number of phases as "2" (two or fewer), "3", "4" or "5+"."""
    c = F.col(n)
    return F.when(c <= 2, "2").when(c == 3, "3").when(c == 4, "4").otherwise("5+")


def grains(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Several grains of one pool in one pass (grouping sets); absent keys are null, ``grain`` names the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    name = reduce(lambda a, b: F.concat(a, b), [F.when(F.grouping(k) == 0, F.lit(f"{k} ")).otherwise("") for k in keys])
    return df.groupingSets(
        [[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]
    ).agg(F.trim(name).alias("grain"), *aggs)


def mean_of_rounded(df: DataFrame, outer: list[str], inner: list[str], value: str, digits: int = 2) -> DataFrame:
    """Mean of already rounded inner means, rounded again: not the same as :func:`macro_mean`."""
    return pool(df, [*outer, *inner], value, "m").groupBy(*outer).agg(
        F.round(F.avg(F.round("m", digits)), digits).alias("mean"), F.count("*").alias("n")
    )


def lift(df: DataFrame, keys: list[str], mode: str, value: str, target: str, base: str) -> DataFrame:
    """Target mode minus base mode; null where either is missing."""
    at = lambda m: F.max(F.when(F.col(mode) == m, F.col(value)))
    return df.groupBy(*keys).agg(
        at(target).alias("target"), at(base).alias("base")
    ).withColumn("lift", F.col("target") - F.col("base"))


def lift_over_best(df: DataFrame, keys: list[str], mode: str, rank: str, value: str, target: str) -> DataFrame:
    """Target mode minus the best of the others, and which that was (ties: the first by ``rank``)."""
    other = F.when(
        (F.col(mode) != target) & F.col(value).isNotNull(),
        F.struct(F.col(value).alias("v"), (-F.col(rank)).alias("r"), F.col(mode).alias("m")),
    )
    out = df.groupBy(*keys).agg(
        F.max(F.when(F.col(mode) == target, F.col(value))).alias("target"), F.max(other).alias("o")
    )
    return out.select(
        *keys, "target", F.col("o.v").alias("best_other"), F.col("o.m").alias("best_other_mode"),
        (F.col("target") - F.col("o.v")).alias("lift"),
    )


def best_mode(df: DataFrame, keys: list[str], mode: str, rank: str, value: str) -> DataFrame:
    """The mode with the highest value; ties go to the first by ``rank``."""
    best = F.max(
        F.when(
            F.col(value).isNotNull(),
            F.struct(F.col(value).alias("v"), (-F.col(rank)).alias("r"), F.col(mode).alias("m")),
        )
    )
    return df.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.m").alias("best_mode"), F.col("b.v").alias("value")
    )


def probe_overall(phase_avg: str, trajectory: str) -> Column:
    """(3 phase + trajectory) / 4, or the one that is there."""
    a, p = F.col(phase_avg), F.col(trajectory)
    return F.coalesce((3 * a + p) / 4, a, p)


def cell_value(df: DataFrame, keys: list[str], filters: dict, value: str) -> DataFrame:
    """Mean of the non-null cells that match; a filter of None or "all" takes every cell."""
    for k, v in filters.items():
        if v not in (None, "all"):
            df = df.where(F.col(k) == v)
    return df.groupBy(*keys).agg(F.avg(value).alias("value"))


def wins(df: DataFrame, keys: list[str], lift_col: str = "lift") -> DataFrame:
    """How often the lift is positive, and its range."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(lift_col) > 0).alias("wins"), F.count(lift_col).alias("of"), F.min(lift_col).alias("least"),
        F.max(lift_col).alias("most"),
    )


def pivot_cells(df: DataFrame, keys: list[str], column: str, values: list, value: str) -> DataFrame:
    """Long to wide over a fixed list of columns, with the mean of the cells that are there."""
    wide = df.groupBy(*keys).pivot(column, values).agg(F.max(value))
    cells = [F.col(f"`{v}`") for v in values]
    there = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return wide.withColumn(
        "overall", F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    )


def flag_block_max(df: DataFrame, block: list[str], value: str, within: float = 1e-9) -> DataFrame:
    """Marks the values that equal their block's maximum."""
    top = F.max(value).over(Window.partitionBy(*block))
    return df.withColumn("is_best", F.coalesce(F.abs(F.col(value) - top) < within, F.lit(False)))


def display_score(df: DataFrame, keys: list[str], model: str, value: str, preferred: str, fallback: str) -> DataFrame:
    """Score of the preferred model, else the fallback's, else the first one by name that has a score."""
    at = lambda m: F.max(F.when(F.col(model) == m, F.col(value)))
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(model).alias("m"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.coalesce(at(preferred), at(fallback), first["v"]).alias("score"))


def class_means(df: DataFrame, classes: DataFrame, keys: list[str], unit: str, value: str) -> DataFrame:
    """Two weightings side by side: all probes pooled, and the unweighted mean over units.

    ``classes``: (unit, central boolean); a unit it lacks is supporting.
    """
    tagged = df.join(classes, unit, "left").withColumn(
        "class", F.when(F.coalesce(F.col("central"), F.lit(False)), "central").otherwise("supporting")
    )
    per_unit = tagged.where(F.col(value).isNotNull()).groupBy(*keys, "class", unit).agg(
        F.sum(F.col(value).cast(SCORE)).alias("s"), F.count("*").alias("c")
    )
    return per_unit.groupBy(*keys, "class").agg(
        (F.sum("s").cast("double") / F.sum("c")).alias("probe_pool"),
        F.avg(F.col("s").cast("double") / F.col("c")).alias("unit_mean"), F.count("*").alias("units"),
    )
