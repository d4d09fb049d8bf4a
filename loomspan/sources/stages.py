"""Which of several versions of an input counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROBE_FOLDERS = ("probes", "probes_v1", "probes_v2", "probes_v3")
#: Orders of preference by use: generation, display, annotation.
GENERATION = ("validated", "stamped", "final_auto")
DISPLAY = ("validated", "grounded", "final")
ANNOTATION = ("grounded", "final")


def first_stage(have: DataFrame, keys: list[str], stage: str, order) -> DataFrame:
    """Per key the row of the stage that comes first in ``order``; other stages do not count."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(stage))
    w = Window.partitionBy(*keys).orderBy("__rank")
    return have.withColumn("__rank", rank).where("__rank > 0").withColumn(
        "__rn", F.row_number().over(w)
    ).where("__rn = 1").drop("__rank", "__rn")


def axes_stage(files: DataFrame, keys: list[str], explicit: str | None = None) -> DataFrame:
    """Axis file per character: an explicit stage, else validated, the probe file's stamped
    source where its file exists, then the automatic one.

    ``files``: keys, stage (validated, stamped, final_auto, ...), exists boolean.
    """
    if explicit:
        return files.where(F.col("exists") & (F.col("stage") == explicit))
    return first_stage(files.where("exists"), keys, "stage", GENERATION)
