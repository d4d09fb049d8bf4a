"""What is made of the answers of external models.

The calls themselves are in :mod:`loomspan.operators.calls`, running state in
:mod:`loomspan.operators.folds`; their names can be had from here too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import RESULT, call_models, judged, metering, stub_client
from .folds import fold

__all__ = ["RESULT", "call_models", "flagged_names", "fold", "judged", "keep_unless_rejected", "locate", "metering", "stub_client"]


def keep_unless_rejected(names: DataFrame, verdicts: DataFrame, key: str = "name") -> DataFrame:
    """Extracted names stay unless a verdict says plainly that they are none; a failed check keeps all."""
    bad = verdicts.where(F.col("verdict") == "not_a_character").select(key).distinct()
    return names.join(bad, key, "left_anti")


def flagged_names(names: DataFrame, verdicts: DataFrame, present: str, key: str = "name") -> DataFrame:
    """``(key, verdict, reason)`` of the names that the text does not hold (``present`` false).

    Anything but a plain no counts as real; without a verdict, because the check failed or left
    the name out, the reason says so.
    """
    v = verdicts.select(key, F.col("verdict").alias("__v"), F.col("reason").alias("__r"), F.lit(True).alias("__there"))
    no = F.col("__v") == "not_a_character"
    return names.where(~F.col(present)).join(v, key, "left").select(
        key, F.when(no, "not_a_character").otherwise("real").alias("verdict"),
        F.when(F.col("__there"), F.coalesce("__r", F.lit(""))).otherwise("judge unavailable — kept").alias("reason"),
    )


def locate(candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Event per scene: the answered one, the first candidate where the call failed, nothing where
    the answer is no event; without candidates the midpoint chapter stands in.

    ``candidates``: (key, candidates array of (event_id, chapter), midpoint); ``answers``: (key, event_id, error).
    """
    a = answers.select(
        key, F.col("event_id").alias("__id"), F.col("error").alias("__err"), F.lit(True).alias("__there")
    )
    j = candidates.join(a, key, "left")
    first = F.get("candidates", F.lit(0))
    none = F.size("candidates") == 0
    failed = F.col("__err").isNotNull() | F.col("__there").isNull()
    hit = F.get(F.filter("candidates", lambda c: c["event_id"] == F.col("__id")), F.lit(0))
    chosen = F.when(none, F.lit(None)).when(failed, first["event_id"]).otherwise(F.col("__id"))
    chapter = F.when(none, F.col("midpoint")).when(failed, first["chapter"]).otherwise(hit["chapter"])
    return j.select(
        key, chosen.alias("event_id"), chapter.alias("chapter"),
        (~none & ~failed & F.col("__id").isNull()).alias("rejected"),
    )
