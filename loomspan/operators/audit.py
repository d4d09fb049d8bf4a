"""Release and file audits: what is declared against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def revision_ok(revision: Column) -> Column:
    return F.coalesce(revision.rlike(r"^[0-9a-f]{40}$"), F.lit(False))


def file_differences(declared: DataFrame, found: DataFrame, exact: bool = True) -> DataFrame:
    """``(file, problem)``: missing, unexpected (if ``exact``), size, sha256.

    Both: (file, size, sha256).
    """
    d = declared.select("file", F.col("size").alias("d_size"), F.col("sha256").alias("d_sha"), F.lit(True).alias("d"))
    f = found.select("file", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"), F.lit(True).alias("f"))
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("d").isNull(), "unexpected").when(
        ~F.col("d_size").eqNullSafe(F.col("f_size")), "size"
    ).when(~F.col("d_sha").eqNullSafe(F.col("f_sha")), "sha256")
    out = d.join(f, "file", "full").select("file", problem.alias("problem")).where("problem IS NOT NULL")
    return out if exact else out.where("problem <> 'unexpected'")
