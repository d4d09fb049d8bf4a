"""How the engine's concepts are bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modes, in their fixed order; the fifth plays the mode under test, the first its base.
MODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TARGET, BASE = "5-LOW", "1-URGENT"
TYPES = ("A", "N", "R")


#: A caller's parameter, unset by default: whole texts are dealt out to so many pieces when read.
PIECES = "spark.loomspan.pieces"


#: Bytes of an Arrow batch: each task of an executor holds one in the JVM and in Python.
ARROW_BYTES = 4 << 20


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for the session, as it reads its tables; a tighter bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  ``PIECES`` in the session deals out texts that lie in too few files."""
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pieces = spark.conf.get(PIECES, None)
    return df.repartition(int(pieces)) if pieces and name == "documents" else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge records: one line item is one scored probe of a model (status) in a mode (priority).

    The two fact tables meet on the order key; the dimensions are small and the optimizer
    broadcasts them by their size.  Only the columns in use are read.
    """
    t = lambda n: table(spark, sf_dir, n)
    facts = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_suppkey", "l_partkey"
    )
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    places = t("customer").select("c_custkey", "c_nationkey").join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = facts.join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    ).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("r_name").alias("slice"), F.col("n_name").alias("novel"), F.col("c_custkey").alias("character"),
        F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("mode"),
        F.col("l_returnflag").alias("ptype"), F.col("l_quantity").alias("apf"),
        (F.col("l_discount") * 100).alias("rpf"), (F.col("l_tax") * 100).alias("rae"), "l_orderkey", "l_linenumber",
        "l_suppkey", "l_partkey",
    )


#: The same binding for the oracles.
RECORDS = """rec AS (
  SELECT r_name AS slice, n_name AS novel, c_custkey AS "character", o_orderstatus AS model, o_orderpriority AS mode, l_returnflag AS ptype,
         l_quantity AS apf, l_discount * 100 AS rpf, l_tax * 100 AS rae, l_orderkey, l_linenumber, l_suppkey, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def mean_sql(v: str) -> str:
    return f"(CAST(SUM(CAST({v} AS DECIMAL(20,6))) AS DOUBLE) / COUNT({v}))"


def ranked(df: DataFrame) -> DataFrame:
    """Adds the mode's place in the fixed order."""
    return df.withColumn("rank", F.array_position(F.array(*map(F.lit, MODES)), F.col("mode")))


RANK = "list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], mode)"
