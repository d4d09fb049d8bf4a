"""A corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns
the columns of ``documents`` (the last one: packed pieces).  ``run`` writes every stage as
Parquet in the shared folder and rereads it, so a lost executor costs no finished stage.

Verdicts are the rows' own: the toxicity and decontamination stages judge each text where it
lies, and the near-duplicate stage tells rows apart by id and content, so rows that share an
id or have none are judged like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, near_copies, packing, secret_scan, simhash, toxicity
from loomspan.llm.common import configure, materialize, table
from loomspan.llm.queries import forest


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the severity model finds toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.verdict(model)(F.col("text").cast("string"))["toxic"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Groups are SimHash's components; among what these leave, texts with a similarity of 0.8 or
    more of five-word shingles are copies too.  Of a group the row with the smallest id stays
    (null ids last, then by a hash of the row); of rows that agree in everything, one.
    """
    configure(spark)
    return near_copies.drop_near_copies(simhash.drop_near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that hold a benchmark passage."""
    return docs.where(
        ~decontaminate.holds_passage(table(spark, sf_dir, "benchmark"), F.col("text").cast("string"))
    ).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask confirmed secrets in the texts; every document stays."""
    clean = secret_scan.redact(docs, forest())
    return clean.withColumn(
        "n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    ).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    configure(spark)
    packed = packing.pack_documents(docs)
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id",
        "offset",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned models and tokenizers decide: SQL cannot say the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
