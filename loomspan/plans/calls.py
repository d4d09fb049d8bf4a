"""Queries over calls to models and services (offline stubs), their metering, and resumed folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import folds
from ..sinks.paths import scratch
from .base import table
from .text import ORACLES as TEXT_ORACLES

QUERIES, ORACLES = {}, {}
#: Keyed state needs this store; only sessions of our own are set to it.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _turns(spark, sf_dir):
    """Every turn as a request: an id, a system prompt, the text, and one of two models."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("__", "conv_id", "turn").alias("request_id"), F.lit("judge").alias("system"),
        F.coalesce("text", F.lit("")).alias("user"),
        F.when(F.col("conv_id") % 2 == 0, "warm").otherwise("cold").alias("model"),
    )


@query("""
SELECT conv_id || '__' || turn AS request_id, least(length(coalesce(text, '')) % 5 + 1, 3)::INT AS attempts,
       length(coalesce(text, '')) % 5 < 3 AS parse_ok, length(coalesce(text, '')) % 5 < 3 AS scored
FROM conversations""")
def judge_retries(spark, sf_dir):
    """A judge that gives illegal scores first is asked again; after three attempts it is an error."""
    wrong = lambda r: len(r["user"]) % 5
    rows = C.judge(_turns(spark, sf_dir), C.stub_client("judge", wrong=wrong), ["apf", "rpf", "rae"], 100, backoff=0)
    return rows.select("request_id", "attempts", "parse_ok", F.col("average").isNotNull().alias("scored"))


@query("""
SELECT conv_id || '__' || turn AS request_id, length(coalesce(text, '')) % 7 = 0 AS refused,
       length(coalesce(text, '')) % 7 <> 0 AND conv_id % 2 = 0 AS heated
FROM conversations""")
def refused_calls(spark, sf_dir):
    """B1: a refusal is an error, and a model that rejects a temperature is asked without."""
    client = C.stub_client(refuses=lambda r: len(r["user"]) % 7 == 0, rejects=("cold",))
    rows = C.call_models(_turns(spark, sf_dir), client, backoff=0, parameters={"temperature": 0.3})
    return rows.select(
        "request_id", F.coalesce(F.startswith("error", F.lit("Refused: ")), F.lit(False)).alias("refused"),
        F.coalesce(F.endswith("response", F.lit(" at 0.3")), F.lit(False)).alias("heated"),
    )


_NUMBER = "(('0x' || sha1('{0}' || chr(31) || coalesce(text, ''))[1:12])::BIGINT % 2001 - 1000) / 1000.0"


@query(f"""
SELECT conv_id || '__' || turn AS request_id, 8 AS size, {_NUMBER.format(0)} AS first, {_NUMBER.format(7)} AS last,
       TRUE AS least_calls
FROM conversations""")
def embedding_batches(spark, sf_dir):
    """B2: one vector a text, 96 texts a call; a task with n texts makes ceil(n / 96) calls."""
    found = C.embed(_turns(spark, sf_dir), C.stub_embedder(), "request_id", "user", backoff=0)
    path = scratch(spark, "vectors")
    found.write.parquet(path)
    stored = spark.read.parquet(path)
    tasks = stored.groupBy("task").agg(
        (F.count_distinct("call") == F.ceil(F.count("*") / C.EMBED_BATCH)).alias("least_calls")
    )
    return stored.join(tasks, "task").select(
        F.col("id").alias("request_id"), F.size("vec").alias("size"), F.get("vec", F.lit(0)).alias("first"),
        F.get("vec", F.lit(7)).alias("last"), "least_calls",
    )


@query(f"""
WITH h AS ({TEXT_ORACLES['heuristic_reward']})
SELECT 'heuristic' AS mode, conv_id || '__' || turn AS request_id, reward FROM h
UNION ALL SELECT 'zero', conv_id || '__' || turn, 0 FROM conversations
UNION ALL SELECT 'remote', conv_id || '__' || turn, length(coalesce(text, '')) % 101 / 100.0 FROM conversations""")
def reward_modes(spark, sf_dir):
    """Rewards by rule, by a service that loses connections first, and none."""
    asked = _turns(spark, sf_dir)
    drops = lambda row: len(row["response"]) % 3
    out = None
    for mode in ("heuristic", "zero", "remote"):
        client = C.stub_scorer(drops) if mode == "remote" else None
        one = C.rewards(asked, mode, client, "request_id", "user", backoff=0).select(
            F.lit(mode).alias("mode"), F.col("id").alias("request_id"), F.round("reward", 6).alias("reward")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH c AS (SELECT length(coalesce(text, '')) AS n FROM conversations)
SELECT count_if(n % 4 <> 0) AS ok, count_if(n % 4 = 0) AS bad, sum(CASE WHEN n % 4 = 0 THEN 3 ELSE 1 END)::BIGINT AS attempts,
       sum((n + 6) // 4)::BIGINT AS tokens_in, (4 * count_if(n % 4 <> 0))::BIGINT AS tokens_out, TRUE AS as_stored
FROM c""")
def run_metering(spark, sf_dir):
    """Totals of a run, observed while its results are written, against those of the stored rows."""
    client = C.stub_client("chat", refuses=lambda r: len(r["user"]) % 4 == 0)
    results, seen = C.metered(C.call_models(_turns(spark, sf_dir), client, backoff=0), "run_metering")
    path = scratch(spark, "metered")
    results.write.parquet(path)
    totals = [F.lit(seen.get[k]).cast("long").alias(k) for k in ("ok", "bad", "attempts", "tokens_in", "tokens_out")]
    stored = C.metering(spark.read.parquet(path))
    same = F.lit(True)
    for k, v in seen.get.items():
        same = same & (F.col(k) == F.lit(v))
    return stored.select(*totals, same.alias("as_stored"))


_SEEN = """
SELECT conv_id, turn, SUM(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS seen,
       {0} AS run
FROM conversations"""


def _count(state, text):
    return str(int(state or 0) + len(text))


@query(_SEEN.format("CASE WHEN turn < 4 THEN 1 ELSE 2 END"))
def resumed_fold(spark, sf_dir):
    """Chapters below the fourth, stop, the rest from the stored states; as in one pass."""
    turns, path = table(spark, sf_dir, "conversations"), scratch(spark, "states")
    folds.fold(turns.where("turn < 4"), "conv_id", "turn", "text", _count).write.parquet(path)
    stored = spark.read.parquet(path)
    rest = folds.fold(turns, "conv_id", "turn", "text", _count, stored)
    both = stored.withColumn("run", F.lit(1)).unionByName(rest.withColumn("run", F.lit(2)))
    return both.select("conv_id", "turn", F.col("state").cast("bigint").alias("seen"), "run")


@query(_SEEN.format("CASE WHEN turn < 2 THEN 1 WHEN turn < 4 THEN 2 ELSE 3 END"))
def resumed_stream_fold(spark, sf_dir):
    """A stream whose keyed state starts from stored chapters, stopped and started again."""
    turns, stored, out = table(spark, sf_dir, "conversations"), scratch(spark, "states"), scratch(spark, "folded")
    arrived, progress = scratch(spark, "chapters"), scratch(spark, "progress")
    folds.fold(turns.where("turn < 2"), "conv_id", "turn", "text", _count).write.parquet(stored)
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    states = own.read.parquet(stored)
    rows = turns.select("conv_id", "turn", "text")
    for run, part in ((2, "turn BETWEEN 1 AND 3"), (3, "turn >= 4")):  # turn 1 arrives again
        rows.where(part).write.mode("append").parquet(arrived)
        stream = own.readStream.schema(rows.schema).parquet(arrived)
        folded = folds.fold_stream(stream, "conv_id", "turn", "text", _count, states).withColumn("run", F.lit(run))
        folded.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode(
            "append"
        ).trigger(availableNow=True).start().awaitTermination()
    first = spark.read.parquet(stored).withColumn("run", F.lit(1))
    both = first.withColumn("turn", F.col("turn").cast("long")).unionByName(spark.read.parquet(out))
    return both.select("conv_id", "turn", F.col("state").cast("bigint").alias("seen"), "run")
