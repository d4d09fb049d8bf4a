"""Queries that cross a boundary: model calls (offline stub), publishing, folds, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import external as E, metrics as M, prompts as P
from ..sinks import publish as S
from ..sinks.paths import scratch
from .base import RECORDS, mean_sql, records, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _requests(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select(
        F.concat_ws("__", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.lit("judge").alias("system"), F.col("text").alias("user"),
    )


@query(
    "SELECT conv_id || '__' || turn AS request_id, TRUE AS parse_ok, 1 AS attempts FROM conversations WHERE role = 'user'"
)
def staged_publish(spark, sf_dir):
    """Judge every request with the stub client, publish all or nothing."""
    records_ = E.judged(
        E.call_models(_requests(spark, sf_dir), E.stub_client("judge"), backoff=0), ["apf", "rpf", "rae"], 100
    )
    out = S.staged(records_, scratch(spark, "judged"), "NOT parse_ok")
    return out.where(F.col("average").between(1, 100)).select("request_id", "parse_ok", "attempts")


@query("SELECT conv_id || '__' || turn AS request_id, 1::BIGINT AS n FROM conversations WHERE role = 'user'")
def append_resume(spark, sf_dir):
    """A second run adds only what the first did not finish."""
    path, req = scratch(spark, "responses"), _requests(spark, sf_dir)
    S.append(E.call_models(req.where("length(user) < 200"), E.stub_client(), backoff=0), path)
    done = spark.read.parquet(path).where("error IS NULL").select("request_id")
    S.append(E.call_models(req.join(done, "request_id", "left_anti"), E.stub_client(), backoff=0), path)
    return spark.read.parquet(path).groupBy("request_id").agg(F.count("*").alias("n"))


@query(
    "SELECT conv_id, turn, SUM(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS seen FROM conversations"
)
def ordered_state_fold(spark, sf_dir):
    """A running state through ordered chapters (here: characters seen so far)."""
    step = lambda state, text: str(int(state or 0) + len(text))
    f = E.fold(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", step)
    return f.select("conv_id", "turn", F.col("state").cast("bigint").alias("seen"))


@query(
    f"""WITH {RECORDS}, m AS (SELECT model, mode, ROUND({mean_sql('apf')}, 3) AS v FROM rec GROUP BY ALL), o AS (SELECT model, '{{' || string_agg('"' || mode || '":' || v::VARCHAR, ',' ORDER BY mode) || '}}' AS j FROM m GROUP BY 1) SELECT '{{' || string_agg('"' || model || '":' || j, ',' ORDER BY model) || '}}' AS json FROM o"""
)
def report_json(spark, sf_dir):
    """K5: nested JSON of a small report."""
    m = M.pool(records(spark, sf_dir), ["model", "mode"], "apf", "v").withColumn("v", F.round("v", 3))
    return S.nested_json(m, "model", "mode", "v")


@query(
    """SELECT c_custkey, 'You are ' || c_name || ', from "' || n_name || '". You are at the point in the story corresponding to chapter ' || n_regionkey || '.' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'You are interacting with ' || c_mktsegment || '.' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Background you have access to:' || chr(10) || '<context>' || chr(10) || 'x' || chr(10) || '</context>' ELSE '' END AS prompt FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def prompt_rendering(spark, sf_dir):
    """Role-play prompts with their optional sections."""
    t = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    kind = F.when(F.col("c_custkey") % 2 == 0, "relational").otherwise("intrapersonal")
    context = F.when(F.col("c_custkey") % 3 == 0, " x\n").otherwise("  ")
    return t.select(
        "c_custkey",
        P.system(
            F.col("c_name"), F.col("n_name"), F.col("n_regionkey"), kind, F.col("c_mktsegment"), context
        ).alias("prompt"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN 'future' WHEN o_orderstatus = 'P' THEN 'absent' ELSE 'none' END AS kind FROM orders"""
)
def time_hints(spark, sf_dir):
    """Hints of the narrative experts."""
    h = P.time_hint(
        F.lit("X"), F.col("o_orderkey") % 5, F.lit(2),
        F.when(F.col("o_orderstatus") == "P", "absent").otherwise("present"),
    )
    kind = F.when(h.isNull(), "none").when(F.contains(h, F.lit("in the future")), "future").otherwise("absent")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS probe_id, l_linenumber AS phase FROM lineitem) SELECT probe_id || '__p' || phase || '__arc__a_b' AS trial_id FROM e"""
)
def trial_ids(spark, sf_dir):
    """Trial ids."""
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("probe_id"), F.col("l_linenumber").alias("phase")
    ).distinct()
    return e.select(ids.trial_id(F.col("probe_id"), F.col("phase"), F.lit("arc"), F.lit("a/b")).alias("trial_id"))


@query("""WITH d AS (SELECT p_partkey AS file, p_size AS size, p_brand AS sha FROM part WHERE p_size > 3), f AS (SELECT p_partkey AS file, CASE WHEN p_brand = 'Brand#7' THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_type = 'ECONOMY' THEN 'x' ELSE p_brand END AS sha FROM part WHERE p_size < 48)
SELECT problem, COUNT(*) AS n FROM (SELECT CASE WHEN f.file IS NULL THEN 'missing' WHEN d.file IS NULL THEN 'unexpected' WHEN d.size <> f.size THEN 'size' WHEN d.sha <> f.sha THEN 'sha256' END AS problem FROM d FULL JOIN f ON d.file = f.file) WHERE problem IS NOT NULL GROUP BY ALL""")
def release_audit(spark, sf_dir):
    """declared against found files."""
    from ..operators.audit import file_differences

    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = p.where("p_size > 3").select(k.alias("file"), F.col("p_size").alias("size"), F.col("p_brand").alias("sha256"))
    f = p.where("p_size < 48").select(
        k.alias("file"),
        F.when(F.col("p_brand") == "Brand#7", F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"),
        F.when(F.col("p_type") == "ECONOMY", "x").otherwise(F.col("p_brand")).alias("sha256"),
    )
    return file_differences(d, f).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """R2, R3 (an extension): the events as a stream, each once, counted when it has drained."""
    from ..streaming.ingest import records_stream

    src = scratch(spark, "stream")
    batch = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("trial_id"), "event_type")
    S.append(batch, src)
    S.append(batch.where("event_type = 'click'"), src)
    out = scratch(spark, "drained")
    q = records_stream(
        spark, src, "trial_id string, event_type string"
    ).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
