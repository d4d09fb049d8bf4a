"""Queries of the record operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import records as R
from .base import MODES, RECORDS, TYPES, records, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(spark, name, values):  # wanted values as a table, for semi joins
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query(
    "SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (value >= 1 AND value <= 100) AS valid, ROUND(CAST(SUM(CAST(value AS DECIMAL(20,6))) FILTER (value >= 1 AND value <= 100) AS DOUBLE) / COUNT(*) FILTER (value >= 1 AND value <= 100), 6) AS mean FROM events GROUP BY ALL"
)
def valid_scores(spark, sf_dir):
    """scores from 1 to the scale."""
    e = table(spark, sf_dir, "events").withColumn("ok", R.valid_score("value", 100))
    good = F.when(F.col("ok"), F.col("value").cast("decimal(20,6)"))
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("valid"),
        F.round(F.sum(good).cast("double") / F.count(good), 6).alias("mean"),
    )


@query(
    f"""WITH {RECORDS} SELECT CASE WHEN model = 'F' THEN 'final' ELSE model END AS model, mode, ptype, COUNT(*) AS n FROM rec WHERE apf > 5 AND ptype IN ('A', 'R') AND mode IN ('1-URGENT', '5-LOW') AND model IN ('F', 'O') GROUP BY ALL"""
)
def usable_records(spark, sf_dir):
    """Usable records under their canonical model names."""
    rows = records(spark, sf_dir).withColumns(
        {"parse_ok": F.col("apf") > 5, "ptype": F.when(F.col("ptype").isin("A", "R"), F.col("ptype"))}
    )
    named = R.canonical(rows, spark.createDataFrame([("F", "final")], "alias string, name string"))
    good = R.usable(named, _list(spark, "model", ["final", "O"]), _list(spark, "mode", ["1-URGENT", "5-LOW"]))
    return good.groupBy("model", "mode", "ptype").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) = 1"""
)
def last_write_wins(spark, sf_dir):
    """The last record per key, with a full order."""
    order = [
        F.col(c).desc()
        for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    ]
    return R.latest(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "SELECT user_id, event_type, event_id, ROUND(value, 2) AS value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"
)
def latest_ts_wins(spark, sf_dir):
    """The latest time wins, ties go to the later row."""
    return R.latest(
        table(spark, sf_dir, "events"), ["user_id", "event_type"],
        [F.col("ts").desc_nulls_last(), F.col("event_id").desc()],
    ).select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"))


@query("""WITH t AS (SELECT DISTINCT conv_id FROM conversations), m AS (SELECT UNNEST(['vanilla', 'arc']) AS mode), d AS (SELECT UNNEST(['a/b', 'c:d']) AS model),
done AS (SELECT DISTINCT conv_id, CASE WHEN role = 'user' THEN 'vanilla' ELSE 'arc' END AS mode, 'a/b' AS model FROM conversations WHERE role IN ('user', 'assistant') AND turn > 1)
SELECT 'c' || t.conv_id || '__p0__' || m.mode || '__' || replace(replace(d.model, '/', '_'), ':', '_') AS trial_id FROM t, m, d WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.conv_id = t.conv_id AND done.mode = m.mode AND done.model = d.model)""")
def resume_anti_join(spark, sf_dir):
    """The trials that are still to run."""
    c = table(spark, sf_dir, "conversations")
    pid = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    name = lambda df: ids.trial_id(
        F.concat(F.lit("c"), df["conv_id"].cast("string")), F.lit(0), df["mode"], df["model"]
    )
    done = c.where("role IN ('user', 'assistant') AND turn > 1").select(
        ids.trial_id(
            pid, F.lit(0), F.when(F.col("role") == "user", "vanilla").otherwise("arc"), F.lit("a/b")
        ).alias("trial_id")
    ).distinct()
    return R.pending(c.select("conv_id").distinct(), ["vanilla", "arc"], ["a/b", "c:d"], done, name).select("trial_id")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS probe_id, l_linenumber AS phase_idx, l_returnflag AS mode FROM lineitem), t AS (SELECT o_orderkey AS probe_id, (o_orderkey % 7 + 1)::INT AS phase_idx, o_orderstatus AS model FROM orders)
SELECT probe_id, phase_idx, model, COUNT(*) AS modes, string_agg(mode, ',' ORDER BY mode) AS names FROM r JOIN t USING (probe_id, phase_idx) GROUP BY ALL""")
def join_gt_responses(spark, sf_dir):
    """Responses with ground truth, modes gathered per unit."""
    truth = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("probe_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("phase_idx"),
        F.col("o_orderstatus").alias("model"),
    )
    got = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe_id"), F.col("l_linenumber").alias("phase_idx"),
        F.col("l_returnflag").alias("mode"), F.lit("x").alias("response"),
    ).distinct()
    u = R.units(got, truth, ["probe_id", "phase_idx"])
    return u.select(
        "probe_id", "phase_idx", "model", F.size("responses").cast("bigint").alias("modes"),
        F.array_join(F.array_sort(F.map_keys("responses")), ",").alias("names"),
    )


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS probe_id, l_linenumber AS phase FROM lineitem) SELECT probe_id, COUNT(*) AS n_phases, string_agg(phase::VARCHAR, ',' ORDER BY phase) AS phases FROM p GROUP BY ALL HAVING COUNT(*) >= 2"""
)
def trajectory_units(spark, sf_dir):
    """Phases in order, two at least."""
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe_id"), F.col("l_linenumber").alias("phase")
    ).distinct()
    t = R.trajectories(p, ["probe_id"], "phase", "phase")
    return t.select(
        "probe_id", F.size("phases").cast("bigint").alias("n_phases"),
        F.array_join(F.transform("phases", lambda x: x["phase"].cast("string")), ",").alias("phases"),
    )


@query(
    "SELECT COALESCE(CASE WHEN quality = 1 THEN 'in_text' WHEN quality = 0 THEN 'in_world' END, 'unknown') AS ptype, COUNT(*) AS n, COUNT(DISTINCT CASE WHEN quality IS NULL THEN d.doc_id END) AS unmapped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"
)
def unmapped_unknown(spark, sf_dir):
    """Records without a mapped type count as unknown."""
    types = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "in_text").otherwise("in_world").alias("t")
    )
    rows = table(spark, sf_dir, "documents").select("doc_id").join(types, "doc_id", "left")
    return rows.groupBy(F.coalesce("t", F.lit("unknown")).alias("ptype")).agg(
        F.count("*").alias("n"), F.countDistinct(F.when(F.col("t").isNull(), F.col("doc_id"))).alias("unmapped")
    )


@query("""WITH m AS (SELECT o_orderkey AS probe_id, 1 AS phase_idx, 'A' AS arc_mode, 'N' AS other_mode FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT probe_id, phase_idx, UNNEST([arc_mode, other_mode]) AS mode FROM m)
SELECT l_returnflag AS mode, COUNT(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM p WHERE probe_id = l_orderkey AND phase_idx = l_linenumber AND mode = l_returnflag) GROUP BY ALL""")
def manifest_semi_join(spark, sf_dir):
    """F16: records that a manifest of mode pairs names."""
    manifest = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("probe_id"), F.lit(1).alias("phase_idx"), F.lit("A").alias("arc_mode"),
        F.lit("N").alias("other_mode"),
    )
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe_id"), F.col("l_linenumber").alias("phase_idx"),
        F.col("l_returnflag").alias("mode"),
    )
    return R.manifest_filter(rows, manifest).groupBy("mode").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderstatus AS model, COUNT(*) AS scores, COUNT(*) FILTER (k IS NULL) AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = k GROUP BY ALL"
)
def missing_responses(spark, sf_dir):
    """Scores whose raw response is missing."""
    got = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(
        got, F.col("o_orderkey") == F.col("k"), "left"
    )
    return rows.groupBy(F.col("o_orderstatus").alias("model")).agg(
        F.count("*").alias("scores"), F.count_if(F.col("k").isNull()).alias("missing")
    )


@query(f"""WITH {RECORDS}, g AS (SELECT n_name AS novel, m AS mode, t AS ptype FROM nation, (SELECT UNNEST({list(MODES)}) AS m), (SELECT UNNEST({list(TYPES)}) AS t)),
h AS (SELECT DISTINCT novel, mode, ptype FROM rec WHERE apf > 49 AND model = 'P') SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.novel = g.novel AND h.mode = g.mode AND h.ptype = g.ptype)""")
def missing_cells(spark, sf_dir):
    """Cells of the grid that have no value."""
    novels = table(spark, sf_dir, "nation").select(F.col("n_name").alias("novel"))
    return R.missing_cells(
        novels, records(spark, sf_dir).where("apf > 49 AND model = 'P'"), ["novel", "mode", "ptype"], mode=MODES,
        ptype=TYPES,
    ).select("novel", "mode", "ptype")


@query("""WITH e AS (SELECT c_custkey AS k FROM customer), f AS (SELECT DISTINCT o_custkey AS k FROM orders), u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000)
SELECT k, 'missing' AS gap FROM e WHERE k NOT IN (SELECT k FROM f) UNION ALL SELECT k, 'empty' AS gap FROM e WHERE k IN (SELECT k FROM f) AND k NOT IN (SELECT k FROM u)""")
def missing_and_empty_files(spark, sf_dir):
    """Expected files that are missing or hold no usable row."""
    o = table(spark, sf_dir, "orders")
    return R.file_gaps(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")),
        o.select(F.col("o_custkey").alias("k")).distinct(),
        o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct(), "k",
    )


@query(
    "SELECT event_type, COUNT(*) AS n, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, COUNT(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 1 AND 50) AS legal FROM events GROUP BY ALL"
)
def json_payload(spark, sf_dir):
    """Fields out of a JSON payload, numbers only."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "bigint")
    legal = R.typed_score(F.try_variant_get("v", "$.k", "variant"), 50)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count(legal).alias("legal"))


@query(
    "SELECT 'missing' AS side, COUNT(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'extra', COUNT(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)"
)
def required_minus_present(spark, sf_dir):
    """Set differences, both ways."""
    a, b = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("k")
    ), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("missing").alias("side"), "n").union(
        b.subtract(a).agg(F.count("*").alias("n")).select(F.lit("extra").alias("side"), "n")
    )


@query(
    "SELECT p_brand, COUNT(*) AS n FROM (SELECT p_partkey, p_brand FROM part WHERE p_size > 10 INTERSECT SELECT p_partkey, p_brand FROM part WHERE p_retailprice > 950) GROUP BY ALL"
)
def common_items(spark, sf_dir):
    """Items in both sets."""
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 10").select("p_partkey", "p_brand").intersect(
        p.where("p_retailprice > 950").select("p_partkey", "p_brand")
    ).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    "SELECT side, COUNT(*) AS n, COUNT(extra) AS extra FROM (SELECT 'a' AS side, NULL::BIGINT AS extra FROM region UNION ALL SELECT 'b', n_nationkey::BIGINT FROM nation) GROUP BY ALL"
)
def union_configs(spark, sf_dir):
    """Concatenation of splits whose columns differ."""
    a = table(spark, sf_dir, "region").select(F.lit("a").alias("side"))
    b = table(spark, sf_dir, "nation").select(
        F.lit("b").alias("side"), F.col("n_nationkey").cast("bigint").alias("extra")
    )
    return a.unionByName(b, allowMissingColumns=True).groupBy("side").agg(
        F.count("*").alias("n"), F.count("extra").alias("extra")
    )


@query(
    """SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'validated' WHEN n_regionkey < 3 THEN 'grounded' ELSE 'final' END AS stage FROM nation"""
)
def stage_fallback(spark, sf_dir):
    """The first stage that exists."""
    from ..sources.stages import first_stage

    n = table(spark, sf_dir, "nation")
    have = n.where("n_regionkey = 0").select("n_name", F.lit("validated").alias("stage")).union(
        n.where("n_regionkey < 3").select("n_name", F.lit("grounded"))
    ).union(n.select("n_name", F.lit("final")))
    return first_stage(have, ["n_name"], "stage", ["validated", "grounded", "final"]).select("n_name", "stage")


@query(
    "SELECT o_orderpriority AS mode, COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY ALL"
)
def include_skip_lists(spark, sf_dir):
    """Include and skip lists as semi and anti joins."""
    c = table(spark, sf_dir, "customer")
    key = lambda d: d.select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(key(c.where("c_acctbal > 0")), "o_custkey", "left_semi").join(
        key(c.where("c_mktsegment = 'MACHINERY'")), "o_custkey", "left_anti"
    ).groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count("*").alias("n"))
