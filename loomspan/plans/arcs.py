"""Queries of arcs, nested records and retrieval, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import arcs as A, retrieval as R
from .base import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _axes(spark, sf_dir):
    """Orders as axes: line items are phases, the line number begins them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    return li.groupBy(F.col("l_orderkey").alias("axis_id")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("l_linenumber").alias("lo"), F.col("l_partkey").alias("label")))
        ).alias("trajectory")
    )


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey AS axis_id, COUNT(*) FILTER (l_linenumber <= l_orderkey % 5 + 1) AS visible, COUNT(*) AS phases, CASE WHEN COUNT(*) FILTER (l_linenumber <= l_orderkey % 5 + 1) = COUNT(*) THEN 'end' END AS pole_end FROM p GROUP BY ALL"""
)
def visible_phases(spark, sf_dir):
    """Phases that have begun, endings hidden while some have not."""
    a = _axes(spark, sf_dir).withColumns(
        {
            "query_chapter": (F.col("axis_id") % 5 + 1).cast("int"), "pole_end": F.lit("end"),
            "evidence_summary": F.lit("x"), "phases": F.size("trajectory").cast("bigint"),
        }
    )
    c = A.curate(a, "query_chapter")
    return c.select("axis_id", F.size("trajectory").cast("bigint").alias("visible"), "phases", "pole_end")


@query(
    """SELECT n_name AS novel, c_custkey AS "character", o_orderkey AS probe_id, COALESCE(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'intrapersonal') AS axis_type, l_linenumber AS phase_idx FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linenumber <> 4"""
)
def unnest_trials(spark, sf_dir):
    """Families, probes and phases to rows, unavailable phases left out."""
    t = lambda n: table(spark, sf_dir, n)
    ph = t("lineitem").select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("phase_idx"), F.col("l_linenumber").alias("query_chapter"), (F.col("l_linenumber") == 4).alias("unavailable"))).alias("phase_responses"))
    o = t("orders").join(ph, F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    probe = F.struct(
        F.col("o_orderkey").alias("probe_id"), F.lit("in_text").alias("probe_type"), F.lit("s").alias("scenario"),
        "phase_responses",
    )
    fam = F.struct(
        F.col("o_orderkey").alias("axis_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("axis_type"),
        F.array(probe).alias("probes"),
    )
    files = o.select(
        F.col("n_name").alias("novel"), F.col("c_custkey").alias("character"), F.array(fam).alias("families")
    )
    return A.unnest_trials(files).select("novel", "character", "probe_id", "axis_type", "phase_idx")


@query("""WITH f AS (SELECT l_orderkey AS probe, l_linenumber - 1 AS idx, l_partkey AS v FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1), g AS (SELECT probe FROM f GROUP BY probe HAVING COUNT(*) = probe % 3 + 2 AND MIN(idx) = 0 AND MAX(idx) = probe % 3 + 1)
SELECT probe, idx, v FROM f WHERE probe IN (SELECT probe FROM g)""")
def normalize_phases(spark, sf_dir):
    """First response per phase; probes with gaps go."""
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe"), (F.col("l_linenumber") - 1).alias("idx"), F.col("l_partkey").alias("v"),
        "l_suppkey", (F.col("l_orderkey") % 3 + 2).alias("n"),
    )
    return A.normalise_phases(r, "probe", "idx", "n", [F.col("v"), F.col("l_suppkey")]).select("probe", "idx", "v")


@query("""WITH v AS (SELECT doc_id % 50 AS axis, doc_id AS a, CASE WHEN quality = 1 THEN 'valid' ELSE 'invalid' END AS x FROM labels UNION ALL SELECT doc_id % 50, doc_id + 1000000, CASE WHEN toxic = 0 THEN 'valid' ELSE 'invalid' END FROM labels)
SELECT axis, COUNT(*) FILTER (x = 'valid') AS valid_votes, COUNT(*) AS n_annotators, COUNT(*) FILTER (x = 'valid') >= 2 AS kept FROM v GROUP BY ALL""")
def vote_aggregate(spark, sf_dir):
    """annotators' votes per axis."""
    lb = table(spark, sf_dir, "labels")
    axis = (F.col("doc_id") % 50).alias("axis")
    v = lb.select(axis, F.col("doc_id").alias("annotator"), F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("validity")).union(
        lb.select(axis, F.col("doc_id") + 1000000, F.when(F.col("toxic") == 0, "valid").otherwise("invalid")))
    axes = spark.range(50).select(F.col("id").alias("axis"))
    return A.vote_totals(v, axes, ["axis"]).select("axis", "valid_votes", "n_annotators", "kept")


@query("""WITH e AS (SELECT UNNEST(['h', 'p', 's']) AS ev), g AS (SELECT o_orderkey AS k, ev FROM orders, e), v AS (SELECT l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 'h' WHEN 2 THEN 'p' WHEN 3 THEN 's' END AS ev, BOOL_OR(l_tax > 0.02) AS ok, COUNT(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
c AS (SELECT g.k, COUNT(*) FILTER (ok AND n >= 1) AS confirmed, COUNT(ok) AS answered FROM g LEFT JOIN v ON g.k = v.k AND g.ev = v.ev GROUP BY ALL) SELECT k, confirmed, answered, CASE WHEN confirmed >= 2 THEN 'valid' WHEN confirmed = 1 THEN 'partial' ELSE 'none' END AS tag FROM c""")
def critic_ensemble(spark, sf_dir):
    """Three critics, missing ones do not confirm."""
    name = F.when(F.col("l_linenumber") == 1, "h").when(F.col("l_linenumber") == 2, "p").otherwise("s")
    v = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("k"), name.alias("evaluator")).agg(
        F.bool_or(F.col("l_tax") > 0.02).alias("verdict"), F.collect_list("l_partkey").alias("citations")
    )
    return A.critic_ensemble(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), v, ["h", "p", "s"], ["k"]
    )


@query(
    """SELECT c_custkey AS axis_id, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS axis_name, s_suppkey IS NULL AS stub FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"""
)
def axis_family_stub(spark, sf_dir):
    """Axes by key, the family's fields where the axis is missing."""
    fam = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("axis_id"), F.col("c_name").alias("axis_name")
    )
    ax = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("axis_id"), F.col("s_name").alias("axis_name")
    )
    return A.with_stub(fam, ax, "axis_id", ["axis_name"])


@query(
    """WITH p AS (SELECT o_orderkey AS probe, o_orderkey % 3 AS f, CASE WHEN o_orderstatus = 'P' THEN 'similar' ELSE 'weak' END AS sep FROM orders) SELECT sep AS separation, list_extract(['a', 'b', 'c', 'd'], (f + 1)::INT) AS from_label, COUNT(*) AS pairs, COUNT(DISTINCT probe) AS probes FROM p GROUP BY ALL"""
)
def weak_pairs(spark, sf_dir):
    """Weak pairs with the labels of their phases, counted."""
    sep = F.when(F.col("o_orderstatus") == "P", "similar").otherwise("weak")
    idx = (F.col("o_orderkey") % 3).cast("int")
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("probe"), F.array(*map(F.lit, "abcd")).alias("labels"),
        F.array(F.struct(idx.alias("from_idx"), (idx + 1).alias("to_idx"), sep.alias("separation"))).alias("pairs"),
    )
    return A.weak_pairs(p, "probe", "pairs", "labels").groupBy("separation", "from_label").agg(
        F.count("*").alias("pairs"), F.countDistinct("probe").alias("probes")
    )


@query("""WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nn FROM c),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_idx, c.label AS chapter, list_sum(list_transform(range(1, len(c.e) + 1), lambda i: c.e[i] * q.e[i])) / ((c.nn + 1e-12) * (q.nn + 1e-12)) AS sim FROM n q JOIN n c ON c.label <= q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(sim, 9) DESC, chapter, chunk_idx) AS rank FROM s) SELECT query_id, chunk_idx, rank, ROUND(sim, 6) AS sim FROM r WHERE rank <= 6""")
def masked_cosine_topk(spark, sf_dir):
    """The six most similar chunks a query may see."""
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(
        F.lit("n").alias("novel"), F.col("label").alias("chapter"), F.col("vec_id").alias("chunk_idx"),
        F.col("embedding").alias("vec"),
    )
    queries = e.where("vec_id % 100 = 0").select(
        F.lit("n").alias("novel"), F.col("vec_id").alias("query_id"), F.col("label").alias("query_chapter"),
        F.col("embedding").alias("qvec"),
    )
    return R.masked_top_k(chunks, queries).select(
        "query_id", "chunk_idx", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 6).alias("sim")
    )


@query("""WITH q AS (SELECT DISTINCT l_suppkey AS novel, (l_linenumber + 3)::INT AS qc FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS novel, (l_partkey % 12)::INT AS ch FROM lineitem), w AS (SELECT novel, qc, UNNEST(range(GREATEST(1, qc - 4), qc + 1)) AS ch FROM q)
SELECT w.novel, qc AS query_chapter, COUNT(s.ch) AS found, string_agg(CASE WHEN s.ch IS NULL THEN w.ch::VARCHAR END, ',' ORDER BY w.ch) AS missing FROM w LEFT JOIN s ON w.novel = s.novel AND w.ch = s.ch GROUP BY ALL""")
def trailing_chapter_window(spark, sf_dir):
    """The trailing chapters that are there, and those missing."""
    li = table(spark, sf_dir, "lineitem")
    q = li.select(
        F.col("l_suppkey").alias("novel"), (F.col("l_linenumber") + 3).cast("int").alias("query_chapter")
    ).distinct()
    s = li.select(F.col("l_suppkey").alias("novel"), (F.col("l_partkey") % 12).cast("int").alias("chapter"))
    w = R.trailing_window(s, q, "novel", "chapter", "query_chapter")
    gone = F.array_join(F.transform("missing", lambda c: c.cast("string")), ",")
    return w.select(
        "novel", "query_chapter", F.size("chapters").cast("bigint").alias("found"),
        F.nullif(gone, F.lit("")).alias("missing"),
    )


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS idx, (l_linenumber * 3 + l_orderkey % 3)::INT AS lo, (l_linenumber * 3 + l_orderkey % 5)::INT AS hi FROM lineitem),
c AS (SELECT *, GREATEST(1, COALESCE(MAX(hi + 1) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS cur FROM p)
SELECT k, idx, TRUE AS gap, (lo - cur)::INT AS width FROM c WHERE lo > cur UNION ALL SELECT k, idx, FALSE, GREATEST(hi - GREATEST(lo, cur) + 1, 1)::INT FROM c UNION ALL SELECT k, -1, TRUE, (25 - e + 1)::INT FROM (SELECT k, GREATEST(1, MAX(hi + 1)) AS e FROM p GROUP BY k) WHERE e <= 25""")
def timeline_gaps(spark, sf_dir):
    """Timeline segments with their gaps."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    p = table(spark, sf_dir, "lineitem").select(
        k.alias("k"), n.alias("idx"), (n * 3 + k % 3).cast("int").alias("lo"), (n * 3 + k % 5).cast("int").alias("hi")
    ).distinct()
    return A.timeline(
        p, "k", "idx", "lo", "hi", p.select("k").distinct().withColumn("max_chapter", F.lit(25))
    ).withColumn("idx", F.coalesce("idx", F.lit(-1)))


@query(
    "SELECT event_id, ROW_NUMBER() OVER w AS position, COALESCE(LAG(event_id) OVER w, -1) AS previous, COALESCE(LEAD(event_id) OVER w, -1) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
def prev_next(spark, sf_dir):
    """Position and neighbours."""
    n = A.neighbours(
        table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id"
    )
    return n.select(
        "event_id", F.col("position").cast("bigint").alias("position"),
        F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"),
    )


@query(
    "WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem), n AS (SELECT k, i, LEAD(i) OVER (PARTITION BY k ORDER BY i) AS j FROM p) SELECT k, i AS from_idx, j AS to_idx FROM n WHERE j IS NOT NULL"
)
def adjacent_pairs(spark, sf_dir):
    """Each phase with the next."""
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")
    ).distinct()
    return A.adjacent_pairs(p, ["k"], "i", "i").select("k", "from_idx", "to_idx")


@query("""WITH p AS (SELECT user_id, lo, lo + 40 AS hi FROM (SELECT DISTINCT user_id FROM events), (SELECT UNNEST([0, 30]) AS lo)), e AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT e.event_id, p.user_id, p.lo, ROW_NUMBER() OVER (PARTITION BY p.user_id, p.lo ORDER BY event_id) AS place FROM e JOIN p ON e.user_id = p.user_id AND k BETWEEN lo AND hi) SELECT user_id, lo::INT AS lo, event_id, place FROM r WHERE place <= 30""")
def range_candidates(spark, sf_dir):
    """Events inside a range, the first thirty."""
    p = table(spark, sf_dir, "events").select("user_id").distinct().select(
        "user_id", F.explode(F.array(F.lit(0), F.lit(30))).alias("lo")
    ).withColumn("hi", F.col("lo") + 40)
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k")
    )
    return R.in_range(e, p, "user_id", "k", "lo", "hi", "event_id").select(
        "user_id", "lo", "event_id", F.col("place").cast("bigint").alias("place")
    )


@query(
    """SELECT l_orderkey, l_linenumber, FLOOR((l_linenumber - 5 + l_suppkey % 7) / 2.0)::INT AS midpoint, CASE WHEN l_linenumber - 1 = l_suppkey % 4 THEN 'pass' WHEN ABS(l_linenumber - 1 - l_suppkey % 4) = 1 THEN 'adjacent' ELSE 'off_phase' END AS fit FROM lineitem"""
)
def phase_rules(spark, sf_dir):
    """Floored midpoints and phase-fit verdicts."""
    li = table(spark, sf_dir, "lineitem")
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return li.select(
        "l_orderkey", "l_linenumber", ids.midpoint(n - 5, s % 7).alias("midpoint"),
        ids.phase_fit(s % 4, n - 1, F.lit(4)).alias("fit"),
    )


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, CASE WHEN l_tax > 0.05 THEN 'fail' ELSE 'pass' END AS voice, CASE l_returnflag WHEN 'R' THEN 'off_phase' WHEN 'A' THEN 'adjacent' ELSE 'pass' END AS fit, l_quantity > 20 AS called, CASE WHEN l_discount > 0.05 THEN 'fail' ELSE 'pass' END AS nv FROM lineitem)
SELECT CASE WHEN voice = 'fail' OR fit = 'off_phase' THEN 1 ELSE 0 END AS retry_count, (voice = 'fail' OR fit = 'off_phase') AND (NOT called OR nv = 'fail') AS unavailable, CASE WHEN (voice = 'fail' OR fit = 'off_phase') AND NOT called THEN 'regen call failed' WHEN (voice = 'fail' OR fit = 'off_phase') AND nv = 'fail' THEN 'validator still fails after retry' END AS reason, CASE WHEN fit = 'adjacent' THEN 'plausible_tail' ELSE 'typical' END AS typicality, COUNT(*) AS n FROM v GROUP BY ALL""")
def retry_rules(spark, sf_dir):
    """Which phases are retried and what becomes of them."""
    li = table(spark, sf_dir, "lineitem")
    voice = F.when(F.col("l_tax") > 0.05, "fail").otherwise("pass")
    fit = F.when(
        F.col("l_returnflag") == "R", "off_phase"
    ).when(F.col("l_returnflag") == "A", "adjacent").otherwise("pass")
    out = A.after_retry(
        voice, fit, F.col("l_quantity") > 20, F.when(F.col("l_discount") > 0.05, "fail").otherwise("pass"),
        F.lit("pass"),
    )
    return li.select(out.alias("o"), A.typicality(fit, F.lit("typical")).alias("typicality")).groupBy(
        "o.retry_count", "o.unavailable", F.col("o.unavailable_reason").alias("reason"), "typicality"
    ).agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 4 + 1)::INT AS n FROM orders), x AS (SELECT k, UNNEST(range(0, n))::INT AS i FROM p), g AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem WHERE l_returnflag = 'A') SELECT x.k, x.i AS phase_idx, CASE WHEN g.k IS NULL THEN 'adult' ELSE 'child' END AS life_stage FROM x LEFT JOIN g ON x.k = g.k AND x.i = g.i"""
)
def life_stage_defaults(spark, sf_dir):
    """H4: a life stage for every phase."""
    axes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("n")
    )
    given = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("phase_idx"), F.lit("child").alias("life_stage")
    ).distinct()
    return A.life_stages(given, axes, "k", "n").select("k", "phase_idx", "life_stage")
