"""Queries of the scoring operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .base import BASE, MODES, RANK, RECORDS, TARGET, TYPES, mean_sql, ranked, records, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(c, kind="bigint"):
    return F.col(c).cast(kind).alias(c)


@query(f"""WITH {RECORDS}, nov AS (SELECT slice, novel, mode, ptype, {mean_sql('apf')} m FROM rec WHERE apf BETWEEN 1 AND 100 GROUP BY ALL),
mac AS (SELECT slice, mode, ptype, AVG(m) m FROM nov GROUP BY ALL)
SELECT slice, mode, ROUND(AVG(m), 6) AS overall, COUNT(*) AS n FROM mac GROUP BY ALL""")
def macro_mean(spark, sf_dir):
    """Pooled per novel, macro over novels, overall over the cells."""
    valid = records(spark, sf_dir).where(F.col("apf").between(1, 100))
    cells = M.macro_mean(valid, ["slice", "mode", "ptype"], ["novel"], "apf", "m")
    return cells.groupBy("slice", "mode").agg(F.round(F.avg("m"), 6).alias("overall"), F.count("*").alias("n"))


@query(f"""WITH {RECORDS}, d AS (SELECT novel, ptype, apf, CASE WHEN rpf > 0 THEN rpf END AS rpf, CASE WHEN rae > 0 THEN rae END AS rae FROM rec),
v AS (SELECT novel, ptype, (apf + COALESCE(rpf, 0) + COALESCE(rae, 0)) / (1 + (rpf IS NOT NULL)::INT + (rae IS NOT NULL)::INT) AS v FROM d)
SELECT novel, ptype, ROUND({mean_sql('v')}, 4) AS mean, COUNT(*) AS n FROM v GROUP BY ALL""")
def metric_row_mean(spark, sf_dir):
    """G1: a row's value is the mean of the dimensions that are there."""
    rows = records(spark, sf_dir).withColumns({k: F.when(F.col(k) > 0, F.col(k)) for k in ("rpf", "rae")})
    return M.pool(
        rows.withColumn("v", M.row_mean("apf", "rpf", "rae")), ["novel", "ptype"], "v"
    ).withColumn("mean", F.round("mean", 4))


_SUMMARY = ", ".join(f"ROUND({mean_sql(d)}, 3) AS {d}" for d in ("apf", "rpf", "rae"))


@query(f"""WITH {RECORDS}, a AS (SELECT *, (apf + rpf + rae) / 3 AS av FROM rec)
SELECT model, mode, {_SUMMARY}, ROUND({mean_sql('av')}, 3) AS average, COUNT(*) AS n FROM a GROUP BY ALL""")
def mode_summary_rounded(spark, sf_dir):
    """Rounded means of all dimensions per model and mode."""
    return M.summary(records(spark, sf_dir), ["model", "mode"], ["apf", "rpf", "rae"])


@query(f"""WITH {RECORDS}, b AS (SELECT model, mode, apf, CASE WHEN l_linenumber <= 2 THEN '2' WHEN l_linenumber = 3 THEN '3' WHEN l_linenumber = 4 THEN '4' ELSE '5+' END AS bucket FROM rec)
SELECT model, mode, bucket, ROUND({mean_sql('apf')}, 3) AS mean, COUNT(*) AS n FROM b GROUP BY GROUPING SETS ((model, mode), (model, mode, bucket))""")
def bucket_breakdown(spark, sf_dir):
    """Totals and a breakdown by number of phases in one pass."""
    rows = records(spark, sf_dir).withColumn("bucket", M.phase_bucket("l_linenumber"))
    out = M.grains(
        rows, [["model", "mode"], ["model", "mode", "bucket"]],
        [F.round(M.exact_mean("apf"), 3).alias("mean"), F.count("*").alias("n")],
    )
    return out.select("model", "mode", "bucket", "mean", "n")


@query(f"""WITH {RECORDS} SELECT r.model, r.mode, COALESCE(CASE WHEN p_brand <> 'Brand#7' THEN ptype END, 'unknown') AS ptype, ROUND({mean_sql('apf')}, 3) AS mean, COUNT(*) AS n
FROM rec r LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def by_type_breakdown(spark, sf_dir):
    """A breakdown by probe type, unmapped probes under 'unknown'."""
    types = table(spark, sf_dir, "part").where("p_brand <> 'Brand#7'").select(
        F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known")
    )
    rows = records(spark, sf_dir).join(types, "l_partkey", "left").withColumn(
        "ptype", F.when(F.col("known"), F.col("ptype")).otherwise("unknown")
    )
    return rows.groupBy("model", "mode", "ptype").agg(
        F.round(M.exact_mean("apf"), 3).alias("mean"), F.count("*").alias("n")
    )


@query(
    f"""WITH {RECORDS} SELECT slice, COALESCE(novel, 'all') AS novel, COALESCE("character", -1) AS "character", ROUND({mean_sql('apf')}, 2) AS mean, COUNT(*) AS n FROM rec GROUP BY GROUPING SETS ((slice), (slice, novel), (slice, novel, "character"))"""
)
def multi_grain_pool(spark, sf_dir):
    """Slice, novel and character pools in one pass."""
    out = M.grains(
        records(spark, sf_dir), [["slice"], ["slice", "novel"], ["slice", "novel", "character"]],
        [F.round(M.exact_mean("apf"), 2).alias("mean"), F.count("*").alias("n")],
    )
    return out.select(
        "slice", F.coalesce("novel", F.lit("all")).alias("novel"),
        F.coalesce("character", F.lit(-1)).alias("character"), "mean", "n",
    )


@query(
    f"""WITH {RECORDS}, m AS (SELECT slice, mode, novel, {mean_sql('apf')} m FROM rec GROUP BY ALL) SELECT slice, mode, ROUND(AVG(ROUND(m, 2)), 2) AS mean, COUNT(*) AS n FROM m GROUP BY ALL"""
)
def slice_of_rounded(spark, sf_dir):
    """The mean of already rounded novel means."""
    return M.mean_of_rounded(records(spark, sf_dir), ["slice", "mode"], ["novel"], "apf")


_CLASS = f"""WITH {RECORDS}, u AS (SELECT model, CASE WHEN c_mktsegment = 'BUILDING' THEN 'central' ELSE 'supporting' END AS class, "character", SUM(CAST(apf AS DECIMAL(20,6))) AS s, COUNT(*) AS c
FROM rec JOIN customer ON "character" = c_custkey GROUP BY ALL)"""


def _classes(spark, sf_dir):
    central = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("character"), F.lit(True).alias("central")
    )
    return M.class_means(records(spark, sf_dir), central, ["model"], "character", "apf")


@query(
    _CLASS
    + " SELECT model, class, ROUND(CAST(SUM(s) AS DOUBLE) / SUM(c), 6) AS mean, COUNT(*) AS units FROM u GROUP BY ALL"
)
def class_probepool(spark, sf_dir):
    """Central and supporting characters, all probes pooled."""
    return _classes(spark, sf_dir).select("model", "class", F.round("probe_pool", 6).alias("mean"), "units")


@query(
    _CLASS + " SELECT model, class, ROUND(AVG(CAST(s AS DOUBLE) / c), 6) AS mean, COUNT(*) AS units FROM u GROUP BY ALL"
)
def class_charmean(spark, sf_dir):
    """The same classes, characters weighing the same."""
    return _classes(spark, sf_dir).select("model", "class", F.round("unit_mean", 6).alias("mean"), "units")


_MEANS = f"WITH {RECORDS}, m AS (SELECT novel, model, mode, {mean_sql('apf')} v FROM rec GROUP BY ALL)"


def _means(spark, sf_dir):
    return M.pool(records(spark, sf_dir), ["novel", "model", "mode"], "apf", "v")


@query(
    _MEANS
    + f""" SELECT novel, model, ROUND(MAX(CASE WHEN mode = '{TARGET}' THEN v END) - MAX(CASE WHEN mode = '{BASE}' THEN v END), 6) AS lift FROM m GROUP BY ALL"""
)
def lift_vs_vanilla(spark, sf_dir):
    """Target mode minus base mode."""
    return M.lift(
        _means(spark, sf_dir), ["novel", "model"], "mode", "v", TARGET, BASE
    ).select("novel", "model", F.round("lift", 6).alias("lift"))


_OTHER = _MEANS + f""", o AS (SELECT novel, model, mode, v, ROW_NUMBER() OVER (PARTITION BY novel, model ORDER BY v DESC, {RANK}) rn FROM m WHERE mode <> '{TARGET}'),
g AS (SELECT DISTINCT novel, model FROM m), l AS (SELECT g.novel, g.model, ROUND(t.v, 6) AS target, ROUND(o.v, 6) AS best_other, o.mode AS best_other_mode, ROUND(t.v - o.v, 6) AS lift FROM g LEFT JOIN m t ON t.novel = g.novel AND t.model = g.model AND t.mode = '{TARGET}' LEFT JOIN o ON o.novel = g.novel AND o.model = g.model AND rn = 1)"""


def _lifts(spark, sf_dir):
    return M.lift_over_best(ranked(_means(spark, sf_dir)), ["novel", "model"], "mode", "rank", "v", TARGET)


@query(_OTHER + " SELECT * FROM l")
def arc_lift_best_other(spark, sf_dir):
    """Target mode minus the best other mode, and which."""
    return _lifts(spark, sf_dir).select(
        "novel", "model", F.round("target", 6).alias("target"), F.round("best_other", 6).alias("best_other"),
        "best_other_mode", F.round("lift", 6).alias("lift"),
    )


@query(
    _MEANS
    + f" SELECT novel, model, mode AS best_mode, ROUND(v, 6) AS value FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY novel, model ORDER BY v DESC, {RANK}) = 1"
)
def best_mode(spark, sf_dir):
    """The best mode, ties by the fixed order."""
    return M.best_mode(
        ranked(_means(spark, sf_dir)), ["novel", "model"], "mode", "rank", "v"
    ).select("novel", "model", "best_mode", F.round("value", 6).alias("value"))


@query("""WITH a AS (SELECT l_partkey AS probe, AVG(CAST(l_quantity AS DECIMAL(20,6))) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS probe, AVG(CAST(l_quantity AS DECIMAL(20,6))) AS t FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 5 GROUP BY 1)
SELECT COALESCE(a.probe, b.probe) AS probe, ROUND(COALESCE((3 * p + t) / 4, p, t), 6) AS overall FROM a FULL JOIN b ON a.probe = b.probe""")
def probe_overall_weighted(spark, sf_dir):
    """Three parts phase average, one part trajectory, or what is there."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").withColumns(
        {
            "p": F.when(F.col("l_returnflag") == "A", F.col("l_quantity")),
            "t": F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 5), F.col("l_quantity")),
        }
    )
    both = rows.where("p IS NOT NULL OR t IS NOT NULL").groupBy(F.col("l_partkey").alias("probe")).agg(
        F.when(F.count("p") > 0, M.exact_mean("p")).alias("p"), F.when(F.count("t") > 0, M.exact_mean("t")).alias("t")
    )
    return both.select("probe", F.round(M.probe_overall("p", "t"), 6).alias("overall"))


_CELLS = f"WITH {RECORDS}, c AS (SELECT model, mode, ptype, {mean_sql('apf')} v FROM rec GROUP BY ALL)"


@query(
    _CELLS
    + " SELECT 'all' AS view, model, mode, ROUND(AVG(v), 6) AS value FROM c GROUP BY ALL UNION ALL SELECT ptype AS view, model, mode, ROUND(AVG(v), 6) AS value FROM c GROUP BY ALL"
)
def cell_value_views(spark, sf_dir):
    """The value of a cell for one probe type or for all."""
    cells = M.pool(records(spark, sf_dir), ["model", "mode", "ptype"], "apf", "v")
    out = M.grains(cells, [["model", "mode"], ["model", "mode", "ptype"]], [F.round(F.avg("v"), 6).alias("value")])
    return out.select(F.coalesce("ptype", F.lit("all")).alias("view"), "model", "mode", "value")


@query(
    _OTHER
    + " SELECT model, COUNT(*) FILTER (lift > 0) AS wins, COUNT(lift) AS \"of\", MIN(lift) AS least, MAX(lift) AS most FROM l GROUP BY ALL"
)
def wins_and_range(spark, sf_dir):
    """In how many novels the target mode wins, and the range of its lift."""
    return M.wins(_lifts(spark, sf_dir).withColumn("lift", F.round("lift", 6)), ["model"])


@query(
    _CELLS
    + """ SELECT model, mode, ROUND(MAX(v) FILTER (ptype = 'A'), 6) AS a, ROUND(MAX(v) FILTER (ptype = 'N'), 6) AS n, ROUND(MAX(v) FILTER (ptype = 'R'), 6) AS r, ROUND(AVG(v), 6) AS overall FROM c GROUP BY ALL"""
)
def pivot_12_cells(spark, sf_dir):
    """Cells as columns over a fixed list."""
    wide = M.pivot_cells(
        M.pool(records(spark, sf_dir), ["model", "mode", "ptype"], "apf", "v"), ["model", "mode"], "ptype", list(TYPES),
        "v",
    )
    return wide.select(
        "model", "mode", *[F.round(t, 6).alias(t.lower()) for t in TYPES], F.round("overall", 6).alias("overall")
    )


@query(
    _MEANS
    + " SELECT novel, model, mode, ROUND(v, 6) AS v, ABS(v - MAX(v) OVER (PARTITION BY novel, model)) < 1e-9 AS is_best FROM m"
)
def block_max_flag(spark, sf_dir):
    """Marks each block's best value."""
    return M.flag_block_max(_means(spark, sf_dir), ["novel", "model"], "v").select(
        "novel", "model", "mode", F.round("v", 6).alias("v"), "is_best"
    )


@query(
    f"""WITH {RECORDS} SELECT COUNT(DISTINCT novel) AS novels, COUNT(DISTINCT "character") AS characters, COUNT(DISTINCT l_orderkey) AS probes, COUNT(*) AS records, COUNT(*) FILTER (rae = 0) AS unavailable, COALESCE(MAX(l_linenumber), 1)::BIGINT AS max_chapter FROM rec"""
)
def catalog_totals(spark, sf_dir):
    """Catalog counters."""
    return records(spark, sf_dir).agg(
        F.countDistinct("novel").alias("novels"), F.countDistinct("character").alias("characters"),
        F.countDistinct("l_orderkey").alias("probes"), F.count("*").alias("records"),
        F.count_if(F.col("rae") == 0).alias("unavailable"),
        F.greatest(F.max("l_linenumber"), F.lit(1)).cast("bigint").alias("max_chapter"),
    )


@query(
    """SELECT n_name, ROUND(c_acctbal, 2) AS v, ROUND(GREATEST(LEAST((c_acctbal / 100 - 20) / 80, 1), 0), 8) AS heat, CASE WHEN c_acctbal / 100 >= 70 THEN 'hi' WHEN c_acctbal / 100 <= 35 THEN 'lo' ELSE 'mid' END AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def heat_and_class(spark, sf_dir):
    """Heat scale and score class."""
    from ..functions.formats import heat, score_class

    t = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    v = F.col("c_acctbal") / 100
    return t.select(
        "n_name", F.round("c_acctbal", 2).alias("v"), F.round(heat(v), 8).alias("heat"), score_class(v).alias("cls")
    )
