"""Queries over stages, filters and views of axes and probes, verified names, volumes, versions, the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import arcs as A
from ..operators import conversations as C
from ..operators import external as E
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import splitting, vector_index
from ..sinks import publish as S
from ..sinks import versions as V
from ..sinks.paths import scratch
from ..sources import jsonl, stages
from .base import RECORDS, mean_sql, records, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""
WITH p AS (SELECT p_partkey AS character, p_size FROM part)
SELECT character, CASE WHEN p_size % 4 = 0 THEN 'validated' WHEN p_size % 3 = 0 AND p_size % 5 <> 0 THEN 'stamped'
                       ELSE 'final_auto' END AS stage
FROM p WHERE p_size % 4 = 0 OR (p_size % 3 = 0 AND p_size % 5 <> 0) OR p_size % 7 <> 0""")
def axis_stage(spark, sf_dir):
    """The axis file that counts: validated, else the probe file's stamped source where it is there, else automatic."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    files = p.select(
        F.col("p_partkey").alias("character"),
        F.explode(
            F.array(
                F.struct(F.lit("final_auto").alias("stage"), (size % 7 != 0).alias("exists")),
                F.struct(F.lit("stamped").alias("stage"), ((size % 3 == 0) & (size % 5 != 0)).alias("exists")),
                F.struct(F.lit("validated").alias("stage"), (size % 4 == 0).alias("exists")),
                F.struct(F.lit("final").alias("stage"), F.lit(True).alias("exists")),
            )
        ).alias("f"),
    ).select("character", "f.stage", "f.exists")
    return stages.axes_stage(files, ["character"]).select("character", "stage")


@query("SELECT c_mktsegment, COUNT(*) AS n, TRUE AS refused FROM customer GROUP BY ALL")
def write_once_refuses(spark, sf_dir):
    """K3: what is there is not replaced: the second write is refused and the first one stays."""
    path = scratch(spark, "once")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    S.write_once(c, path)
    try:
        S.write_once(c.where("c_custkey % 2 = 0"), path)
        refused = False
    except Exception as e:  # noqa: BLE001  the kind of error is Spark's
        refused = "already exists" in str(e)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.lit(refused).alias("refused")
    )


#: Lines of an order as its phases: one row an order and line number.
_PHASES = """
l AS (SELECT l_orderkey AS k, l_linenumber::INT AS i, min(l_returnflag) AS m, max(l_quantity)::INT AS q, min(l_discount) > 0.05 AS good
      FROM lineitem GROUP BY ALL)"""


def _phases(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("i")
    ).agg(
        F.min("l_returnflag").alias("m"), F.max("l_quantity").cast("int").alias("q"),
        (F.min("l_discount") > 0.05).alias("good"),
    )


def _probes(spark, sf_dir):
    """Orders as probes: their lines are phase responses, given in falling order."""
    r = _phases(spark, sf_dir).select(
        F.col("k").alias("probe_id"),
        F.struct(
            (F.col("i") - 1).alias("phase_idx"), F.col("q").cast("string").alias("gt_action"),
            F.lit(None).cast("string").alias("gt_speech"), F.lit(None).cast("string").alias("gt_thought"),
            F.struct(
                F.struct(F.col("m").alias("verdict")).alias("voice"),
                F.struct(F.when(F.col("good"), "pass").otherwise("adjacent").alias("verdict")).alias("phase_fit"),
            ).alias("quality"),
        ).alias("r"),
    )
    rows = r.groupBy("probe_id").agg(F.sort_array(F.collect_list("r"), asc=False).alias("phase_responses"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("probe_id"), "o_orderstatus", "o_orderpriority")
    note = lambda c: F.struct(c.alias("note"))
    check = F.struct(
        note(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("anchor"),
        note(F.when(F.col("o_orderstatus") != "P", F.lit("world"))).alias("world"),
        F.struct(F.when(F.col("o_orderstatus") == "O", F.array(F.lit(1), F.lit(2))).alias("weak_pairs")).alias("discrimination"),
    )
    return rows.join(o, "probe_id").withColumn("probe_check", check)


@query(f"""
WITH {_PHASES}
SELECT k AS probe_id, string_agg((i - 1) || ':' || q || ':' || m || ':' || CASE WHEN good THEN 'pass' ELSE 'adjacent' END, ',' ORDER BY i) AS refs,
       CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'world' END AS note,
       CASE o_orderstatus WHEN 'O' THEN 2 ELSE 0 END AS weak
FROM l JOIN orders ON k = o_orderkey GROUP BY k, o_orderstatus, o_orderpriority""")
def probe_display(spark, sf_dir):
    """A probe's references by phase with their verdicts, its check notes, its weak pairs."""
    view = A.probe_view(_probes(spark, sf_dir))
    line = lambda r: F.concat_ws(":", r["phase_idx"].cast("string"), r["action"], r["voice"], r["fit"])
    return view.select(
        "probe_id", F.array_join(F.transform("refs", line), ",").alias("refs"), "note",
        F.size("weak_pairs").alias("weak"),
    )


@query(f"""
WITH {_PHASES}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS nth FROM l)
SELECT k, string_agg('Phase ' || i || ' (' || m || '): ' || substr(repeat(m || ' ', 4 * q), 1, 140), chr(10) ORDER BY i) AS trajectory,
       string_agg('Phase ' || i || ' -> ' || (i + 1) || ': ' || m, chr(10) ORDER BY i) AS contrasts,
       string_agg(CASE WHEN nth <= 3 THEN '[e' || i || '] ch. ' || q || ': ' || m END, chr(10) ORDER BY i) AS candidates
FROM p GROUP BY k""")
def generation_blocks(spark, sf_dir):
    """The blocks of probe generation: trajectory (descriptions capped), contrasts, the first candidates."""
    i, m, q = F.col("i"), F.col("m"), F.col("q")
    phase = F.struct(
        i.alias("phase_idx"), m.alias("label"), F.repeat(F.concat(m, F.lit(" ")), 4 * q).alias("position_description")
    )
    contrast = F.struct(i.alias("from_phase_idx"), (i + 1).alias("to_phase_idx"), m.alias("contrast"))
    event = F.struct(
        i.alias("at"), F.concat(F.lit("e"), i.cast("string")).alias("event_id"), q.alias("chapter"), m.alias("description")
    )
    rows = _phases(spark, sf_dir).groupBy("k").agg(
        F.collect_list(phase).alias("p"), F.array_sort(F.collect_list(contrast)).alias("c"),
        F.array_sort(F.collect_list(event)).alias("e"),
    )
    return rows.select(
        "k", P.phases_block(F.col("p")).alias("trajectory"), P.contrasts_block(F.col("c")).alias("contrasts"),
        P.candidates_block(F.col("e"), 3).alias("candidates"),
    )


@query("""
SELECT p_partkey AS axis_id FROM part
WHERE (p_size % 3 = 0 OR p_type IS DISTINCT FROM 'ECONOMY') AND p_partkey % 2 = 1""")
def axis_filter(spark, sf_dir):
    """axes that the critics rejected go, unless a human validated them; only the wanted ids."""
    p = table(spark, sf_dir, "part")
    axes = p.select(
        F.col("p_partkey").alias("axis_id"),
        F.when(F.col("p_size") % 3 == 0, "final_validated").otherwise("final_auto").alias("stage"),
        F.when(F.col("p_type") == "ECONOMY", "none_axis").otherwise("valid_axis").alias("validation_tag"),
    )
    return A.generation_filter(axes).where("axis_id % 2 = 1").select("axis_id")


@query("""
SELECT o_orderkey AS probe_id, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus = 'F' ELSE o_orderkey % 3 = 0 END AS dropped
FROM orders""")
def probe_drops(spark, sf_dir):
    """In-text probes go by a failed anchor check, the others by a failed world check; missing verdicts keep."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "in_text").otherwise("out_of_world")
    anchor = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass")
    world = F.when(F.col("o_orderkey") % 3 == 0, "fail").when(F.col("o_orderkey") % 3 == 1, "pass")
    return o.select(F.col("o_orderkey").alias("probe_id"), A.drop_verdict(kind, anchor, world).alias("dropped"))


@query(r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || text || '</think>  ' WHEN 1 THEN ' ' || chr(10) || chr(9)
                  WHEN 2 THEN '<THINK>x</THINK>' || text WHEN 3 THEN NULL END AS raw, text FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 2 AND regexp_replace(text, '\s+', '', 'g') <> '' THEN md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))
       ELSE md5('(empty response)') END AS digest
FROM t""")
def empty_responses(spark, sf_dir):
    """A response that is blank, missing, or a think block alone is the sentinel."""
    c, t = table(spark, sf_dir, "conversations"), F.col("text")
    raw = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>"), t, F.lit("</think>  "))).when(
        F.col("turn") % 4 == 1, " \n\t"
    ).when(F.col("turn") % 4 == 2, F.concat(F.lit("<THINK>x</THINK>"), t))
    return c.select("conv_id", "turn", F.md5(F.encode(X.or_sentinel(raw), "UTF-8")).alias("digest"))


@query("""
SELECT p_partkey, 'https://scholar.google.com/scholar?q=' || replace(replace(replace(replace(replace(replace(
         p_brand || ' ' || p_type || ' *~é&' || ' ' || p_size, '*', '%2A'), '#', '%23'), 'é', '%C3%A9'), '&', '%26'), '/', '%2F'), ' ', '+') AS url
FROM part""")
def citation_urls(spark, sf_dir):
    """Search addresses of citations, encoded as query strings."""
    title = F.concat("p_type", F.lit(" *~é&"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.search_url(F.col("p_brand"), title, F.col("p_size").cast("string")).alias("url")
    )


@query("""
WITH n AS (SELECT c_custkey, c_custkey % 4 = 0 AS present, CASE WHEN c_custkey % 5 = 0 THEN 'not_a_character' WHEN c_custkey % 5 = 1 THEN 'real'
                  WHEN c_custkey % 5 = 2 THEN 'unsure' END AS verdict FROM customer),
f AS (SELECT *, NOT present AND verdict IS NOT DISTINCT FROM 'not_a_character' AS dropped FROM n)
SELECT c_custkey, NOT present AS flagged, NOT dropped AS kept, CASE WHEN NOT present THEN CASE WHEN dropped THEN verdict ELSE 'real' END END AS verdict,
       CASE WHEN NOT present THEN CASE WHEN verdict IS NULL THEN 'judge unavailable — kept' WHEN verdict = 'real' THEN '' ELSE 'seen' END END AS reason
FROM f""")
def verified_names(spark, sf_dir):
    """Names that the text lacks are judged; only a plain no drops one, a missing verdict keeps it."""
    k = F.col("c_custkey")
    names = table(spark, sf_dir, "customer").select(k.alias("name"), (k % 4 == 0).alias("present"))
    verdict = F.when(k % 5 == 0, "not_a_character").when(k % 5 == 1, "real").when(k % 5 == 2, "unsure")
    told = table(spark, sf_dir, "customer").where(verdict.isNotNull()).select(
        k.alias("name"), verdict.alias("verdict"), F.when(k % 5 != 1, "seen").alias("reason")
    )
    flagged = E.flagged_names(names, told, "present").withColumn("flagged", F.lit(True))
    dropped = flagged.select("name", "verdict")
    kept = E.keep_unless_rejected(names, dropped).select("name", F.lit(True).alias("kept"))
    return names.join(flagged, "name", "left").join(kept, "name", "left").select(
        F.col("name").alias("c_custkey"), F.coalesce("flagged", F.lit(False)).alias("flagged"),
        F.coalesce("kept", F.lit(False)).alias("kept"), "verdict", "reason",
    )


@query("""
SELECT o_orderkey AS "index", CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS system,
       CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus || chr(10) || chr(10) || o_orderpriority END AS user
FROM orders WHERE o_orderkey % 3 <> 0""")
def rollout_resume(spark, sf_dir):
    """Rollouts go on by integer index; prompts from their own columns, else scenario and question."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("scenario"),
        F.col("o_orderpriority").alias("question"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("  ").alias("gen_system"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("gen_user"),
    )
    left = C.not_yet_rolled_out(o, o.where("index % 3 = 0").select("index"))
    return left.select("index", C.rollout_prompt(left).alias("p")).select("index", "p.system", "p.user")


@query(r"""
WITH d AS (SELECT doc_id // 3 AS novel, doc_id AS volume, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents)
SELECT novel, md5(string_agg(t, chr(10) || chr(10) || chr(10) ORDER BY volume)) AS digest FROM d GROUP BY ALL""")
def merged_volumes(spark, sf_dir):
    """Volumes without their wrappers, stripped, in order, three line breaks between."""
    mark = "*** {} OF THE PROJECT GUTENBERG EBOOK A TITLE ***"
    book = F.concat(F.lit(f"header\n{mark.format('START')}\n\n"), "text", F.lit(f"\n{mark.format('END')}\nfooter"))
    d = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 3").alias("novel"), F.col("doc_id").alias("volume"), book.alias("text")
    )
    return splitting.merge_volumes(d).select("novel", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"""
WITH {RECORDS}, m AS (SELECT novel, mode, model, {mean_sql('apf')} AS v FROM rec WHERE NOT (model = 'P' AND novel < 'F') AND NOT (model = 'F' AND novel > 'P') GROUP BY ALL)
SELECT novel, mode, ROUND(coalesce(max(v) FILTER (model = 'P'), max(v) FILTER (model = 'F'), arg_min(v, model)), 6) AS score FROM m GROUP BY ALL""")
def display_scores(spark, sf_dir):
    """The preferred model's score, else the fallback's, else the first one there is."""
    r = records(spark, sf_dir).where("NOT (model = 'P' AND novel < 'F') AND NOT (model = 'F' AND novel > 'P')")
    means = M.pool(r, ["novel", "mode", "model"], "apf", "v")
    out = M.display_score(means, ["novel", "mode"], "model", "v", "P", "F")
    return out.select("novel", "mode", F.round("score", 6).alias("score"))


@query("SELECT n_regionkey, COUNT(*) AS n, 1 AS builds FROM nation GROUP BY ALL")
def cached_build(spark, sf_dir):
    """A builder runs where nothing has been published yet, and not again."""
    path, runs = scratch(spark, "cached"), []

    def build():
        runs.append(1)
        return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))

    for _ in range(3):
        out = V.cached(spark, path, build)
    return out.withColumn("builds", F.lit(len(runs)))


@query("SELECT o_orderstatus, COUNT(*) AS n, 2 AS version FROM orders GROUP BY ALL")
def versioned_publish(spark, sf_dir):
    """K2: versions and a pointer: a failed one changes nothing, readers see the old or the new one, whole."""
    path, o = scratch(spark, "versions"), table(spark, sf_dir, "orders")
    counts = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    V.publish(counts.withColumn("version", F.lit(1)), path)
    before = V.read(spark, path)
    try:
        V.publish(counts.withColumn("version", F.lit(9)), path, failed="o_orderstatus = 'F'")
    except S.PublishError:
        pass
    kept = before.agg(F.min("version") == 1).first()[0] and V.read(spark, path).agg(F.max("version")).first()[0] == 1
    V.publish(counts.withColumn("version", F.lit(2)), path)
    still = before.agg(F.max("version")).first()[0] == 1  # a reader keeps the version it has resolved
    return V.read(spark, path).where(F.lit(kept and still))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    chunks = e.select(
        F.lit("n").alias("novel"), F.col("label").alias("chapter"), F.col("vec_id").alias("chunk_idx"),
        F.col("embedding").alias("vec"),
    )
    queries = e.where("vec_id % 100 = 0").select(
        F.lit("n").alias("novel"), F.col("vec_id").alias("query_id"), F.col("label").alias("query_chapter"),
        F.col("embedding").alias("qvec"),
    )
    return chunks, queries


_TOP = """
WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nn FROM c),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_idx, c.label AS chapter,
             list_sum(list_transform(range(1, len(c.e) + 1), lambda i: c.e[i] * q.e[i])) / ((c.nn + 1e-12) * (q.nn + 1e-12)) AS sim
      FROM n q JOIN n c ON c.label <= q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(sim, 9) DESC, chapter, chunk_idx) AS rank FROM s)
SELECT query_id, chunk_idx, rank, ROUND(sim, 6) AS sim FROM r WHERE rank <= 6"""


@query(_TOP)
def indexed_topk(spark, sf_dir):
    """The six most similar visible chunks through the partitioned index; other blocks are passed over."""
    chunks, queries = _vectors(spark, sf_dir)
    index = vector_index.build(chunks, scratch(spark, "index"))
    hits, _ = vector_index.search(index, queries, scratch(spark, "search"))
    return hits.select("query_id", "chunk_idx", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 6).alias("sim"))


@query("""
SELECT doc_id // 10 AS chapter, doc_id AS chunk_idx, md5(text) AS digest, e.embedding[1]::DOUBLE AS first, len(e.embedding) AS size
FROM documents JOIN embeddings e ON doc_id = vec_id""")
def index_scan(spark, sf_dir):
    """Chunks with their vectors, written and read as one aligned table."""
    path, d = scratch(spark, "chunks"), table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = d.select("doc_id", "text").join(e, "doc_id").select(
        F.lit("n").alias("novel"), F.expr("doc_id div 10").cast("int").alias("chapter"),
        F.col("doc_id").cast("int").alias("chunk_idx"), "text", "embedding",
    )
    rows.write.parquet(path)
    back = jsonl.vector_index(spark, path)
    return back.select(
        F.col("chapter").cast("bigint").alias("chapter"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        F.md5(F.encode("text", "UTF-8")).alias("digest"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.size("embedding").alias("size"),
    )


@query(f"""
WITH {_PHASES}, c AS (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY q > 25, i) AS o FROM l),
a AS (SELECT k, string_agg(m, ',' ORDER BY o) AS axes FROM c GROUP BY k), f AS (SELECT k, m, min(o) AS o FROM c GROUP BY ALL),
n AS (SELECT k, string_agg(m, ',' ORDER BY o) AS names FROM f GROUP BY k)
SELECT k, axes, names FROM a JOIN n USING (k)""")
def axis_lists(spark, sf_dir):
    """Intrapersonal then relational axes, each in order; their names, each once, in the order they come."""
    rows = _phases(spark, sf_dir).groupBy("k").agg(
        *[
            F.array_sort(F.collect_list(F.when(kind, F.struct("i", "m")))).alias(name)
            for name, kind in (("a", F.col("q") <= 25), ("b", F.col("q") > 25))
        ]
    )
    both = F.transform(F.concat("a", "b"), lambda x: x["m"])
    return rows.select("k", F.array_join(both, ",").alias("axes"), F.array_join(F.array_distinct(both), ",").alias("names"))
