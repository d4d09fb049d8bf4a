"""Queries over written-out files, and small rules: readers, sinks, books, events, validators.

Tables are first written in the format under test, with the flaws real files have, then read
back by the engine's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, ids
from ..functions import text as X
from ..operators import arcs as A
from ..operators import external as E
from ..operators import metrics as M
from ..operators import prompts as P
from ..operators import records as R
from ..operators import increments, retrieval, splitting, table_functions
from ..sinks import entity_files, versions
from ..sinks import publish as S
from ..sinks.paths import scratch
from ..sources import jsonl
from .base import RECORDS, mean_sql, records, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


TURN = "conv_id long, turn long, role string, text string"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line")
    )


@query("""
WITH n AS (SELECT *, 2 * row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS line_no FROM conversations)
SELECT conv_id, turn, role, length(text)::INT AS n, line_no FROM n WHERE turn % 5 <> 4""")
def tolerant_jsonl(spark, sf_dir):
    """Blank, cut-off, null, list and number lines are skipped; the others are records, with their line numbers.

    Files are read in blocks far smaller than they are.
    """
    path, rows = scratch(spark, "lines"), _turns(spark, sf_dir)
    cut = F.when(F.col("turn") % 5 == 4, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    junk = F.element_at(
        F.array(*map(F.lit, ("", "   ", "null", "[1, 2]", "7", "{"))), (F.col("turn") % 6 + 1).cast("int")
    )
    both = rows.select("conv_id", "turn", (F.col("conv_id") % 8).alias("part"), F.concat(cut, F.lit("\n"), junk).alias("value"))
    both.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    own.conf.set("spark.sql.files.openCostInBytes", 0)
    got = jsonl.tolerant(own, path, TURN)
    return got.select("rec.conv_id", "rec.turn", "rec.role", F.length("rec.text").alias("n"), "line_no")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn % 3 <> 1")
def byte_jsonl(spark, sf_dir):
    """A line with broken UTF-8 is dropped alone."""
    path, rows = scratch(spark, "bytes"), _turns(spark, sf_dir)
    broken = F.concat(F.lit('{"conv_id":1,"turn":1,"role":"'), F.unhex(F.lit("FFC3")).cast("string"), F.lit('"}'))
    rows.select(F.when(F.col("turn") % 3 == 1, broken).otherwise(F.col("line")).alias("value")).write.text(path)
    return jsonl.tolerant(spark, path, TURN, numbered=False).select("rec.conv_id", "rec.turn", "rec.role")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def strict_jsonl(spark, sf_dir):
    """S3: every line must be an object; files are read in blocks whatever their size."""
    path = scratch(spark, "strict")
    table(spark, sf_dir, "orders").select(
        F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value")
    ).write.text(path)
    return jsonl.strict(spark, path, "o_orderkey long, o_orderstatus string").select("rec.*")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_documents(spark, sf_dir):
    """One JSON document a file; the combined file is left out."""
    path = scratch(spark, "documents")
    rows = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation_"), "n_nationkey", F.lit(".json")).alias("file"), F.to_json(F.struct("*")).alias("text")
    )
    both = rows.unionByName(
        rows.agg(
            F.lit("all_nations.json").alias("file"),
            F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("text"),
        )
    )
    entity_files.register(spark)
    both.write.format(entity_files.NAME).mode("append").save(path)
    return jsonl.documents(
        spark, versions.current(spark, path), "n_nationkey int, n_name string, n_regionkey int"
    ).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey AS chapter, repeat(n_name || chr(10), n_nationkey + 1) AS text FROM nation")
def text_chapters(spark, sf_dir):
    """One text file a chapter, its number out of the name; other files are skipped."""
    path, n = scratch(spark, "chapters"), table(spark, sf_dir, "nation")
    rows = n.select(
        F.concat(F.lit("chapter_"), "n_nationkey", F.lit(".txt")).alias("file"),
        F.repeat(F.concat("n_name", F.lit("\n")), F.col("n_nationkey") + 1).alias("text"),
    )
    notes = n.select(F.concat(F.lit("notes_"), "n_nationkey", F.lit(".txt")).alias("file"), F.lit("x").alias("text"))
    entity_files.register(spark)
    rows.unionByName(notes).write.format(entity_files.NAME).mode("append").save(path)
    return jsonl.chapter_files(spark, versions.current(spark, path))


@query(
    "SELECT o_orderpriority AS mode, o_orderstatus || '__x' AS model, COUNT(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL"
)
def result_files(spark, sf_dir):
    """Result files by name: mode and model around the first double underscore; others are none."""
    end = F.when(F.col("o_orderkey") % 4 == 0, ".json").otherwise(".jsonl")
    named = table(spark, sf_dir, "orders").select(
        ids.result_file(F.concat("o_orderpriority", F.lit("__"), "o_orderstatus", F.lit("__x"), end)).alias("f")
    )
    return named.where("f IS NOT NULL").groupBy("f.mode", "f.model").agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND length(regexp_replace('X ***' || chr(10) || text, '\s+$', '')) >= 1000 AS ok FROM documents"""
)
def download_validation(spark, sf_dir):
    """A fetched book must have its own number, both marks, and enough text between."""
    number = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).cast("string")
    end = F.when(F.col("doc_id") % 5 == 0, "").otherwise("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***")
    content = F.concat(
        F.lit("Title [EBook #"), number, F.lit("]\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), "text", end
    )
    return table(spark, sf_dir, "documents").select("doc_id", X.valid_download(content, F.col("doc_id")).alias("ok"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def gzip_json_files(spark, sf_dir):
    """Compact gzip JSON, a folder an entity, read back."""
    path = scratch(spark, "gzip")
    S.gzip_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path, ["c_nationkey"])
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").json(path)


_CELL = "CASE WHEN {c} IS NULL THEN '--' WHEN abs({c} - max({c}) OVER (PARTITION BY model)) < 1e-9 THEN '\\textbf{{' || printf('%.1f', {c}) || '}}' ELSE printf('%.1f', {c}) END"


@query(rf"""WITH {RECORDS}, p AS (SELECT model, mode, ptype, {mean_sql('apf')} AS v FROM rec GROUP BY ALL),
w AS (SELECT model, mode, max(v) FILTER (ptype = 'A') AS a, max(v) FILTER (ptype = 'N') AS n, max(v) FILTER (ptype = 'R') AS r FROM p GROUP BY ALL),
o AS (SELECT *, (coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0)) / nullif((a IS NOT NULL)::INT + (n IS NOT NULL)::INT + (r IS NOT NULL)::INT, 0) AS o, row_number() OVER (PARTITION BY model ORDER BY mode) AS k, count(*) OVER (PARTITION BY model) AS size, row_number() OVER (ORDER BY model, mode) AS pos, dense_rank() OVER (ORDER BY model) AS b FROM w),
l AS (SELECT pos, b, k, CASE WHEN mode = '5-LOW' THEN '\rowcolor{{gray!15}} ' ELSE '' END || CASE WHEN k = 1 THEN '\multirow{{' || size || '}}{{*}}{{' || model || '}}' ELSE '' END || ' & ' || mode || ' & ' || {' || chr(32) || chr(38) || chr(32) || '.join(_CELL.format(c=c) for c in 'anro')} || ' \\' AS line FROM o),
rules AS (SELECT pos - 0.5 AS pos, b, '\midrule' AS line FROM l WHERE k = 1 AND b > 1), body AS (SELECT pos::DOUBLE AS pos, line FROM l UNION ALL SELECT pos, line FROM rules),
every AS (SELECT -4.0 AS pos, '\begin{{tabular}}{{llrrrr}}' AS line UNION ALL SELECT -3, '\toprule' UNION ALL SELECT -2, 'model & mode & A & N & R & Overall \\' UNION ALL SELECT -1, '\midrule' UNION ALL SELECT pos, line FROM body UNION ALL SELECT 1e9, '\bottomrule' UNION ALL SELECT 2e9, '\end{{tabular}}')
SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS line_no, line FROM every""")
def trajectory_latex(spark, sf_dir):
    """K4: a LaTeX table of a small report (models times modes): blocks, bold maxima, a marked row."""
    rows = M.pivot_cells(
        M.pool(records(spark, sf_dir), ["model", "mode", "ptype"], "apf", "v"), ["model", "mode"], "ptype",
        ["A", "N", "R"], "v",
    ).orderBy("model", "mode")
    text = S.latex_table(
        [r.asDict() for r in rows.collect()], ["A", "N", "R", "overall"], ["A", "N", "R", "Overall"], "model", "mode",
        "5-LOW",
    )
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


@query("""WITH c AS (SELECT r_name AS region, count(n_nationkey)::VARCHAR AS nations, printf('%.1f', avg(n_nationkey)) AS mean FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
t AS (SELECT 0 AS pos, 'region' AS region, 'nations' AS nations, 'mean' AS mean UNION ALL SELECT row_number() OVER (ORDER BY region), region, nations, mean FROM c)
SELECT pos::INT AS line_no, rtrim(rpad(region, (max(length(region)) OVER ())::INT, ' ') || '  ' || rpad(nations, (max(length(nations)) OVER ())::INT, ' ') || '  ' || mean) AS line FROM t""")
def terminal_table(spark, sf_dir):
    """K8: plain columns for a terminal, of a small report (a row a region)."""
    n = table(spark, sf_dir, "region").join(
        table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left"
    )
    rows = n.groupBy(F.col("r_name").alias("region")).agg(
        F.count("n_nationkey").alias("nations"), F.avg("n_nationkey").alias("mean")
    ).orderBy("region")
    text = S.text_table([r.asDict() for r in rows.collect()], ["region", "nations", "mean"])
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, line string")


@query(
    "SELECT l_orderkey AS chapter, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'e' || l_partkey END AS event_id, l_shipmode_ AS description, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS n_characters FROM (SELECT *, coalesce(nullif(l_returnflag, 'N'), '') AS l_shipmode_ FROM lineitem)"
)
def flatten_events(spark, sf_dir):
    """Events out of chapter blocks; entries that are none are skipped, missing fields are empty."""
    li = table(spark, sf_dir, "lineitem")
    event = F.struct(
        F.when(F.col("l_linenumber") % 2 != 0, F.concat(F.lit("e"), "l_partkey")).alias("event_id"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("description"),
        F.when(F.col("l_linenumber") % 3 != 0, F.array("l_linestatus")).alias("characters_involved"),
    )
    blocks = li.groupBy(F.col("l_orderkey").alias("chapter")).agg(F.collect_list(event).alias("events")).withColumn(
        "events", F.concat("events", F.array(F.lit(None)))
    )
    out = A.flatten_events(blocks.withColumns({"novel": F.lit("n"), "character": F.lit("c")}))
    return out.select("chapter", "event_id", "description", F.size("characters_involved").alias("n_characters"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderkey % 7 = 0)")
def dry_run_rows(spark, sf_dir):
    """rows flagged as a preview, or holding the old placeholder, are no results."""
    o = table(spark, sf_dir, "orders")
    made = o.select(
        "o_orderkey", (F.col("o_orderstatus") == "P").alias("dry_run"),
        F.when(F.col("o_orderkey") % 7 == 0, X.DRY_RUN_RESPONSE).otherwise("r").alias("response"),
    )
    return made.where(~R.is_dry_run(made)).select("o_orderkey")


@query(
    """WITH s AS (SELECT DISTINCT n_nationkey, lower(n_name) AS slug FROM nation) SELECT slug, CASE WHEN n_nationkey % 2 = 0 THEN 'The ' || slug ELSE upper(slug[1]) || replace(slug[2:], '_', ' ') END AS "character" FROM s"""
)
def slug_names(spark, sf_dir):
    """Names by slug; a slug that the list lacks is spelled out."""
    s = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("slug"))
    known = s.where("n_nationkey % 2 = 0").select("slug", F.concat(F.lit("The "), "slug").alias("character"))
    return A.name_by_slug(known, s.select("slug")).select("slug", "character")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS digest FROM documents""")
def book_wrapper(spark, sf_dir):
    """The archive's header and footer go; an end mark ahead of the start mark is no end."""
    mark = "*** {} OF THE PROJECT GUTENBERG EBOOK A TITLE ***"
    book = F.concat(
        F.lit(f"header\n{mark.format('END')}\n{mark.format('START')}\n\n"), "text",
        F.lit(f"\n\n{mark.format('END')}\nfooter\n{mark.format('END')}"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.encode(X.strip_wrapper(book), "UTF-8")).alias("digest")
    )


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents), c AS (SELECT doc_id, k, CASE WHEN k = 2 THEN 'short' ELSE t END AS t FROM d, (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT doc_id AS novel, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS chapter, md5(t) AS digest FROM c WHERE length(t) >= 300""")
def split_chapters(spark, sf_dir):
    """Bodies between headings, short ones dropped, the rest numbered densely."""
    chapter = lambda k, body: [F.lit(f"Chapter {k}. On it\n\n"), body, F.lit("\n\n")]
    book = F.concat(*[p for k in (1, 2, 3, 4) for p in chapter(k, F.lit("short") if k == 2 else F.col("text"))])
    return splitting.split_chapters(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("novel"), book.alias("text"))
    ).select("novel", "chapter", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
s AS (
  SELECT doc_id, t, 0::BIGINT AS pos, 0::BIGINT AS nxt, '' AS piece, FALSE AS done FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, nxt, CASE WHEN length(t) - nxt <= 1500 THEN length(t) WHEN last > 1 THEN nxt + last - 1 ELSE nxt + 1500 END,
         CASE WHEN length(t) - nxt <= 1500 THEN CASE WHEN nxt = 0 THEN t ELSE regexp_replace(regexp_replace(substr(t, nxt + 1), '^\s+', ''), '\s+$', '') END
              ELSE regexp_replace(regexp_replace(substr(t, nxt + 1, CASE WHEN last > 1 THEN last - 1 ELSE 1500 END), '^\s+', ''), '\s+$', '') END, length(t) - nxt <= 1500
  FROM (SELECT *, CASE WHEN strpos(reverse(substr(t, nxt + 1, 1500)), chr(10) || chr(10)) > 0 THEN 1500 - strpos(reverse(substr(t, nxt + 1, 1500)), chr(10) || chr(10)) ELSE 0 END AS last FROM s WHERE NOT done))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, nxt) - 1)::INT AS idx, md5(piece) AS digest FROM s WHERE nxt > 0 AND piece <> ''""")
def sub_chunk(spark, sf_dir):
    """Pieces of bounded length, cut at the last blank line that fits, else hard."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text")
    )
    return splitting.sub_chunks(d, "doc_id", "text", 1500).select(
        "doc_id", "idx", F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'valid' ELSE 'partial' END WHEN l_returnflag = 'N' THEN 'valid' ELSE 'invalid' END AS validity FROM lineitem"
)
def partial_votes(spark, sf_dir):
    """A partial vote counts in numbered annotation files only."""
    said = F.when(
        F.col("l_returnflag") == "A", "partial"
    ).when(F.col("l_returnflag") == "N", "valid").otherwise("invalid")
    name = F.when(
        F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x_annotations_"), "l_linenumber", F.lit(".json"))
    ).otherwise("x_annotations.json")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", A.file_validity(said, name).alias("validity")
    )


@query(r"""WITH s AS (SELECT DISTINCT l_orderkey AS novel, l_linenumber AS chapter FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS novel, UNNEST([3, 6]) AS query_chapter FROM lineitem),
w AS (SELECT novel, query_chapter, UNNEST(range(greatest(1, query_chapter - 4), query_chapter + 1)) AS chapter FROM t),
g AS (SELECT w.*, s.chapter IS NOT NULL AS there FROM w LEFT JOIN s ON w.novel = s.novel AND w.chapter = s.chapter),
c AS (SELECT novel, query_chapter, string_agg('[Chapter ' || chapter || ']' || chr(10) || 'about ' || chapter, chr(10) || chr(10) ORDER BY chapter) FILTER (there) AS a, string_agg(chapter::VARCHAR, ', ' ORDER BY chapter) FILTER (NOT there) AS b FROM g GROUP BY ALL)
SELECT 'summary' AS mode, novel, query_chapter, nullif(concat_ws(chr(10) || chr(10), a, '[note] Missing summaries for chapters: [' || b || ']'), '') AS context FROM c
UNION ALL SELECT 'vanilla', novel, query_chapter, NULL FROM t UNION ALL SELECT 'echo', novel, query_chapter, 'novel ' || novel FROM t""")
def context_modes(spark, sf_dir):
    """Context builders by mode, one of them the user's own; an unknown mode is an error."""
    li = table(spark, sf_dir, "lineitem")
    summaries = li.select(
        F.col("l_orderkey").alias("novel"), F.col("l_linenumber").alias("chapter")
    ).distinct().withColumn("summary", F.concat(F.lit(" about "), "chapter"))
    trials = li.select(F.col("l_orderkey").alias("novel")).distinct().withColumn(
        "query_chapter", F.explode(F.array(F.lit(3), F.lit(6)))
    )
    retrieval.builder("echo")(
        lambda t: t.withColumn("context", F.concat(F.lit("novel "), F.col("novel").cast("string")))
    )
    made = {
        m: retrieval.build_context(m, trials, **({"summaries": summaries} if m == "summary" else {}))
        for m in ("vanilla", "summary", "echo")
    }
    try:
        retrieval.build_context("no such mode", trials)
        raise AssertionError("an unknown mode went through")
    except ValueError:
        pass
    out = None
    for m, df in made.items():
        df = df.select(F.lit(m).alias("mode"), "novel", "query_chapter", "context")
        out = df if out is None else out.unionByName(df)
    return out


@query("""WITH l AS (SELECT n_regionkey, list_sort(list(n_name)) AS n, n_regionkey % 4 AS k FROM nation GROUP BY ALL), c AS (SELECT n_regionkey, n[1:k] AS n FROM l)
SELECT n_regionkey, CASE len(n) WHEN 0 THEN '' WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' and ' || n[2] ELSE array_to_string(n[:-2], ', ') || ', and ' || n[-1] END AS names FROM c""")
def name_lists(spark, sf_dir):
    """H3: names joined for a caption."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    return n.select("n_regionkey", formats.join_names(F.slice("n", F.lit(1), F.col("n_regionkey") % 4)).alias("names"))


@query(
    "SELECT l_orderkey, n = l_orderkey % 7 AS ready FROM (SELECT l_orderkey, COUNT(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL)"
)
def abstract_phases(spark, sf_dir):
    """H7: an out-of-world probe needs as many abstract phases as it has phases."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("phases"))
    return p.select("l_orderkey", A.abstract_ready(F.col("phases"), F.col("l_orderkey") % 7).alias("ready"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'P' THEN 'off_phase' ELSE o_orderstatus END AS fit, CASE WHEN o_orderkey % 3 = 0 OR o_orderstatus = 'P' THEN 'fail' ELSE o_orderstatus END AS voice FROM orders"
)
def validator_policy(spark, sf_dir):
    """H8: a validator whose call failed, or that says nothing, counts as failed."""
    said, error = F.nullif(F.col("o_orderstatus"), F.lit("P")), F.when(F.col("o_orderkey") % 3 == 0, "timeout")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", A.verdict_or_fail(said, error, "off_phase").alias("fit"),
        A.verdict_or_fail(said, error).alias("voice"),
    )


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS id FROM lineitem WHERE l_linenumber > 1), c AS (SELECT o_orderkey AS k, list_sort(list(id) FILTER (id IS NOT NULL)) AS ids FROM orders LEFT JOIN e ON e.k = o_orderkey GROUP BY ALL),
x AS (SELECT k, coalesce(ids, []) AS ids, CASE k % 4 WHEN 0 THEN 3 END AS said, k % 4 = 1 AS failed, k % 4 = 2 AS silent FROM c)
SELECT k, CASE WHEN len(ids) = 0 THEN NULL WHEN failed OR silent THEN ids[1] ELSE said END AS event_id,
       CASE WHEN len(ids) = 0 THEN 9 WHEN failed OR silent THEN 10 * ids[1] WHEN list_contains(ids, said) THEN 10 * said END AS chapter, len(ids) > 0 AND NOT failed AND NOT silent AND said IS NULL AS rejected FROM x""")
def locator_rules(spark, sf_dir):
    """Where a scene is: the event answered, the first candidate where the call failed, the midpoint without candidates."""
    e = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("event_id")
    ).distinct()
    found = e.groupBy("k").agg(
        F.array_sort(
            F.collect_list(F.struct("event_id", (10 * F.col("event_id")).alias("chapter")))
        ).alias("candidates")
    )
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    cands = every.join(found, "k", "left").select(
        "k", F.coalesce("candidates", F.array().cast("array<struct<event_id:int,chapter:int>>")).alias("candidates"),
        F.lit(9).alias("midpoint"),
    )
    answers = every.where("k % 4 <> 2").select(
        "k", F.when(F.col("k") % 4 == 0, 3).alias("event_id"), F.when(F.col("k") % 4 == 1, "timeout").alias("error")
    )
    return E.locate(cands, answers, "k").select("k", "event_id", "chapter", "rejected")


@query("SELECT doc_id, least(length(text), 60000)::INT AS n, md5(substr(text, 1, 60000)) AS digest FROM documents")
def chapter_cap(spark, sf_dir):
    """A chapter goes into a prompt up to a fixed length."""
    capped = X.prompt_chapter(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(capped).alias("n"), F.md5(F.encode(capped, "UTF-8")).alias("digest")
    )


@query(
    "SELECT o_orderkey, 'eval_records_' || CASE WHEN o_orderstatus = 'P' THEN 'claude' ELSE 'my-' || lower(o_orderstatus) || '-1' END || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_nothought' END || '.jsonl' AS file FROM orders"
)
def record_files(spark, sf_dir):
    """A judge's record file; the ablation without thoughts has one of its own."""
    model = F.when(F.col("o_orderstatus") == "P", "vendor/Claude-x").otherwise(
        F.concat(F.lit("vendor/My."), "o_orderstatus", F.lit(":1"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.records_file(ids.family_tag(model), F.col("o_orderkey") % 2 == 0).alias("file")
    )


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN '[Description]' || chr(10) || role || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || chr(10) || '[Memories]' || chr(10) || 'm' || turn END END AS sections,
md5(substr(role || chr(10) || text || chr(10) || 'q', 1, 100)) AS query FROM conversations""")
def lifechoice_sections(spark, sf_dir):
    """A description and memories as labelled sections, and the query they are looked up by."""
    c = table(spark, sf_dir, "conversations")
    description, memories = F.when(F.col("turn") % 3 != 0, F.concat(F.lit(" "), "role")), F.when(
        F.col("turn") % 2 != 0, F.concat(F.lit("m"), "turn", F.lit("\n"))
    )
    return c.select(
        "conv_id", "turn", P.lifechoice(description, memories).alias("sections"),
        F.md5(F.encode(P.lifechoice_query(F.col("role"), F.col("text"), F.lit("q"), 100), "UTF-8")).alias("query"),
    )


@query(ORACLES["split_chapters"])
def chapters_in_sql(spark, sf_dir):
    """The same chapters by a table function, LATERAL in SQL."""
    table_functions.register(spark)
    chapter = lambda k, body: [F.lit(f"Chapter {k}. On it\n\n"), body, F.lit("\n\n")]
    book = F.concat(*[p for k in (1, 2, 3, 4) for p in chapter(k, F.lit("short") if k == 2 else F.col("text"))])
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("novel"), book.alias("text"))
    return spark.sql(
        "SELECT novel, c.chapter, md5(encode(c.text, 'UTF-8')) AS digest FROM {books}, LATERAL book_chapters(text) AS c",
        books=books,
    )


@query(ORACLES["sub_chunk"])
def pieces_in_sql(spark, sf_dir):
    """The same pieces by a table function, LATERAL in SQL."""
    table_functions.register(spark)
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text")
    )
    return spark.sql(
        "SELECT doc_id, c.idx, md5(encode(c.text, 'UTF-8')) AS digest FROM {d}, LATERAL text_pieces(text, 1500) AS c", d=d
    )


@query("""
SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS quantity,
       max(l_shipdate)::VARCHAR AS shipped
FROM lineitem GROUP BY ALL""")
def incremental_latest(spark, sf_dir):
    """The last record of each key after ten increments, each of which reads its own file only."""
    source, path = scratch(spark, "arrivals"), scratch(spark, "latest")
    keys = ["l_orderkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(
        *keys, "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    rows.repartition(10).write.parquet(source)
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    increments.take_in(spark, source, rows.schema, keys, order, path, files_at_once=1)
    return increments.latest(spark, path, keys).select(
        *keys, F.col("l_quantity").alias("quantity"), F.col("l_shipdate").cast("string").alias("shipped")
    )
