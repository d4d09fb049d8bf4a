"""The operators bound to the test tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_classifier, decontaminate, fill_in_middle, hard_negatives, licenses, packing, quality_rules, repair, secret_scan, sharding, simhash, toxicity, warc
from .common import table


@cache
def forest() -> list:
    """The secret scanner's forest."""
    return secret_scan.trained()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id",
        "offset",
    )


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return compression_classifier.score(docs, model).select(
        F.col("id").alias("doc_id"), "held_out", "score", "predicted"
    )


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "end", "distance", "item_length")


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).select(F.col("id").alias("doc_id"), "severity", "grade", "p_toxic", "toxic")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), forest()).withColumnRenamed("id", "doc_id")


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op12_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = repair.round_trip(table(spark, sf_dir, "documents"))
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", noisy))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_best_fit_packing, op3_simhash_near_duplicates, op4_compression_classifier,
        op5_benchmark_decontamination, op6_warc_archives, op7_toxicity, op8_license_scan, op9_secret_scan,
        op10_sampled_splitters, op11_fill_in_middle, op12_repair_shards,
        op13_hard_negatives,
    )
}

_WS = r"[\x20\x09-\x0D]+"
_B = quality_rules.SKETCH_BITS
_CUT = f"CASE WHEN length(bin(v)) <= {_B} THEN v ELSE (v >> (length(bin(v)) - {_B})) << (length(bin(v)) - {_B}) END"


def _quality_sql() -> str:
    rates = ", ".join(
        f"10000 * ({a} + {more}) // greatest({b} + {prior}, 1) AS {k}"
        for k, (a, b, more, prior, _) in quality_rules.RATES.items()
    )
    names = list(quality_rules.RATES)
    values = " ".join(f"WHEN '{k}' THEN {_CUT.replace('v', f'r.{k}')}" for k in names)
    both = ", ".join(f"'{k}'" for k, (*_, x) in quality_rules.RATES.items() if x)
    w, reach, dev = quality_rules.PRIOR_ROWS, quality_rules.REACH, quality_rules.DEVIATIONS
    at = lambda fence, n: f"({fence} * {n})::DOUBLE / 10000"
    chance = " ".join(
        f"WHEN '{k}' THEN " + (
            f"{a} BETWEEN {at('f.lo', b)} - {dev / 2} * ({at('f.lo', b)}) / sqrt(greatest({b}, 1)::DOUBLE)"
            f" AND {at('f.hi', b)} + {dev / 2} * ({at('f.hi', b)}) / sqrt(greatest({b}, 1)::DOUBLE)" if x
            else f"{a} <= {at('f.hi', b)} + {dev}::DOUBLE * sqrt({at('f.hi', b)} + 1)"
        )
        for k, (a, b, _, _, x) in quality_rules.RATES.items()
    )
    quarters = "count(*) AS n, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.5) AS q50, quantile_disc(bucket, 0.75) AS q75"
    drawn = lambda own, to: ", ".join(
        f"({own}.n * {own}.q{k} + {w} * {to}.q{k}) // ({own}.n + {w}) AS q{k}" for k in (25, 50, 75)
    )
    return rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base))),
rep AS (
  SELECT doc_id, sum(least(5, i - last))::BIGINT AS n
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5) AS last FROM win WHERE n > 1)
  GROUP BY doc_id),
m AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_uppers,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN rep ON b.doc_id = rep.doc_id),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {rates} FROM m),
long AS (
  SELECT lang, source, measure, {_CUT} AS bucket FROM (
    SELECT lang, source, unnest({names}) AS measure, unnest([{", ".join(names)}]) AS v FROM r WHERE NOT base_failed)),
q1 AS (SELECT lang, source, measure, {quarters} FROM long GROUP BY ALL),
q2 AS (SELECT lang, measure, {quarters} FROM long GROUP BY ALL),
q3 AS (SELECT measure, {quarters} FROM long GROUP BY ALL),
l AS (SELECT q2.lang, q2.measure, {drawn("q2", "q3")} FROM q2 JOIN q3 ON q2.measure = q3.measure),
q AS (SELECT q1.lang, q1.source, q1.measure, {drawn("q1", "l")} FROM q1 JOIN l ON q1.lang IS NOT DISTINCT FROM l.lang AND q1.measure = l.measure),
f AS (
  SELECT lang, source, measure, q75 + {reach} * (q75 - q50) AS hi, CASE WHEN measure IN ({both}) THEN greatest(q25 - {reach} * (q50 - q25), 0) ELSE 0 END AS lo
  FROM q),
bad AS (
  SELECT DISTINCT r.doc_id FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
  WHERE CASE f.measure {values} END NOT BETWEEN f.lo AND f.hi AND NOT CASE f.measure {chance} END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM r"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _warc_sql() -> str:
    nibble = "(strpos('0123456789abcdef', substr(d, {k}, 1)) - 1)"
    digits = []
    for i in range(32):
        k, off = divmod(5 * i, 4)
        pair = f"({nibble.format(k=k + 1)} * 16 + {nibble.format(k=k + 2) if k + 2 <= 40 else '0'})"
        digits.append(f"substr('{_BASE32}', (({pair} >> {3 - off}) & 31) + 1, 1)")
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {' || '.join(digits)} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""


_FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS x,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
  FROM documents),
h AS (
  SELECT doc_id, text, lines, len(lines)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
         ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4
  FROM d),
f AS (
  SELECT doc_id, text, n, lines, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, text, n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS mate, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE mate
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT mate AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""


ORACLES = {
    "op1_quality_rules": _quality_sql(), "op6_warc_archives": _warc_sql(), "op11_fill_in_middle": _FIM_SQL,
    "op13_hard_negatives": _NEGATIVES_SQL,
}
