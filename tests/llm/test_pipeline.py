"""The pipeline: every stage against what it must and must not do."""

import collections
import importlib.util
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)

import corpus_pipeline as P
from loomspan.llm import decontaminate, secret_scan, simhash
from loomspan.llm.queries import forest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_named_functions():
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secrets", "packing"]


def test_toxic_documents_go_clean_ones_stay(spark, docs):
    out = P.drop_toxic(spark, docs, SF)
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    assert out.columns == docs.columns
    left = out.join(lab, "doc_id").groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in left}
    every = {r.toxic: r["count"] for r in docs.join(lab, "doc_id").groupBy("toxic").count().collect()}
    assert n.get(1, 0) <= 0.1 * every[1] and n[0] >= 0.98 * every[0]


def test_one_of_each_group_stays(spark, docs):
    more = docs.union(docs.where("doc_id < 5")).union(
        spark.createDataFrame([(None, "no id", "en", "s", 5)], docs.schema)
    )
    out = simhash.drop_near_duplicates(more)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_rows_of_one_id_are_rows_of_their_own(spark, docs):
    """In every stage a row's own text decides: nothing goes with another row that has its id, or none."""
    clean = [
        r.text
        for r in docs.join(
            spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"
        ).where("quality = 1 AND toxic = 0 AND length(text) > 400").orderBy("doc_id").limit(8).collect()
    ]
    toxic = docs.join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"
    ).where("toxic = 1").orderBy(F.desc("n_chars")).first().text
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    table = lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    a, b = clean[:2]
    assert rows(P.drop_near_copies(spark, table((3, a), (7, a), (7, b)), SF)) == sorted([(3, a), (7, b)], key=str)
    assert rows(
        P.drop_near_copies(spark, table((None, a), (7, a), (None, b)), SF)
    ) == sorted([(7, a), (None, b)], key=str)
    passage = f"{b} {bench}"
    assert rows(
        P.drop_contaminated(spark, table((7, a), (7, passage), (None, passage), (None, b)), SF)
    ) == sorted([(7, a), (None, b)], key=str)
    more = docs.where("length(text) > 0").select(docs.columns)
    out = P.drop_toxic(
        spark, more.union(table((900_001, a), (900_001, toxic), (None, toxic), (None, b))), SF
    ).where("doc_id = 900001 OR doc_id IS NULL")
    assert rows(out) == sorted([(900_001, a), (None, b)], key=str)


def test_no_two_near_copies_stay(spark):
    """Of all pairs with a similarity of 0.8 or more of five-word shingles, one goes; nothing else goes that fingerprints leave."""
    rnd = random.Random(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = [f"w{rnd.randrange(4000)}" for _ in range(200)]
    for k in range(120):  # a dense group, some of it beyond the limit
        w = list(words)
        for _ in range(rnd.randrange(12)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
        rows.append((50_000 + k, " ".join(w)))
    rows += [(60_000 + k, " ".join(words[: 4 + k])) for k in range(10)] + [(70_000, None), (70_001, " ")]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )

    def grams(t):
        w = re.findall(
            "[^ \t-\r]+",
            (t or "").lower() if (t or "").isascii() else "".join(c.lower() if c.isascii() else c for c in t),
        )
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def near(ids):
        sets = {i: grams(dict_of[i]) for i in ids}
        held = collections.defaultdict(list)
        for i, s in sets.items():
            for g in s:
                held[g].append(i)
        met = collections.Counter((a, b) for x in held.values() for a, b in itertools.combinations(sorted(x), 2))
        return {p for p, n in met.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}

    dict_of = dict(rows)
    before = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    after = {r.doc_id for r in dict(P.STAGES)["simhash_dedup"](spark, docs, SF).collect()}
    pairs = near(before)
    assert pairs and not near(after)
    assert before - after <= {b for _, b in pairs} and after <= before


def test_contaminated_documents_go(spark, docs):
    out = P.drop_contaminated(spark, docs, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    hit = {r.id for r in decontaminate.contaminated(docs, bench).collect()}
    assert hit and {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == hit
    assert not out.join(bench.select(F.col("text").alias("b")), F.contains(F.col("text"), F.col("b"))).count()


def test_secrets_are_masked_and_all_documents_stay(spark, docs):
    out = P.redact_secrets(spark, docs, SF)
    assert out.count() == docs.count() and dict(out.dtypes) == dict(docs.dtypes)
    assert not [r for r in secret_scan.scan(out, forest()).collect() if r.secret]
    assert out.where(
        F.length("text") != F.col("n_chars")
    ).count() == docs.where(F.length("text") != F.col("n_chars")).count() == 0


def test_run_equals_the_stages(spark, docs):
    kept = docs
    for _, f in P.STAGES[:4]:
        kept = f(spark, kept, SF)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    out = P.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_take_empty_and_null_tables(spark, docs, name, stage):
    """Null and empty texts are one near-duplicate group; otherwise all stay."""
    assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0)], docs.schema
    )
    assert stage(spark, nulls, SF).count() == (1 if name == "simhash_dedup" else 3)


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_columns_of_the_user_stay(spark, docs, name, stage):
    """Columns called like those that the operators work with come back as they were, in any case."""
    own = ("__key", "__id", "__row", "__hash", "__HASH", "__findings", "row", "root", "fp", "h", "key", "stays")
    own = own[:4] + own[5:]
    some = docs.where("doc_id < 60")
    more = some.union(some.where("doc_id < 3")).union(spark.createDataFrame([(None, "no id here", "en", "s", 10)], docs.schema))
    clash = more.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in own})
    out = stage(spark, clash, SF)
    plain = stage(spark, more, SF)
    assert out.columns == clash.columns
    rows = out.collect()
    assert rows and len(rows) == plain.count()
    for r in rows:
        assert all(r[c] == f"{c}{'-' if r.doc_id is None else r.doc_id}" for c in own)


def test_many_frequent_shingles(spark, monkeypatch):
    """More frequent shingles than are counted by partial sums: the same rows go, and no copy stays."""
    from loomspan.llm import near_copies

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(40))  # a passage that all texts hold: 36 frequent shingles
    texts = []
    for _ in range(60):
        own = [word() for _ in range(120)]
        texts.append(" ".join(own) + " " + common)
        texts.append(" ".join(own[:-3] + [word() for _ in range(3)]) + " " + common)  # a near copy
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    gone = {}
    # none, some, all of them are frequent; in the expressions, and by a join
    for hot, frequent, few in ((20_000, 10, 100), (40, 10, 100), (40, 1000, 100), (40, 10, 5), (40, 1000, 5)):
        monkeypatch.setattr(near_copies, "HOT_ROWS", hot)
        monkeypatch.setattr(near_copies, "FREQUENT", frequent)
        monkeypatch.setattr(near_copies, "FEW", few)
        gone[hot, frequent, few] = sorted(r.id for r in near_copies.near_copies(df).collect())
    assert set(map(tuple, gone.values())) == {tuple(range(1, 120, 2))}


def test_exploded_shingles_are_not_broadcast(spark):
    """The optimizer takes the rows of a set for one: neither the keyed sets nor the pairs go to the driver."""
    from pyspark.sql import functions as F

    from loomspan.llm import common, near_copies

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    own = [[word() for _ in range(120)] for _ in range(20)]
    texts = [" ".join(w[:-3] + [word() for _ in range(3)]) for w in own for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = common.materialize(near_copies.shingles(df), "sets")
    rare = common.materialize(near_copies._rare(sets, []), "rare")
    led = rare.select(F.col("id").alias("b"), F.explode("s.lead.id").alias("a")).where("a < b").distinct()
    for pairs in (near_copies._candidates(rare), near_copies._verified(led, sets)):
        assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, i + 1) for i in range(0, 40, 2)]
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    long = common.materialize(spark.range(50).withColumnRenamed("id", "doc_id"), "long")
    far = df.join(common.broadcast_if_small(long, limit=10), "doc_id")
    assert "Broadcast" not in far._jdf.queryExecution().executedPlan().toString()
