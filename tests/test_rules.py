"""Pinned behaviour of the rules: edges, ties, hostile input, all-or-nothing writes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import formats, ids, text as X
from loomspan.operators import arcs as A, audit, conversations as C, external as E, metrics as M, prompts as P, records as R, retrieval, splitting as S
from loomspan.sinks import publish
from loomspan.sources import jsonl, stages


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("scale", [1, 5, 100])
def test_scores_in_range(spark, scale):
    ok = json.dumps({"a": 1, "b": scale, "c": (1 + scale) / 2})
    bad = [json.dumps({"a": v, "b": 1, "c": 1}) for v in (0, -1, scale + 1, True, False, "50", None)] + [
        '{"a": 1, "b": 1}', '{"a": 1e400, "b": 1, "c": 1}', "[]", "5", "null", "{bad",
        f'{{"a": {10**1000}, "b": 1, "c": 1}}',
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([ok, *bad])], "i int, raw string")
    got = {r.i: r.average for r in R.validated_scores(df, "raw", ["a", "b", "c"], scale).collect()}
    assert got.pop(0) == pytest.approx((1 + scale + (1 + scale) / 2) / 3)
    assert set(got.values()) == {None}


def test_scale_must_be_positive(spark):
    with pytest.raises(ValueError):
        R.validated_scores(spark.createDataFrame([("{}",)], "raw string"), "raw", ["a"], 0)


def test_nan_is_no_score(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (50.0,)], "v double")
    assert [r.ok for r in df.select(R.valid_score("v", 100).alias("ok")).collect()] == [False, False, False, True]


def test_tolerant_lines(spark, tmp_path):
    p = tmp_path / "with space" / "arc__m.jsonl"
    p.parent.mkdir()
    p.write_bytes(
        b'{"a": 1}\n\n{bad\nnull\n[]\n5\r\n{"a": 2, "s": "x\xe2\x80\xa8y"}\n{"a": 3, "cut": "\xe2\x80\n{"a": 4'
    )
    got = jsonl.tolerant(spark, str(p), "a int, s string").orderBy("line_no").collect()
    assert [r.rec.a for r in got] == [1, 2] and [r.line_no for r in got] == [1, 7]
    assert "with space" in got[0].path
    assert jsonl.tolerant(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_strict_lines_of_a_file_in_many_blocks(spark, tmp_path):
    """Blank lines count, blocks are read by several tasks, and the first bad line is the one that is named."""
    p = tmp_path / "long.jsonl"
    lines = [f'{{"a": {k}}}' if k % 3 else "" for k in range(3000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        p.write_text("\n".join(lines))
        got = jsonl.strict(spark, str(p), "a int")
        assert got.rdd.getNumPartitions() > 3 and [
            r.rec.a for r in got.orderBy("place").collect()
        ] == [k for k in range(3000) if k % 3]
        p.write_text("\n".join([*lines[:2000], "oops", *lines[2000:], "[2]"]))
        with pytest.raises(ValueError, match=r"long\.jsonl:2001"):
            jsonl.strict(spark, str(p), "a int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_lines_name_the_place(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match=r"x\.jsonl:2"):
        jsonl.strict(spark, str(p), "a int").collect()
    with pytest.raises(FileNotFoundError):
        jsonl.strict(spark, str(tmp_path / "no.jsonl"), "a int")


def test_documents_and_chapters(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "all_a.json").write_text('{"k": 2}')
    assert [r.k for r in jsonl.documents(spark, str(tmp_path), "k int").collect()] == [1]
    d = tmp_path / "chapters"
    d.mkdir()
    (d / "chapter_07.txt").write_text("seven")
    (d / "notes.txt").write_text("no")
    assert [(r.chapter, r.text) for r in jsonl.chapter_files(spark, str(d)).collect()] == [(7, "seven")]


def test_staged_publish_keeps_the_old_output(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    publish.staged(spark.createDataFrame([(1, True)], "i int, ok boolean"), path, "NOT ok")
    with pytest.raises(publish.PublishError):
        publish.staged(spark.createDataFrame([(2, True), (3, False)], "i int, ok boolean"), path, "NOT ok")
    assert [r.i for r in spark.read.parquet(path).collect()] == [1]
    assert sorted(r.i for r in spark.read.parquet(f"{path}.partial").collect()) == [2, 3]
    publish.staged(spark.createDataFrame([(4, True)], "i int, ok boolean"), path, "NOT ok")
    assert [r.i for r in spark.read.parquet(path).collect()] == [4]
    with pytest.raises(Exception, match="already exists"):
        publish.write_once(spark.range(1), path)


def test_finished_ignores_errors_and_previews(spark):
    df = spark.createDataFrame(
        [
            ("a", "r", None, None), ("b", "r", "e", None), ("c", X.DRY_RUN_RESPONSE, None, None),
            ("d", "r", None, True), ("e", None, None, None),
        ],
        "trial_id string, response string, error string, dry_run boolean",
    )
    assert [r.trial_id for r in R.finished(df).collect()] == ["a"]


def test_think_and_sentinel(spark):
    assert one(
        spark, X.strip_think(F.lit(" <Think>Hidden\n</THINK>\nVisible <think>x</think>"))
    ) == "Visible <think>x</think>"
    assert one(spark, X.or_sentinel(F.lit("<think>a</think>　 \n"))) == X.EMPTY_RESPONSE
    assert one(spark, X.or_sentinel(F.lit(None).cast("string"))) == X.EMPTY_RESPONSE


@pytest.mark.parametrize("word", ["THE", "THIS", "the", "this"])
def test_book_wrapper(spark, word):
    t = f"junk\n*** START OF {word} PROJECT GUTENBERG EBOOK A B ***\nbody\n*** END OF {word} PROJECT GUTENBERG EBOOK A B ***\nmore"
    assert one(spark, X.strip_wrapper(F.lit(t))) == "body"
    assert one(spark, X.strip_wrapper(F.lit("plain "))) == "plain"


def test_download_validation(spark):
    good = "Title\n[EBook #1399]\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + "a" * 1000 + "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***"
    cases = {
        good: True, good.replace("1399", "7"): False, good.replace("*** END", "END"): False,
        good.replace("a" * 1000, "a" * 10): False, "<html></html>": False,
    }
    for t, want in cases.items():
        assert one(spark, X.valid_download(F.lit(t), F.lit(1399))) is want


def test_chapters():
    long = "x" * 400
    text = "front\nChapter 1: A\n" + long + "\nChapter 2\nshort\nChapter 3\n" + long + "\n\n" + long
    assert S.chapters(text) == [long, long + "\n\n" + long]
    assert S.chapters(text, most=500) == [long, long, long]
    assert S.chapters("no headings here") == ["no headings here"]
    assert S.chapters("") == []
    assert S.chapters(
        "　　CHAPTER ONE - A\n" + long + "\n　CHAPTER TWO\n" + long + "\n- CHAPTER THREE -\n" + long
    ) == [long] * 3
    assert S.paragraphs("ab\n\ncd", 4) == ["ab", "cd"] and S.paragraphs("abcdef", 4) == ["abcd", "ef"]


def test_volumes(spark):
    v = [("b", 2, "Chapter 1\nx\nChapter 2\ny\nChapter 3\nz"), ("b", 1, "Chapter 1\nx\nChapter 2\ny\nChapter 3\nz")]
    df = spark.createDataFrame(v, "novel string, volume int, text string")
    merged = S.merge_volumes(df, renumbered=True).first().text
    assert [line for line in merged.split("\n") if line.startswith("Chapter")] == [f"Chapter {i}" for i in range(1, 7)]
    assert S.merge_volumes(df).first().text.count("\n\n\n") == 1


def test_windows(spark):
    for n in (1, 1799, 1800, 1801, 3300, 3301, 5000):
        got = one(spark, X.chunk_windows(F.lit("a" * n)))
        starts = [w.start for w in got]
        assert starts == list(range(0, starts[-1] + 1, 1500)) and starts[-1] + len(got[-1].chunk) == n
        assert all(len(w.chunk) == 1800 for w in got[:-1])
    assert one(spark, X.chunk_windows(F.lit(""))) is None


def test_experts(spark):
    for t, want in {
        "Chapter: 3\nso Chapter 5": 5, "Chapter: 3\nend": 3, "Chapter: unknown": None, "": None,
        "Chapter: 99999999999": None,
    }.items():
        assert one(spark, X.parse_chapter(F.lit(t))) == want
    for t, want in {
        "Presence: Absent": "absent", "he is present": "present", "present or absent": None, "": None
    }.items():
        assert one(spark, X.parse_presence(F.lit(t))) == want


def test_time_travel(spark):
    ax = spark.createDataFrame(
        [(1, [(1, "a"), (5, "b"), (None, "c")], "end", "up", "sum")],
        "axis_id int, trajectory array<struct<lo:int,label:string>>, pole_end string, arc_direction string, evidence_summary string",
    )
    seen = A.curate(ax.withColumn("q", F.lit(4)), "q").first()
    assert [p.label for p in seen.trajectory] == ["a"] and seen.pole_end is None and seen.arc_direction is None
    assert "evidence_summary" not in seen.asDict()


def test_stages(spark):
    have = spark.createDataFrame(
        [
            ("a", "stamped", True), ("a", "validated", True), ("b", "final_auto", True), ("b", "stamped", False),
            ("c", "other", True),
        ],
        "k string, stage string, exists boolean",
    )
    assert {r.k: r.stage for r in stages.axes_stage(have, ["k"]).collect()} == {"a": "validated", "b": "final_auto"}
    assert [r.k for r in stages.axes_stage(have, ["k"], explicit="final_auto").collect()] == ["b"]


def test_partial_votes_count_in_numbered_files_only(spark):
    df = spark.createDataFrame(
        [("partial", "x_annotations_0511.json"), ("partial", "x_annotations.json"), ("valid", "x_annotations.json")],
        "v string, f string",
    )
    assert [
        r.v for r in df.select(A.file_validity(F.col("v"), F.col("f")).alias("v")).collect()
    ] == ["valid", "partial", "valid"]


def test_votes_last_file_wins_and_orphans(spark):
    v = spark.createDataFrame(
        [("a1", "x", "valid", 1), ("a1", "x", "invalid", 2), ("a1", "y", "valid", 1), ("zz", "x", "valid", 1)],
        "axis string, annotator string, validity string, file int",
    )
    axes = spark.createDataFrame([("a1",), ("a2",)], "axis string")
    r = A.vote_totals(v, axes, ["axis"], order=[F.col("file").desc()]).collect()
    assert [(x.axis, x.valid_votes, x.n_annotators, x.kept) for x in r] == [("a1", 1, 2, False)]
    assert [x.axis for x in A.orphans(v, axes, ["axis"]).collect()] == ["zz"]


def test_ties_go_to_the_first_mode(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5.0), (1, "b", 2, 5.0), (1, "t", 3, 4.0), (2, "t", 3, 1.0)],
        "k int, mode string, rank int, v double",
    )
    assert {r.k: r.best_mode for r in M.best_mode(df, ["k"], "mode", "rank", "v").collect()} == {1: "a", 2: "t"}
    lifts = {r.k: (r.best_other_mode, r.lift) for r in M.lift_over_best(df, ["k"], "mode", "rank", "v", "t").collect()}
    assert lifts == {1: ("a", -1.0), 2: (None, None)}


def test_three_weightings_differ(spark):
    df = spark.createDataFrame(
        [("m", "n1", "a", 1.0)] * 9 + [("m", "n2", "b", 5.0)], "model string, novel string, character string, v double"
    )
    assert M.pool(df, ["model"], "v").first()["mean"] == pytest.approx(1.4)
    assert M.macro_mean(df, ["model"], ["novel"], "v").first()["mean"] == pytest.approx(3.0)
    none = spark.createDataFrame([], "character string, central boolean")
    r = M.class_means(df, none, ["model"], "character", "v").first()
    assert (r["class"], r.probe_pool, r.unit_mean) == ("supporting", pytest.approx(1.4), pytest.approx(3.0))


def test_buckets_add_up(spark):
    df = spark.createDataFrame(
        [("m", n, float(n)) for n in (1, 2, 3, 4, 5, 9)], "model string, n int, v double"
    ).withColumn("b", M.phase_bucket("n"))
    got = M.grains(df, [["model"], ["model", "b"]], [F.count("*").alias("c")]).collect()
    assert sum(r.c for r in got if r.b) == next(r.c for r in got if r.b is None) == 6
    assert {r.b for r in got if r.b} == {"2", "3", "4", "5+"} and {r.grain for r in got} == {"model", "model b"}


def test_masked_top_k_multiplies_packs_and_keeps_odd_vectors(spark):
    """Packs of vectors meet in Python; nulls, other lengths and infinities get the cosine they had one by one."""
    rnd = random.Random(6)
    rows = [("n", rnd.randrange(4), i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(60)]
    rows += [("n", 0, 100, None), ("n", 0, 101, [1.0, None, 0.0]), ("n", 0, 102, [1.0, 0.0]), ("n", 0, 103, [float("inf"), 0.0, 0.0]), ("n", None, 104, [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "novel string, chapter int, chunk_idx long, vec array<double>")
    asked = spark.createDataFrame(
        [("n", i, i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(4)] + [("n", 8, 3, None), ("n", 9, 3, [1.0, 2.0])],
        "novel string, query_id long, query_chapter int, qvec array<double>",
    )
    got = retrieval.masked_top_k(chunks, asked, 70)
    want = retrieval._ranked(retrieval._one_by_one(chunks, asked), 70)
    told = lambda df: sorted((r.query_id, r["rank"], r.chunk_idx, str(r.sim)[:9]) for r in df.collect())
    assert told(got) == told(want)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_masked_top_k_never_leaks(spark):
    chunks = spark.createDataFrame(
        [("n", c, 0, [1.0, float(c)]) for c in range(1, 10)],
        "novel string, chapter int, chunk_idx int, vec array<float>",
    )
    q = spark.createDataFrame(
        [("n", 1, 3, [1.0, 9.0]), ("n", 2, 0, [1.0, 0.0])],
        "novel string, query_id int, query_chapter int, qvec array<float>",
    )
    got = retrieval.masked_top_k(chunks, q, 6).collect()
    assert [(r.query_id, r.chapter) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 3), (1, 2), (1, 1)]
    zero = spark.createDataFrame(
        [("n", 1, 0, [0.0, 0.0])], "novel string, chapter int, chunk_idx int, vec array<float>"
    )
    assert retrieval.masked_top_k(zero, q, 6).first().sim == 0.0


def test_summary_context(spark):
    pieces = F.array(F.struct(F.lit(2).alias("chapter"), F.lit(" two ").alias("summary")))
    assert one(
        spark, retrieval.summary_context(pieces, F.array(F.lit(3)))
    ) == "[Chapter 2]\ntwo\n\n[note] Missing summaries for chapters: [3]"
    assert one(
        spark,
        retrieval.summary_context(
            F.array().cast("array<struct<chapter:int,summary:string>>"), F.array().cast("array<int>")
        ),
    ) is None


def test_conversation_edges(spark):
    t = "messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame(
        [([("user", "u"), ("assistant", "a"), ("user", "v")],), ([("user", "u")],), ([],), ([("user", None)],)], t
    )
    got = df.select(
        F.size(C.prompt_messages(F.col("messages"))).alias("n"), C.reference(F.col("messages")).alias("r"),
        C.valid_messages(F.col("messages")).alias("ok"),
    ).collect()
    assert [(r.n, r.r, r.ok) for r in got] == [(1, "a", True), (1, None, True), (0, None, True), (1, None, False)]


def test_first_present(spark):
    df = spark.createDataFrame([("　 ", "q", 1), ("p", "q", 2)], "problem string, question string, x int")
    assert [r.v for r in df.select(C.first_present(df, C.PROBLEM).alias("v")).collect()] == ["q", "p"]
    with pytest.raises(KeyError):
        C.first_present(df, C.SOLUTION)


def test_formats(spark):
    df = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert C.sft_text(df, "</s>").first().text == "p\n\nc</s>"
    dpo = C.dpo_rows(spark.createDataFrame([("p", "a", "b")], "prompt string, chosen string, rejected string")).first()
    assert (dpo.prompt, dpo.chosen, dpo.rejected) == ("p\n\n", "a", "b")
    assert one(spark, formats.signed(F.lit(1.25))) == "+1.3" or one(spark, formats.signed(F.lit(1.25))) == "+1.2"
    assert one(spark, formats.one_decimal(F.lit(None).cast("double"))) == "--"
    for names, want in {(): "", ("a",): "a", ("a", "b"): "a and b", ("a", "b", "c"): "a, b, and c"}.items():
        assert one(spark, formats.join_names(F.array(*map(F.lit, names)).cast("array<string>"))) == want


def test_prompts(spark):
    s = one(spark, P.system(F.lit("A"), F.lit("N"), F.lit(3), F.lit("relational"), F.lit("B"), F.lit(" ")))
    assert s == 'You are A, from "N". You are at the point in the story corresponding to chapter 3.\n\nYou are interacting with B.'
    assert one(spark, P.user(F.lit("s"), F.lit("q"), F.lit(" h "))) == "Scenario:\ns\n\nQuestion:\nq\n(HINT: h)"
    assert one(spark, P.user(F.lit("s"), F.lit("q"), F.lit(""))) == "Scenario:\ns\n\nQuestion:\nq"
    assert one(spark, P.lifechoice(F.lit(""), F.lit("m"))) is None


def test_ids(spark):
    assert one(spark, ids.trial_id(F.lit("p"), F.lit(1), F.lit("arc"), F.lit("a/b:c"))) == "p__p1__arc__a_b_c"
    r = one(spark, ids.result_file(F.lit("arc__org__model.jsonl")))
    assert (r.mode, r.model) == ("arc", "org__model")
    assert one(spark, ids.midpoint(F.lit(-3), F.lit(0))) == -2
    known = F.create_map(F.lit("A"), F.lit("a1"))
    assert one(spark, ids.character_slug(F.lit("A"), known)) == "a1" and one(
        spark, ids.character_slug(F.lit("O'B (x)"), known)
    ) == "ob_x"
    eras = [one(spark, ids.era(F.lit("axis"), F.lit(i))) for i in range(7)]
    assert sorted(eras) == sorted(ids.ERAS)


def test_locator_fallbacks(spark):
    c = spark.createDataFrame(
        [("a", [("e1", 3), ("e2", 4)], 9), ("b", [("e1", 3)], 9), ("c", [("e1", 3)], 9), ("d", [], 9)],
        "k string, candidates array<struct<event_id:string,chapter:int>>, midpoint int",
    )
    a = spark.createDataFrame(
        [("a", "e2", None), ("b", None, "boom"), ("c", None, None)], "k string, event_id string, error string"
    )
    got = {r.k: (r.event_id, r.chapter, r.rejected) for r in E.locate(c, a, "k").collect()}
    assert got == {"a": ("e2", 4, False), "b": ("e1", 3, False), "c": (None, None, True), "d": (None, 9, False)}


def test_latex():
    rows = [
        {"model": "m", "mode": "a", "v": 1.0}, {"model": "m", "mode": "b", "v": 2.0},
        {"model": "n", "mode": "a", "v": None},
    ]
    t = publish.latex_table(rows, ["v"], ["V"], "model", "mode", marked="b")
    assert r"\multirow{2}{*}{m} & a & 1.0" in t and r"\textbf{2.0}" in t and "& --" in t and r"\rowcolor" in t
    assert "m" in publish.text_table(rows, ["model", "v"])


def test_audit(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "file string, size long, sha256 string")
    f = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("z", 1, "x")], "file string, size long, sha256 string")
    assert {
        (r.file, r.problem) for r in audit.file_differences(d, f).collect()
    } == {("b", "size"), ("c", "missing"), ("z", "unexpected")}
    assert one(spark, audit.revision_ok(F.lit("a" * 40))) and not one(spark, audit.revision_ok(F.lit("main")))


def test_gzip_json(spark, tmp_path):
    publish.gzip_json(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), f"file://{tmp_path}/o", ["k"])
    assert spark.read.json(f"file://{tmp_path}/o").count() == 2
    assert any(f.endswith(".json.gz") for _, _, fs in os.walk(tmp_path) for f in fs)


def test_context_builders(spark):
    t = spark.createDataFrame(
        [("n", "c", 6, 1), ("n", "c", 1, 2)], "novel string, character string, query_chapter int, query_id int"
    )
    s = spark.createDataFrame([("n", 1, "one"), ("n", 5, "five")], "novel string, chapter int, summary string")
    got = {r.query_id: r.context for r in retrieval.build_context("summary", t, summaries=s).collect()}
    assert got == {1: "[Chapter 5]\nfive\n\n[note] Missing summaries for chapters: [2, 3, 4, 6]", 2: "[Chapter 1]\none"}
    ax = spark.createDataFrame(
        [("n", "c", "a1", [(1, "x"), (5, "y")], "end")],
        "novel string, character string, axis_id string, trajectory array<struct<lo:int,label:string>>, pole_end string",
    )
    arc = {r.query_id: json.loads(r.context) for r in retrieval.build_context("arc", t, axes=ax).collect()}
    assert len(arc[1][0]["trajectory"]) == 2 and arc[1][0]["pole_end"] == "end"
    assert len(arc[2][0]["trajectory"]) == 1 and "pole_end" not in arc[2][0]
    ch = spark.createDataFrame(
        [("n", 1, 0, "t1", [1.0, 0.0]), ("n", 9, 0, "t9", [0.0, 1.0])],
        "novel string, chapter int, chunk_idx int, text string, vec array<float>",
    )
    q = t.select(
        "novel", "query_id", "query_chapter", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("qvec")
    )
    assert {r.context for r in retrieval.build_context("rag", t, chunks=ch, queries=q).collect()} == {"[Chapter 1]\nt1"}
    assert retrieval.build_context("vanilla", t).first().context is None
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.build_context("other", t)


def test_views_and_leftovers(spark):
    assert {
        r.slug: r.character
        for r in A.name_by_slug(
            spark.createDataFrame([("A B", "a_b")], "character string, slug string"),
            spark.createDataFrame([("a_b",), ("c_d",)], "slug string"),
        ).collect()
    } == {"a_b": "A B", "c_d": "C D"}
    q = "quality struct<voice:struct<verdict:string>,phase_fit:struct<verdict:string>>"
    p = spark.createDataFrame(
        [
            (
                "p", [(1, "b", None, "t", (("pass",), ("adjacent",))), (0, "a", None, "t", (("fail",), None))],
                ((None,), ("w",), ([("x",)],)),
            )
        ],
        f"probe_id string, phase_responses array<struct<phase_idx:int,gt_action:string,gt_speech:string,gt_thought:string,{q.replace('quality ', 'quality:')}>>, probe_check struct<anchor:struct<note:string>,world:struct<note:string>,discrimination:struct<weak_pairs:array<struct<note:string>>>>",
    )
    v = A.probe_view(p).first()
    assert [
        r.action for r in v.refs
    ] == ["a", "b"] and v.refs[0].fit is None and v.note == "w" and len(v.weak_pairs) == 1
    assert one(spark, ids.records_file(F.lit("gpt"), F.lit(False))) == "eval_records_gpt_nothought.jsonl"
    assert [
        r.m
        for r in spark.createDataFrame([("arc",), ("x",), ("vanilla",)], "m string").orderBy(
            ids.vocabulary_rank(F.col("m"), ("vanilla", "arc"))
        ).collect()
    ] == ["vanilla", "arc", "x"]
    df = spark.createDataFrame(
        [(1, " ", "s", "q"), (2, "g", "s", "q")], "index int, gen_user string, scenario string, question string"
    )
    assert [
        r.p.user
        for r in C.not_yet_rolled_out(df, df.where("index = 9")).select(C.rollout_prompt(df).alias("p")).collect()
    ] == ["s\n\nq", "g"]
    d = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, model string, v double")
    assert {r.k: r.score for r in M.display_score(d, ["k"], "model", "v", "b", "z").collect()} == {1: 2.0, 2: 3.0}
    assert one(spark, A.drop_verdict(F.lit("in_text"), F.lit("pass"), F.lit("fail"))) is False and one(spark, A.drop_verdict(F.lit("in_world"), F.lit("pass"), F.lit("fail"))) is True and one(
        spark, A.drop_verdict(F.lit("in_world"), F.lit("fail"), F.lit(None).cast("string"))
    ) is False
    assert one(spark, F.concat(F.array(F.lit(1)), F.array(F.lit(2)))) == [1, 2] and one(
        spark, F.array_distinct(F.array(F.lit(2), F.lit(1), F.lit(2)))
    ) == [2, 1]


def test_dataset_split(spark, tmp_path):
    for c, v in (("a", 1), ("b", 2)):
        spark.createDataFrame([(v,)], "x int").write.parquet(f"file://{tmp_path}/d/{c}/train-0.parquet")
    got = jsonl.dataset_split(spark, "x int", folder=f"file://{tmp_path}/d", configs=["a", "b"])
    assert sorted(r.x for r in got.collect()) == [1, 2]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "train.jsonl").write_text('{"x": 5}\n')
    assert [r.x for r in jsonl.dataset_split(spark, "x int", folder=f"file://{tmp_path}/e").collect()] == [5]
    with pytest.raises(FileNotFoundError):
        jsonl.dataset_split(spark, "x int", folder=f"file://{tmp_path}/e", split="test")
    with pytest.raises(ValueError):
        jsonl.dataset_split(spark, "x int")


def test_axis_and_event_rules(spark):
    ax = spark.createDataFrame(
        [
            ("a", "final_validated", "none_axis"), ("b", "final_auto", "none_axis"), ("c", "final_auto", None),
            ("d", "final_auto", "valid_axis"),
        ],
        "axis_id string, stage string, validation_tag string",
    )
    assert [r.axis_id for r in A.generation_filter(ax).collect()] == ["a", "c", "d"]
    assert [r.axis_id for r in A.generation_filter(ax, wanted=["b", "d"]).collect()] == ["d"]
    ev = spark.createDataFrame(
        [("n", "c", 1, [("e1", None, None), None]), ("n", "c", 2, [])],
        "novel string, character string, chapter int, events array<struct<event_id:string,description:string,characters_involved:array<string>>>",
    )
    assert [
        (r.event_id, r.description, r.characters_involved) for r in A.flatten_events(ev).collect()
    ] == [("e1", "", [])]
    e = "entries map<string,struct<character:string,annotator_id:string,axis_id:string,validity:string>>"
    f = spark.createDataFrame(
        [
            ("x_annotations_0511.json", {"k1": ("A", "u", None, "partial"), "k2": ("A", None, None, "valid")}),
            ("x_annotations_b.json", {"k1": ("A", "u", "k1", "partial")}), ("x_annotations.json", {}),
        ],
        f"path string, {e}",
    )
    assert [(r.axis_id, r.annotator, r.validity) for r in A.annotation_votes(f).collect()] == [("k1", "u", "partial")]
    assert [r.validity for r in A.annotation_votes(f.where("path LIKE '%0511%'")).collect()] == ["valid"]
    r = "array<struct<phase_idx:int,quality:struct<phase_fit:struct<verdict:string,most_likely_phase_idx:int>>>>"
    p = spark.createDataFrame(
        [([(0, (("adjacent", 1),)), (1, (("off_phase", 0),)), (2, (("off_phase", 0),)), (3, None)],)], f"r {r}"
    )
    got = p.select(A.annotations(F.col("r"), F.lit("in_text"), F.lit(1)).alias("x")).first().x
    assert [g[:3] for g in got] == ["P0:", "P2:"] and "plausible_tail" in got[0] and "non-anchor" in got[1]
    assert one(
        spark, A.verdict_or_fail(F.lit("pass"), F.lit("boom"))
    ) == "fail" and one(spark, A.verdict_or_fail(F.lit("pass"), F.lit(None))) == "pass"


def test_large_files_keep_their_order(spark, tmp_path):
    p = tmp_path / "big__m.jsonl"
    p.write_text("".join(f'{{"k": {i % 50}, "v": {i}}}\n' for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        rows = jsonl.tolerant(spark, str(p), "k int, v int", numbered=False)
        assert rows.rdd.getNumPartitions() > 4
        last = R.latest(rows.select("rec.k", "rec.v", "place"), ["k"], [F.col("place").desc()])
        assert {r.k: r.v for r in last.collect()} == {k: 19950 + k for k in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_top_k_in_blocks(spark, monkeypatch):
    """Many queries meet the chunks in blocks, with the same result."""
    import random

    from loomspan.operators import retrieval

    rnd = random.Random(3)
    vec = lambda: [rnd.random() - 0.5 for _ in range(4)]
    chunks = spark.createDataFrame(
        [("n", k % 9, k, vec()) for k in range(60)], "novel string, chapter int, chunk_idx int, vec array<double>"
    )
    asked = spark.createDataFrame(
        [("n", q, q % 9, vec()) for q in range(25)], "novel string, query_id int, query_chapter int, qvec array<double>"
    )
    rows = lambda: sorted((r.query_id, r["rank"], r.chunk_idx) for r in retrieval.masked_top_k(chunks, asked).collect())
    one = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert rows() == one and one


def test_shared_folder_is_needed_off_local_mode():
    from loomspan.sinks import paths

    class Spark:
        class sparkContext:
            master, applicationId = "spark://host:7077", "a"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        paths.scratch(Spark, "x")
