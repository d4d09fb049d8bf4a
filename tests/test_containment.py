"""Names in texts by signature, and ranges by nodes, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import containment as C
from loomspan.operators import retrieval as R


def flat(s):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower())


def by_hand(texts, names):
    return sorted((d, m) for d, t in texts for m, n in names if t is not None and n is not None and flat(n) in flat(t))


def found(spark, texts, names, **options):
    got = C.containment(
        spark.createDataFrame(texts, "d long, t string").repartition(3), spark.createDataFrame(names, "m int, n string"),
        "d", "t", "m", "n", **options,
    ).collect()
    return sorted((r.d, r.m) for r in got)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200, "group_bytes": 900}])
def test_containment_against_brute_force(spark, options):
    rnd = random.Random(7)
    word = lambda: rnd.choice(["ab", "cd", "E", "fgh", "é你", "x", "yz z", "Café", "\U0001f600"])
    phrase = lambda n: rnd.choice([" ", "  ", "\n", "\t "]).join(word() for _ in range(n))
    texts = [(i, phrase(rnd.randrange(0, 60))) for i in range(120)] + [(900, None), (901, ""), (902, "AAAA" * 50)]
    names = [(i, phrase(rnd.randrange(1, 9))) for i in range(150)]
    names += [(500, None), (501, ""), (502, "a"), (503, "é"), (504, "aa"), (505, "aaaaaaaa"), (506, "a" * 199), (507, "cd")]
    names += [(600 + i, texts[i][1][3 : 3 + 7 * i]) for i in range(10)] + [(700, texts[3][1]), (701, texts[3][1] + "x")]
    assert found(spark, texts, names, **options) == by_hand(texts, names)


def test_long_texts_are_scanned_in_chunks(spark, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    names = [(i, text[a : a + n]) for i, (a, n) in enumerate((rnd.randrange(19_000), rnd.randrange(3, 400)) for _ in range(80))]
    block = C.Names(None, [flat(n).encode() for _, n in names])
    data = np.frombuffer(flat(text).encode(), np.uint8)
    starts = np.array([0, 7_000, 7_000, len(data)])
    want = sorted(
        (r, k) for r in range(3) for k, (_, n) in enumerate(names)
        if flat(n).encode() in data[starts[r] : starts[r + 1]].tobytes()
    )
    for chunk in (1 << 20, 1000, 37):
        monkeypatch.setattr(C, "CHUNK", chunk)
        assert block.found(data, starts) == want


def test_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(bytes(random.Random(1).randrange(3) for _ in range(4000)), np.uint8)
    for size in C.SIZES:
        h, seen = C.grams(data, size), {}
        for k, x in enumerate(h.tolist()):
            assert seen.setdefault(x, data[k : k + size].tobytes()) == data[k : k + size].tobytes()
        assert len(seen) == len({data[k : k + size].tobytes() for k in range(len(h))})


def test_containment_edges(spark):
    texts, names = [(1, "some text")], [(1, "me te")]
    assert found(spark, texts, names) == [(1, 1)]
    none = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([], "m int, n string")
    for t, n in ((spark.createDataFrame(texts, "d long, t string"), none[1]), (none[0], spark.createDataFrame(names, "m int, n string"))):
        assert C.containment(t, n, "d", "t", "m", "n").collect() == []


def test_one_scan_whatever_the_number_of_names(spark, tmp_path):
    """Names in many blocks do not multiply the texts in the plan."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "d long, t string")
    texts.write.parquet(f"file://{tmp_path}/t")
    stored = spark.read.parquet(f"file://{tmp_path}/t")
    names = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "m int, n string")
    out = C.containment(stored, names, "d", "t", "m", "n", block_bytes=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan and out.count() == sum(
        f"text {m}" in f"text {d}" for d in range(50) for m in range(2000)
    )


def test_cover_is_exact_and_short(spark):
    rnd = random.Random(5)
    rows = [(a, a + n) for a, n in ((rnd.randrange(-50, 300), rnd.randrange(-2, 200)) for _ in range(200))] + [(0, 0), (5, 5), (0, 5000)]
    got = spark.createDataFrame(rows, "lo int, hi int").withColumn("c", R.cover(F.col("lo"), F.col("hi"), 8)).collect()
    for r in got:
        covered = [x for n in r.c for x in range(n.node << n.level, (n.node + 1) << n.level)]
        assert sorted(covered) == list(range(r.lo, r.hi + 1))
        assert len(r.c) <= 16 + max(0, (r.hi - r.lo) >> 8)


def test_in_range_against_brute_force(spark):
    rnd = random.Random(6)
    events = [(rnd.choice("ab"), rnd.randrange(0, 400) if rnd.random() < 0.95 else None, i) for i in range(1500)]
    phases = [(rnd.choice("abc"), a, a + rnd.choice([0, 1, 7, 60, 500, -1])) for a in range(0, 300, 7)] + [("a", None, 5)]
    out = R.in_range(
        spark.createDataFrame(events, "k string, ch int, e int"), spark.createDataFrame(phases, "k string, lo int, hi int"),
        "k", "ch", "lo", "hi", "e", most=9,
    )
    want = []
    for k, lo, hi in phases:
        if lo is not None and lo <= hi:
            hit = sorted(e for kk, ch, e in events if kk == k and ch is not None and lo <= ch <= hi)[:9]
            want += [(k, lo, hi, e, p) for p, e in enumerate(hit, 1)]
    assert sorted((r.k, r.lo, r.hi, r.e, r.place) for r in out.collect()) == sorted(want)
