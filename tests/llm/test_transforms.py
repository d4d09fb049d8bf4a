"""Fill-in-middle, grammar-compressed shards and hard negatives against brute force; hostile input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import fill_in_middle as fim
from loomspan.llm import hard_negatives as hn
from loomspan.llm import packing, repair
from loomspan.llm.common import shared_path

DOC = "doc_id long, text string, lang string"
LONG = "lorem ipsum dolor\nsit amet " * 6000
HOSTILE = [
    (1, None, None), (None, "no id\nbut lines", "en"), (2, "", "en"), (3, "\n\n\n", "en"), (4, LONG, "de"),
    (5, "has <P> inside\nand more\n", "fr"), (6, "same\ntext", "en"), (6, "same\ntext", "en"), (6, "other\ntext", "en"),
    (-7, "é你\n\U0001f600x\r\ny", "en"), (8, "<|endoftext|>\n<S", "en"), (9, "<P\n<S\n<M\n>", "en"),
]


@pytest.fixture(scope="module")
def hostile(spark):
    clash = ("id", "hex", "h0", "output", "form", "n", "place", "hash", "start", "part", "block", "path", "vec", "label")
    return spark.createDataFrame(HOSTILE, DOC).withColumns({k: F.lit("clash") for k in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 11 fill in the middle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}


def fim_by_hand(ident, text, seed=7, rate=100, spm=50, unit="line", marks=fim.MARKS):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(UNITS[unit], text)
    assert "".join(lines) == text
    n = len(lines)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", s + suf + p + pre + m + mid, len(pre), len(mid)
    return n, "psm", p + pre + s + suf + m + mid, len(pre), len(mid)


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("rate,spm,marks", [(100, 50, fim.MARKS), (60, 20, ("<pre>", "<suf>", "ω"))])
def test_fim_against_brute_force(spark, unit, rate, spm, marks):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "é", "\n", " ", "<P", ">", "\t", "你", "b\n", "<S>"]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    made = fim.fill_in_middle(df, rate=rate, spm=spm, unit=unit, marks=marks)
    got = made.withColumn("back", fim.restored("output", "form", marks)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == fim_by_hand(
            r.id, texts[r.id], rate=rate, spm=spm, unit=unit, marks=marks
        )
        assert r.back == texts[r.id]
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_edges(hostile, empty):
    got = fim.fill_in_middle(hostile).withColumn("back", fim.restored("output", "form")).collect()
    want = sorted(map(repr, (fim_by_hand(i, t) + (t or "",) for i, t, _ in HOSTILE)))
    assert sorted(repr((r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.back)) for r in got) == want
    assert fim.fill_in_middle(empty).count() == 0


def test_fim_bounds(spark):
    for marks in (("", "a", "b"), ("ab", "bc", "x"), ("a", "aa", "b"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.check_marks(marks)
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame([], DOC), unit="page")
    broken = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="marks of its form"):
        broken.select(fim.restored("output", "form")).collect()


# --- 12 grammar-compressed shards


def samples(rnd):
    yield np.zeros(0, np.uint32)
    yield np.array([7], np.uint32)
    yield np.zeros(1001, np.uint32)  # one run: aaaa
    yield np.array([1, 2] * 500 + [2, 1] * 300, np.uint32)
    yield rnd.integers(0, 50257, 5000).astype(np.uint32)
    for size in (3, 20, 300):
        yield rnd.integers(0, size, 20_000).astype(np.uint32)
    phrase = rnd.integers(0, 50257, 400)
    yield np.concatenate([phrase[a : a + 60] for a in rnd.integers(0, 340, 300)]).astype(np.uint32)
    yield np.array([0xFFFFFFF0, 0, 1] * 100, np.uint32)


def plain_expansion(first, rules, symbol):
    todo, out = [symbol], []
    while todo:
        s = todo.pop()
        if s < first:
            out.append(s)
        else:
            todo += [int(rules[s - first][1]), int(rules[s - first][0])]
    return out


def test_grammar_round_trip():
    rnd = np.random.default_rng(2)
    for ids in samples(rnd):
        first, rules, symbols = repair.compress(ids, pairs=64)
        assert [x for s in symbols.tolist() for x in plain_expansion(first, rules, s)] == ids.tolist()
        for k, (a, b) in enumerate(rules.tolist()):
            assert max(a, b) < first + k  # rules look back only
        sizes = repair.expansion_lengths(first, rules)
        assert sizes.tolist() == [len(plain_expansion(first, rules, first + k)) for k in range(len(rules))]
        assert repair.Grammar(first, rules, sizes).expand(symbols).tolist() == ids.tolist()


def test_grammar_leaves_no_frequent_pair():
    rnd = np.random.default_rng(4)
    ids = rnd.choice(40, 30_000, p=np.arange(1, 41) / 820).astype(np.uint32)
    first, rules, symbols = repair.compress(ids)
    assert len(symbols) + 2 * len(rules) < 0.8 * len(ids)
    uses = np.bincount(np.concatenate([symbols, rules.ravel()]), minlength=first + len(rules))[first:]
    assert (uses >= 1).all()


def test_block_random_access():
    rnd = np.random.default_rng(5)
    for ids in list(samples(rnd))[1:]:
        block = repair.Block(repair.block_bytes(ids, [3, None], [len(ids) - 1, 1], 0)[0])
        assert block.names == [3, None] and block.tokens == len(ids)
        for _ in range(40):
            a, b = sorted(rnd.integers(0, len(ids) + 1, 2))
            assert block.ids(a, b).tolist() == ids[a:b].tolist()
    raw = repair.block_bytes(np.arange(100, dtype=np.uint32), [1], [100], 0)[0]
    for bad in (raw[:-1], raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], b"x" + raw[1:], b""):
        with pytest.raises(repair.RepairError):
            repair.Block(bad)


def shards_by_hand(rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for ident, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((ident, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("block", [repair.BLOCK, 700])
def test_shards_against_tokenizers(spark, block):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["alpha ", "beta ", "gamma\n", "你好", "x", " 12345", "<|endoftext|>"])
    rows = [(i * 3 - 50, "".join(word() for _ in range(rnd.choice([0, 1, 30, 2500])))) for i in range(120)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    path = shared_path(spark, "t")
    manifest = repair.write_shards(df, path, block=block)
    got = sorted(repair.read_documents(spark, path, manifest).collect())
    want = shards_by_hand(rows)
    assert [tuple(r[:4]) for r in got] == [w[:4] for w in want]
    blocks = manifest.orderBy("part", "block").collect()
    assert all(0 < r.tokens <= block for r in blocks) and sum(r.docs for r in blocks) == len(rows)
    # random access: stretches of one file are those of the whole, across documents and blocks
    first = [r for r in blocks if r.part == blocks[0].part]
    total = sum(r.tokens for r in first)
    line = [x for w in want for x in w[4]][:total]
    with open(f"{path.removeprefix('file://')}/{first[0].path}", "rb") as f:
        for _ in range(25):
            a, b = sorted((rnd.randrange(total + 1), rnd.randrange(total + 1)))
            assert repair.ids_between(f, a, b).tolist() == line[a:b]


def test_shards_edges(spark, hostile, empty):
    got = repair.round_trip(hostile, block=1000).collect()
    want = shards_by_hand([(i, t) for i, t, _ in HOSTILE])
    assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), n, c) for i, _, n, c, _ in want)
    # ascending ids, null first, no gap
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *[r.n_tokens for r in by_start]])[:-1].tolist()
    ids = [r.id for r in by_start]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert repair.round_trip(empty).count() == 0


def test_damaged_shard(spark):
    path = shared_path(spark, "t")
    df = spark.createDataFrame([(1, "some words here " * 50)], "doc_id long, text string")
    manifest = repair.write_shards(df, path)
    name = f"{path.removeprefix('file://')}/{manifest.first().path}"
    raw = bytearray(open(name, "rb").read())
    raw[-3] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        repair.read_documents(spark, path, manifest).collect()


def test_shards_split_one_id(spark):
    """A third of all rows under one id: they are dealt to several tasks."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS doc_id", "'same text' AS text")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are one task's
    spark.conf.set(key, False)
    try:
        manifest = repair.write_shards(df, shared_path(spark, "t")).collect()
    finally:
        spark.conf.unset(key)
    assert max(r.docs for r in manifest) < 1500 and sum(r.docs for r in manifest) == 3000


# --- 13 hard negatives

VEC = "vec_id long, label int, embedding array<double>"


def negatives_by_hand(rows, positives=5, negatives=5, low=80, high=100):
    good = [
        (i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if i % 100 == 0}:
        mates = sorted((-dot(v, w), j) for j, z, w in good if z == y and j != i)[:positives]
        others = sorted((-dot(v, w), j) for j, z, w in good if z != y)
        for s, j in mates:
            near = [(t, k) for t, k in others if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hn.hard_negatives(df, **options).collect()))


def random_rows(n, dim, seed, span=3, labels=3):
    rnd = random.Random(seed)
    return [(i, rnd.randrange(labels), [rnd.randrange(-1, span) / 8 + 0.25 for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 600, "block_rows": 2}, {"positives": 2, "negatives": 9, "low": 95, "high": 99}])
def test_negatives_against_brute_force(spark, options):
    rows = random_rows(700, 6, 1)  # small whole numbers: many ties
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), VEC).repartition(5)
    by_hand = {k: v for k, v in options.items() if k in ("positives", "negatives", "low", "high")}
    want = negatives_by_hand(rows, **by_hand)
    assert want and mined(df, **options) == want


def test_negatives_edges(spark):
    rows = random_rows(200, 4, 3) + [
        (1000, None, [1.0] * 4), (1100, 1, None), (1200, 1, [1.0, None, 1.0, 1.0]), (1300, 1, [1.0, float("nan"), 1.0, 1.0]),
        (1400, 0, [float("inf")] * 4), (None, 1, [9.0] * 4), (1500, 1, []), (1600, 2, [0.5, 0.5]), (1700, 99, [1.0] * 4),
        (0, 1, [0.5] * 4), (0, 1, [0.5] * 4), (-100, 2, [0.25] * 4), (7, 0, [0.5] * 4), (7, 0, [0.5] * 4),
    ]
    clash = {k: F.lit("clash") for k in ("id", "vec", "anchor", "block", "row", "key", "score", "place", "n")}
    df = spark.createDataFrame(rows, VEC).withColumns(clash)
    assert mined(df) == negatives_by_hand(rows)
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id % 100 <> 0")) == []


@pytest.mark.parametrize("size", [2.0**20, 2.0**21, 2.0**60])
def test_negatives_of_large_components(spark, size):
    """Products beyond 2^53 are exact; beyond 2^63 they are the nearest long."""
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(2), [size * rnd.random() for _ in range(3)]) for i in range(60)]
    got = mined(spark.createDataFrame(rows, VEC))
    most = (1 << 63) - 1
    assert got
    if size < 2.0**40:
        assert got == negatives_by_hand(rows)
    else:
        assert all(r[4] == most and r[5] == most for r in got)


def test_window_bounds():
    for p in (0, 1, 4, 5, 99, 100, 12345, -1, -7, -100, (1 << 62) + 1):
        for percent in (80, 100, 95):
            assert int(hn.lower(np.int64(p), percent)) == -(-percent * p // 100)
            assert int(hn.upper(np.int64(p), percent)) == percent * p // 100


def test_negatives_of_floats(spark):
    rows = random_rows(300, 5, 9)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert mined(df) == negatives_by_hand(rows)
