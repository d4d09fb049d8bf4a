"""The vector index against a full scan; blocks are passed over."""

import numpy as np
import pytest

from loomspan.operators import vector_index as V

CHUNK = "novel string, chapter int, chunk_idx long, vec array<double>"
ASKED = "novel string, query_id long, query_chapter int, qvec array<double>"


def clustered(seed, novels=2, clusters=12, each=40, dim=8):
    rnd = np.random.default_rng(seed)
    rows, i = [], 0
    for n in range(novels):
        for c in rnd.normal(size=(clusters, dim)):
            for v in c + rnd.normal(size=(each, dim)) * 0.03:
                rows.append((f"n{n}", int(rnd.integers(1, 30)), i, (v * rnd.uniform(0.5, 4)).tolist()))
                i += 1
    return rows


def full_scan(chunks, asked, k):
    out = []
    for novel, q, chapter, vec in asked:
        if vec is None or chapter is None:
            continue
        a = np.array(vec)
        found = []
        for n, ch, i, v in chunks:
            if n == novel and v is not None and ch is not None and ch <= chapter:
                b = np.array(v)
                sim = (a * b).sum() / ((np.sqrt((a * a).sum()) + 1e-12) * (np.sqrt((b * b).sum()) + 1e-12))
                found.append((-round(float(sim), 9), ch, i))
        out += [(novel, q, rank, i) for rank, (_, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, tmp_path, chunks, asked, k=6, **options):
    index = V.build(spark.createDataFrame(chunks, CHUNK).repartition(3), f"file://{tmp_path}/i", **options)
    hits, looked = V.search(index, spark.createDataFrame(asked, ASKED), f"file://{tmp_path}/w", k)
    return sorted((r.novel, r.query_id, r["rank"], r.chunk_idx) for r in hits.collect()), index, looked


@pytest.mark.parametrize("seed,k,options", [(1, 6, {}), (2, 1, {"block": 16}), (3, 30, {"block": 24, "most": 6, "rings": 2})])
def test_index_equals_full_scan(spark, tmp_path, seed, k, options):
    chunks = clustered(seed)
    rnd = np.random.default_rng(seed + 10)
    asked = [("n0", q, int(rnd.integers(0, 31)), rnd.normal(size=8).tolist()) for q in range(15)]
    asked += [(c[0], 100 + q, 25, c[3]) for q, c in enumerate(chunks[:200:20])] + [("none", 900, 5, [1.0] * 8)]
    got, _, _ = found(spark, tmp_path, chunks, asked, k, **options)
    assert got == full_scan(chunks, asked, k)


def test_blocks_are_passed_over(spark, tmp_path):
    chunks = clustered(4, novels=1, clusters=30, each=50)
    asked = [(c[0], q, 29, c[3]) for q, c in enumerate(chunks[::100])]
    got, index, looked = found(spark, tmp_path, chunks, asked, 5, block=32)
    assert got == full_scan(chunks, asked, 5)
    blocks = index.count()
    assert blocks > 40 and looked.count() < 0.35 * blocks * len(asked)
    # chapters too: a query at the beginning bounds only blocks that it may see
    early = [("n0", 1, 1, chunks[0][3])]
    hits, some = V.search(index, spark.createDataFrame(early, ASKED), f"file://{tmp_path}/w2", 5)
    assert sorted(r.chunk_idx for r in hits.collect()) == sorted(x[3] for x in full_scan(chunks, early, 5))
    least = {r.block for r in index.where("least_chapter <= 1").select("block").collect()}
    assert {r.block for r in some.collect()} <= least


def test_index_edges(spark, tmp_path):
    """Zero and tiny vectors, copies, nulls, masked-out queries, fewer chunks than asked for."""
    base = clustered(5, novels=1, clusters=3, each=20)
    same = [("n0", 3, 5000 + i, [1.0] + [0.0] * 7) for i in range(90)]  # one vector, many times
    odd = [
        ("n0", 2, 9000, [0.0] * 8), ("n0", 2, 9001, [1e-9] * 8), ("n0", 2, 9002, [-1e-5] + [0.0] * 7),
        ("n0", None, 9003, [1.0] * 8), ("n0", 1, 9004, None), ("lone", 4, 9005, [0.0] * 8), ("lone", 5, 9006, [1.0] * 8),
    ]
    asked = [
        ("n0", 1, 30, [1.0] + [0.0] * 7), ("n0", 2, 30, [0.0] * 8), ("n0", 3, 30, [-1.0] + [0.0] * 7),
        ("n0", 4, 0, [1.0] * 8), ("n0", 5, 30, None), ("n0", 6, None, [1.0] * 8), ("lone", 7, 4, [1.0] * 8),
        ("lone", 8, 9, [1.0] * 8), ("n0", 9, 30, [1e-7] * 8),
    ]
    chunks = base + same + odd
    got, index, _ = found(spark, tmp_path, chunks, asked, 6, block=16)
    assert got == full_scan(chunks, asked, 6)
    assert index.selectExpr("max(n) AS n").first().n < 64  # copies are dealt out


def test_empty_index_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], CHUNK)
    index = V.build(none, f"file://{tmp_path}/i")
    hits, looked = V.search(index, spark.createDataFrame([("n", 1, 1, [1.0])], ASKED), f"file://{tmp_path}/w")
    assert hits.count() == 0 and looked.count() == 0
    index = V.build(spark.createDataFrame([("n", 1, 1, [1.0])], CHUNK), f"file://{tmp_path}/i2")
    hits, _ = V.search(index, spark.createDataFrame([], ASKED), f"file://{tmp_path}/w2")
    assert hits.count() == 0
