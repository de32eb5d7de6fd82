import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import ann, catalog, topk_search
from kerbline.llm.common import vectors_of

SCHEMA = "vec_id long, embedding array<float>, label int, vec string"


def awkward_vectors(n=240, d=7, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d).astype(np.float32) * (1 + i % 5)], 1, "x") for i in range(n)]
    hot = rows[5][1]
    rows += [(1000 + i, hot, 2, "x") for i in range(60)]  # a large group of equal vectors, so ties everywhere
    rows += [rows[9], rows[9], (None, hot, 1, "x"), (2000, None, 1, "x"), (2001, [float("nan")] + hot[1:], 1, "x"),
             (2002, [None] + hot[1:], 1, "x"), (2003, [float("inf")] * d, 1, "x"), (2100, [0.0] * d, 1, "x"), (2200, [], 1, "x"),
             (2300, [1.0, 2.0], 1, "x"), (2301, [3.0, 4.0], 1, "x")]
    return rows


def usable(rows, zero=True):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = v
    return out


@pytest.mark.parametrize("small", [False, True])
def test_topk_matches_brute_force(spark, monkeypatch, small):
    if small:
        for name, size in (("GROUP_ROWS", 32), ("BLOCK_ROWS", 3), ("STEP_ROWS", 8)):
            monkeypatch.setattr(topk_search, name, size)
    rows = awkward_vectors()
    vectors = vectors_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "true")
    vectors = vectors.select("id", F.transform("vec", lambda x: F.floor(x * 1024)).alias("vec"))
    got = topk_search.exact_top_k(vectors, vectors.where("id % 20 = 0"), 10).collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in usable(rows).items()}
    expected = []
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_topk_without_rows(spark):
    none = spark.createDataFrame([], "id long, vec array<long>")
    assert topk_search.exact_top_k(none, none).collect() == []
    one = spark.createDataFrame([(0, [1, 2])], "id long, vec array<long>")
    assert topk_search.exact_top_k(one, one).collect() == [] == topk_search.exact_top_k(one, none).collect()


@pytest.mark.parametrize("chunk", [16_384, 40])
def test_all_parts_visited_is_exact(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 4)
    rows = awkward_vectors()
    vectors = vectors_of(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "exists(vec, x -> x <> 0)")
    got = ann.nearest(vectors, vectors.where("id % 20 = 0"), 10, parts=6, visits=6).collect()
    known = {i: v for i, v in usable(rows, zero=False).items() if len(v) == 7}
    assert {r.query_id for r in got} == {i for i in known if i % 20 == 0}
    for q in (i for i in known if i % 20 == 0):
        best = sorted((math.dist(known[q], v), i) for i, v in known.items() if i != q)[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [i for _, i in best]
        assert [r.score for r in mine] == pytest.approx([d for d, _ in best], abs=1e-12)


def test_recall(spark):
    found = {(r.query_id, r.vec_id) for r in catalog.op8_ann(spark, "/root/testdata/sf0.1").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = ((x - x[q]) ** 2).sum(1)
        distance[q] = np.inf
        nearest = ids[np.lexsort((ids, distance))[:10]]
        hits += sum((ids[q], i) in found for i in nearest)
        total += len(nearest)
    assert hits >= 0.9 * total


def test_nearest_without_rows(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert ann.nearest(none, none).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, few.where("id = 0")).collect()] == [(0, 1)]
    assert ann.nearest(few, none).collect() == []


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(600, 8))
    labels = ann._balanced_parts(x, ann._neighbours(x, 5), 6)
    assert np.bincount(labels, minlength=6).max() <= math.ceil(1.15 * 100)


def test_scores_that_might_not_fit_a_long_fail(spark):
    big = spark.createDataFrame([(1, [2**33, 0]), (2, [2**33, 1])], "id long, vec array<long>")
    with pytest.raises(OverflowError, match="too long"):
        topk_search.exact_top_k(big, big)
    fits = spark.createDataFrame([(1, [2**30, 0]), (2, [2**30, 1])], "id long, vec array<long>")
    assert {r.score for r in topk_search.exact_top_k(fits, fits).collect()} == {2**60}
