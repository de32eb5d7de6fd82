"""Vector codes against plain Lloyd rounds, and the cover trees' own rules."""

import hashlib
import math

import numpy as np
import pytest

from kerbline.llm import vector_codes
from kerbline.llm.vector_codes import ENTRIES, PARTS, compress, nearest_entries, plant
from tests.llm.helpers import seeded


def plain(rows, rounds=2):
    """(vec_id, code, error, label_error) of rows (vec_id, vector, label), and the codebooks' hash."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    edges = [p * dim // PARTS for p in range(PARTS + 1)]
    parts = [[v[edges[p]:edges[p + 1]] for p in range(PARTS)] for _, v, _ in kept]
    books = [[row[p] for row in parts[:ENTRIES]] for p in range(PARTS)]

    def assign():
        found = []
        for row in parts:
            best = [min((sum((a - b) ** 2 for a, b in zip(row[p], e)), k) for k, e in enumerate(books[p])) for p in range(PARTS)]
            found.append(best)
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(PARTS):
            for k in range(len(books[p])):
                own = [row[p] for row, f in zip(parts, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, labels[label]) for (i, _, label), f, e in zip(kept, found, errors)]
    return out, hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def awkward_vectors(rng, dim, n=300):
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]
    hot = [0.25] * dim
    rows += [(1000 + i, hot, 7) for i in range(150)]  # a third of all rows is one vector
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * (dim - 1) + [None], 1), (2003, [float("nan")] + [0.0] * (dim - 1), 1),
             (2004, [float("inf")] * dim, 2), (2005, [0.0] * (dim + 1), 2), (None, hot, 7), (None, [0.5] * dim, None), (5, rows[5][1], 1), (2006, [-0.001] * dim, 3)]
    return rows


@pytest.mark.parametrize("dim", [64, 20, 5])
def test_equal_to_plain_rounds(spark, dim, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK_ROWS", 100)
    rows = awkward_vectors(seeded(dim), dim)
    table = spark.createDataFrame([(*r, "kept") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(4)
    found = compress(table)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = [tuple(r) for r in found.collect()]
    expected, digest = plain(rows)
    assert {r[4] for r in got} == {digest}
    assert sorted((r[:4] for r in got), key=str) == sorted(expected, key=str)


def test_few_rows_none_and_too_large(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(3, [1.0] * 32, None), (1, [1.0] * 32, "x"), (2, [-1.5] * 32, "x")]
    got = [tuple(r)[:4] for r in compress(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted(plain(rows)[0])
    assert compress(spark.createDataFrame([], schema)).collect() == []
    assert compress(spark.createDataFrame([(1, None, "x")], schema)).collect() == []
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e12] * 32, "x")], schema)).collect()


def test_decoded_vectors_have_the_listed_error(spark):
    rows = awkward_vectors(seeded(2), 64)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    from kerbline.session import Written

    chunks, books = vector_codes.trees(table, Written(spark, "test"))
    codebooks = vector_codes.learn(chunks, books, 64)
    vectors = {i: v for i, v, _ in rows if i is not None and i < 300 and i != 5}
    for r in vector_codes.encode(chunks, codebooks).collect():
        if r.vec_id in vectors:
            assert r.error == sum((math.floor(256 * x) - y) ** 2 for x, y in zip(vectors[r.vec_id], codebooks.decode(r.code)))


@pytest.mark.parametrize("width,spread", [(1, 3), (3, 40), (4, 200), (6, 2)])
def test_trees_cover_and_prune(width, spread):
    rng = np.random.default_rng(width)
    points = rng.integers(-spread, spread, (900, width))
    points[300:600] = points[300]
    starts = np.array([0, 500])
    ends = np.array([500, 900])
    forest = plant(points.copy(), starts, ends)
    assert (forest.points == points[forest.places]).all() and sorted(forest.places) == list(range(900))
    for node in range(len(forest.start)):
        own = forest.points[forest.start[node]:forest.end[node]]
        gaps = ((own - own[0]) ** 2).sum(1)
        assert gaps.max() == forest.radius2[node]
        kids = range(forest.child[node], forest.child[node] + forest.children[node])
        if kids:  # children split the node's points, the first keeps its centre, and centres stand apart
            assert [forest.start[k] for k in kids] == [forest.start[node], *(forest.end[k] for k in kids)][:-1] and forest.end[kids[-1]] == forest.end[node]
            centres = forest.points[forest.start[list(kids)]]
            apart = ((centres[:, None] - centres[None]) ** 2).sum(2)[np.triu_indices(len(centres), 1)]
            assert not len(apart) or apart.min() > max(forest.radius2[k] for k in kids)
    books = rng.integers(-spread, spread, (2, 30, width))
    books[:, 7] = books[:, 3]  # ties go to the lower index
    start, end, entry = nearest_entries(forest, books)
    found = np.full(900, -1)
    for s, e, k in zip(start, end, entry):
        assert (found[s:e] == -1).all()
        found[s:e] = k
    tree = np.arange(900) >= 500
    exact = ((forest.points[:, None] - books[tree.astype(int)]) ** 2).sum(2).argmin(1)
    assert (found == exact).all()
