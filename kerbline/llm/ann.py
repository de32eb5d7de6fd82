"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is cut into balanced parts, and a
small network learns the parts around a vector's neighbours. It then files every
row under its most probable part; a query visits its most probable parts, whose
rows are compared exactly. How many parts are visited is measured on sampled
queries against brute force over the sample, so that the wanted recall is reached.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import matrix
from kerbline.session import Written

SAMPLE_ROWS = 6_000    # rows the index is fitted on, chosen by a hash of their id
PARTS = 24
RECALL = 0.95          # recall wanted on the sample
CHUNK_ROWS = 16_384    # rows of a part that one task compares, about
BLOCK_ROWS = 512       # queries that one task compares, about
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Router:
    """The fitted network and the number of parts a query visits."""

    layers: list[np.ndarray]
    visits: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        scores = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS,
            recall: float = RECALL, visits: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by Euclidean distance.

    ``vectors`` and ``queries`` are (id long, vec array<double>), ids unique, no
    nulls inside. A query never meets the vector of its own id; ties go to the
    smaller id; vectors of another length than the commonest take no part. Empty
    inputs give an empty result. ``visits`` fixes the number of parts visited.
    """
    spark = vectors.sparkSession
    written = Written(spark, "ann")
    dims = vectors.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    dim, total = dims["dim"], dims["count"]
    vectors, queries = vectors.where(F.size("vec") == dim), queries.where(F.size("vec") == dim)
    share = min(1.0, 1.5 * sample_rows / total)
    bits = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    sample = vectors.where(bits < F.lit(int(share * (1 << 30)) + 1)).withColumn("h", bits).orderBy("h", "id").limit(sample_rows)
    rows = np.array([r.vec for r in sample.collect()])
    router = fit(rows, min(parts, max(1, len(rows) // 20)), k, recall, visits)

    filed = written.keep(vectors.mapInPandas(_file(router, 1), "id long, part int, data binary"))
    sizes = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    sent = written.keep(queries.mapInPandas(_file(router, router.visits), "id long, part int, data binary"))
    wanted = {r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}
    chunks = {p: max(1, math.ceil(n / CHUNK_ROWS)) for p, n in sizes.items()}
    blocks = {p: max(1, math.ceil(n / BLOCK_ROWS)) for p, n in wanted.items()}
    if not sizes or not wanted:
        return spark.createDataFrame([], RESULT)

    def lookup(table: dict[int, int]):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in sorted(table) for x in (p, table[p])]), F.col("part")), F.lit(0))

    n_chunks, n_blocks, h = lookup(chunks), lookup(blocks), F.xxhash64("id")
    left = filed.where(n_blocks > 0).withColumn("chunk", F.pmod(h, n_chunks).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    right = sent.where(n_chunks > 0).withColumn("block", F.pmod(h, n_blocks).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    keys = ["part", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(k, dim), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fit(rows: np.ndarray, parts: int, k: int, recall: float, visits: int | None) -> Router:
    """Neighbour graph, balanced parts, network, number of visits."""
    scale = float(np.sqrt((rows**2).sum(1)).mean()) or 1.0
    x = rows / scale
    near = _neighbours(x, min(k, len(x) - 1))
    labels = _balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), labels), 1)
    for column in near.T:
        np.add.at(target, (np.arange(len(x)), labels[column]), 1)
    target /= target.sum(1, keepdims=True)
    held = np.arange(len(x)) % 10 == 0 if len(x) >= 100 else np.zeros(len(x), bool)
    layers = _train(x[~held], target[~held])
    layers[0] = layers[0] / scale
    router = Router(layers, parts)
    if visits is not None:
        router.visits = min(visits, parts)
    elif held.any():
        likely = router.probabilities(rows)
        home, routes = likely.argmax(1), np.argsort(-likely[held], 1)
        place = np.empty_like(routes)
        np.put_along_axis(place, routes, np.arange(parts)[None, :], 1)
        needed = place[np.arange(held.sum())[:, None], home[near[held]]]  # visits that reach each true neighbour
        hits = [(needed < n).mean() for n in range(1, parts + 1)]
        router.visits = next((n for n, share in enumerate(hits, 1) if share >= recall), parts)
    return router


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    if k <= 0:
        return np.empty((len(x), 0), int)
    norms, out = (x**2).sum(1), []
    for start in range(0, len(x), 500):
        d = norms[None, :] - 2 * x[start:start + 500] @ x.T
        d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, 1)[:, :k])
    return np.concatenate(out)


def _balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Spherical seeds, then moves to the part that holds most neighbours, as far as room there allows."""
    rng = np.random.default_rng(7)
    n, room = len(x), math.ceil(1.15 * len(x) / parts)
    centres = x[rng.choice(n, parts, replace=False)]

    def deal(preference: np.ndarray) -> np.ndarray:
        labels, left = np.full(n, -1), np.full(parts, room)
        ranked = np.argsort(-preference, 1)
        sure = np.sort(preference, 1)
        for i in np.argsort(-(sure[:, -1] - sure[:, -2])) if parts > 1 else range(n):
            for p in ranked[i]:
                if left[p]:
                    labels[i], left[p] = p, left[p] - 1
                    break
        return labels

    for _ in range(6):
        labels = deal(2 * x @ centres.T - (centres**2).sum(1))
        centres = np.stack([x[labels == p].mean(0) if (labels == p).any() else centres[p] for p in range(parts)])
    back = np.concatenate([near, ], 1)
    for _ in range(5):
        votes = np.zeros((n, parts))
        for column in back.T:
            np.add.at(votes, (np.arange(n), labels[column]), 1)
            np.add.at(votes, (column, labels), 1)
        votes += 1e-3 * (x @ centres.T)
        votes[np.arange(n), labels] += 0.5
        labels = deal(votes)
    return labels


def _train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40) -> list[np.ndarray]:
    """One hidden layer, softmax, cross entropy with the neighbours' parts, Adam."""
    rng = np.random.default_rng(11)
    d, m = x.shape[1], target.shape[1]
    layers = [rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, m)), np.zeros(m)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for start in range(0, len(x), 256):
            at = order[start:start + 256]
            a = np.maximum(x[at] @ layers[0] + layers[1], 0)
            s = a @ layers[2] + layers[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[at]) / len(at)
            ga = (g @ layers[2].T) * (a > 0)
            grads = [x[at].T @ ga, ga.sum(0), a.T @ g, g.sum(0)]
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _file(router: Router, visits: int):
    def file(batches):
        for pdf in batches:
            x = np.array(list(pdf["vec"]), float)
            if not len(x):
                continue
            routes = np.argsort(-router.probabilities(x), 1, kind="stable")[:, :visits]
            n = routes.shape[1]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), n), "part": routes.ravel(), "data": np.repeat(np.array([v.tobytes() for v in x], object), n)})
    return file


def _compare(k: int, dim: int):
    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if rows.empty or asked.empty:
            return empty
        rows = rows.sort_values("id")
        x, q = matrix(rows["data"], np.float64, dim), matrix(asked["data"], np.float64, dim)
        ids, own, norms, out = rows["id"].to_numpy(), asked["id"].to_numpy(), (x**2).sum(1), []
        for i, query in enumerate(q):
            squares = norms - 2 * (x @ query) + (query**2).sum()
            squares[ids == own[i]] = np.inf
            n = min(k, int(np.isfinite(squares).sum()))
            if not n:
                continue
            slack = 1e-9 * (norms.max() + (query**2).sum())
            at = np.flatnonzero(squares <= np.partition(squares, n - 1)[n - 1] + slack)
            exact = np.sqrt(((x[at] - query) ** 2).sum(1))
            order = np.lexsort((ids[at], exact))[:n]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at][order], "score": exact[order]}))
        return pd.concat(out) if out else empty
    return compare
