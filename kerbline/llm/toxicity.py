"""Toxicity: a linear classifier on words and word beginnings, regularised by counterfactual identity terms.

In labelled texts every identity term is swapped for the other terms of its group.
A swap must not change the score, so the squared change of the logit is part of
the loss: a term that merely keeps bad company in the training data gets the same
weight as its counterparts, and neutral mentions are not reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import as_bytes, small_batches, texts_in_steps
from kerbline.session import Written

MAX_LABELLED = 16_000  # labelled rows the fit reads at most, chosen by a hash of their id
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)   # bytes of the word beginnings that are features besides the words
LEAST_ROWS = 4         # labelled rows a feature must stand in to get a weight
LEAST_Z = 3.5          # and by how many deviations its share among label 1 must differ from chance
UNKNOWN = 0.25         # score of every text when nothing is labelled
PENALTY = 20.0
RIDGE = 1e-4
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "citizens"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct words and word beginnings of each text.

    Words are runs of letters and digits; ASCII letters count in lower case.
    """
    rows, buckets = [], []
    for first, hashes, counts in texts_in_steps([_PLAIN[np.frombuffer(t, np.uint8)].tobytes() for t in texts], PREFIXES):
        own = np.repeat(np.arange(first, first + len(counts)), counts) * BUCKETS
        keys = np.unique(((hashes % np.uint64(BUCKETS)).astype(np.int64) + own)[hashes != 0])
        rows.append((keys // BUCKETS).astype(np.int32))
        buckets.append((keys % BUCKETS).astype(np.int32))
    empty = np.empty(0, np.int32)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *buckets])


def _term(word: str) -> np.ndarray:
    """The features that a term brings into a text: the word and its beginnings."""
    return _words([word.encode()])[1]


def _whole(word: str) -> int:
    """The bucket of the word alone."""
    (_, hashes, _), = texts_in_steps([word.encode()], PREFIXES)
    return int(hashes[0, 0] % np.uint64(BUCKETS))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        rows, buckets = _words(texts)
        return self.bias + np.bincount(rows, self.weights[buckets], len(texts))


def fit(texts: list[bytes], labels: np.ndarray, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS, penalty: float = PENALTY,
        ridge: float = RIDGE, steps: int = 250) -> Model:
    """Fit on labelled texts. Without rows of both classes the score is the smoothed share of label 1, without rows UNKNOWN."""
    rows, buckets = _words(texts)
    seen = np.bincount(buckets, minlength=BUCKETS)
    keep = kept_features(seen, np.bincount(buckets, labels[rows], BUCKETS), labels, groups)[buckets]
    return _solve(rows[keep].copy(), buckets[keep].copy(), labels, seen, groups, penalty, ridge, steps)


def kept_features(seen: np.ndarray, toxic: np.ndarray, labels: np.ndarray, groups: Sequence[Sequence[str]]) -> np.ndarray:
    """Which buckets get a weight: those that stand in enough rows and not with label 1 by chance, and the identity terms'."""
    by_chance = seen * (labels.mean() if len(labels) else 0.0)
    kept = (seen >= LEAST_ROWS) & (np.abs(toxic - by_chance) >= LEAST_Z * np.sqrt(by_chance + 0.5))
    for group in groups:
        kept[np.concatenate([_term(w) for w in group])] = True
    return kept


def _solve(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, seen: np.ndarray, groups: Sequence[Sequence[str]],
           penalty: float, ridge: float, steps: int) -> Model:
    """The weights of the kept features; (row, bucket) of the kept ones, ``seen`` counts rows of all."""
    n = len(labels)
    base = (labels.sum() + 1) / (n + 2) if n else UNKNOWN
    model = Model(np.zeros(BUCKETS, np.float32), float(np.log(base / (1 - base))))
    if n == 0 or labels.min() == labels.max():
        return model
    terms = [[_term(w) for w in group] for group in groups]
    spoken = [[int(seen[_whole(w)]) for w in group] for group in groups]
    used, at = np.unique(np.concatenate([buckets, *[f for group in terms for f in group]]), return_inverse=True)
    at = at[: len(buckets)]
    # Swaps that occur: a term for each other term of its group, weighted by the share of labelled texts that hold it.
    swaps = [(a, b, k / n / (len(group) - 1)) for group, held in zip(terms, spoken) for a, k in zip(group, held) for b in group if a is not b and k]
    change = np.zeros((len(swaps), len(used)), np.float32)
    for i, (a, b, _) in enumerate(swaps):
        change[i, np.searchsorted(used, a)] += 1
        change[i, np.searchsorted(used, b)] -= 1
    share = np.array([k for _, _, k in swaps])
    w, bias = np.zeros(len(used)), model.bias
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(rows, w[at], n))))
        g = (p - labels) / n
        grad = np.bincount(at, g[rows], len(used)) + ridge * w
        if swaps:  # the change of the logit by each swap must vanish
            grad += (penalty * share * (change @ w)) @ change
        grad = np.append(grad, g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    model.weights[used], model.bias = w, float(bias)
    return model


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
          penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 250) -> Model:
    """Fit on at most ``max_labelled`` rows of ``labels`` (doc_id, label 0/1), taken in the order of a hash of the id.

    Rows without id or label are not read; an id that comes several times counts once, with its largest label and smallest text.
    Texts stay on the executors: the driver gets one count per bucket, and then the numbers of the kept features of each row.
    """
    spark = documents.sparkSession
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").cast("double").alias("label"))

    def featured(batches):
        for pdf in batches:
            found, buckets = _words(as_bytes(pdf["text"]))
            edges = np.searchsorted(found, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "buckets": [buckets[a:b] for a, b in zip(edges, edges[1:])]})

    written = Written(spark, "toxicity")
    table = written.keep(rows.mapInPandas(featured, f"doc_id {dict(rows.dtypes)['doc_id']}, label double, buckets array<int>"))
    counts = table.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).toArrow()
    seen, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    seen[counts["bucket"].to_numpy()], toxic[counts["bucket"].to_numpy()] = counts["n"].to_numpy(), counts["toxic"].to_numpy()
    marks = table.select("doc_id", "label").orderBy("doc_id").toArrow()["label"].to_numpy()
    kept = kept_features(seen, toxic, marks, groups)

    def reduced(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "buckets": [np.asarray(b, np.int32)[kept[np.asarray(b, np.int32)]].tobytes() for b in pdf["buckets"]]})

    found = table.mapInPandas(reduced, f"doc_id {dict(rows.dtypes)['doc_id']}, buckets binary").orderBy("doc_id").toLocalIterator()
    features = [np.frombuffer(bytes(r["buckets"]), np.int32) for r in found]
    written.drop(table)
    at = np.repeat(np.arange(len(features), dtype=np.int32), list(map(len, features)))
    return _solve(at, np.concatenate([np.empty(0, np.int32), *features]), marks, seen, groups, penalty, ridge, steps)


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1; a null text scores as an empty one. Other columns stay as they are."""
    small_batches(documents.sparkSession)
    weights, bias = model.weights.tobytes(), model.bias

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        own = Model(np.frombuffer(weights, np.float32), bias)
        return pd.Series(1 / (1 + np.exp(-own.logits(as_bytes(texts)))))

    return documents.withColumn(column, probability(F.col("text").cast("string")))
