"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior.

The features are the writing of a text: how often each byte occurs, lengths,
repetition. The share of good text among the unlabelled is estimated first: no
set of scores can hold more good text than all of it, so the least ratio of
unlabelled to positive mass over upper score ranges bounds the share. The
classifier then minimises the non-negative unbiased risk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import as_bytes, small_batches, texts_in_steps

MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000  # rows the fit reads at most, chosen by a hash of their id
WIDTH = 256 + 7


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: log rates of its bytes, size, word length, distinct words and lines, words said twice running."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for first, hashes, counts in texts_in_steps(texts):
        edges = np.concatenate([[0], np.cumsum(counts)])
        for i, n in enumerate(counts):
            text = texts[first + i]
            size = len(text)
            row = out[first + i]
            row[:256] = np.log(1e-3 + np.bincount(np.frombuffer(text, np.uint8), minlength=256) / max(1, size))
            own, lines = hashes[edges[i]:edges[i + 1]], text.split(b"\n")
            words, twice = np.unique(own).size, (own[1:] == own[:-1]).sum()
            row[256:] = (math.log1p(size), math.log1p(n), size / (n + 1), words / max(1, n), len(set(lines)) / len(lines), size / len(lines) / 1000, twice / max(1, n))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward((x - self.mean) / self.scale, self.layers)[1], -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 40) -> Model:
    """Fit on feature rows. Without positives or unlabelled rows every score is 0.5."""
    if not len(positive) or not len(unlabelled):
        zero = [np.zeros((WIDTH, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]
        return Model(np.zeros(WIDTH), np.ones(WIDTH), zero, 0.5)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.05
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    if prior is None:
        prior = estimated_prior(p, u)
    return Model(mean, scale, _train(p, u, prior, epochs), prior)


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of unlabelled to positive mass above a score, on rows the scoring network has not seen."""
    half = lambda x: (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    (fit_p, p), (fit_u, u) = half(p), half(u)
    layers = _train(fit_p, fit_u, None, 15)
    sp, su = np.sort(_forward(p, layers)[1]), np.sort(_forward(u, layers)[1])
    cuts = np.unique(np.quantile(sp, np.linspace(0, 0.9, 91)))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(len(su)) + 1 / math.sqrt(len(sp)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, (hidden @ layers[2] + layers[3])[:, 0]


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int) -> list[np.ndarray]:
    """With a prior: non-negative risk under the sigmoid loss. Without: positives against unlabelled, logistic loss."""
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, math.sqrt(2 / p.shape[1]), (p.shape[1], 48)), np.zeros(48), rng.normal(0, 0.2, (48, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    batches = max(1, len(u) // 256)
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
        for pi, ui in zip(ps, us):
            if not len(pi):
                continue
            x = np.concatenate([p[pi], u[ui]])
            hidden, z = _forward(x, layers)
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            n, m = len(pi), len(ui)
            g = np.empty(len(x))
            if prior is None:
                g[:n], g[n:] = (s[:n] - 1) / n, s[n:] / m
            else:
                slope = s * (1 - s)  # the loss of calling a row positive is 1 - s, negative s
                rest = s[n:].mean() - prior * s[:n].mean()
                if rest >= 0:
                    g[:n], g[n:] = -2 * prior * slope[:n] / n, slope[n:] / m
                else:  # the estimated negative risk may not be negative: step back from it
                    g[:n], g[n:] = prior * slope[:n] / n, -slope[n:] / m
            gz = g[:, None]
            gh = (gz @ layers[2].T) * (hidden > 0)
            grads = [x.T @ gh, gh.sum(0), hidden.T @ gz, gz.sum(0)]
            step += 1
            for i, grad in enumerate(grads):
                grad = grad + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] = layers[i] - 2e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def train(documents: DataFrame, positives: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
          prior: float | None = None) -> Model:
    """Fit on bounded samples: trusted positives (``positives`` has doc_id) and unlabelled rows of ``documents``.

    Rows are taken in the order of a hash of their id and text; positives without id or text row are not read.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = positives.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    trusted = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    trusted = trusted.select(F.xxhash64("doc_id").alias("place"), F.lit(1).cast("long").alias("copies"), "text")

    def measured(batches):
        for pdf in batches:
            if not pdf.empty:
                yield pd.DataFrame({"place": pdf["place"], "copies": pdf["copies"], "x": [row.tobytes() for row in features(as_bytes(pdf["text"]))]})

    def collected(df: DataFrame, most: int) -> np.ndarray:
        """The first ``most`` rows in the order of their place, each as often as its copies."""
        found = df.select("place", "copies", "text").mapInPandas(measured, "place long, copies long, x binary").toLocalIterator()
        got = [x for _, copies, x in sorted((r["place"], r["copies"], bytes(r["x"])) for r in found) for _ in range(copies)][:most]
        return np.frombuffer(b"".join(got), np.float32).reshape(-1, WIDTH)

    return fit(collected(trusted, max_positive), collected(_sample(rows, max_unlabelled), max_unlabelled), prior)


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """(place, copies, text): about ``most`` rows, and some more, picked by a hash of id and text.

    Which rows these are does not depend on files or partitions. Rows equal in
    id and text have one place; of n such rows their share of n is taken, up or
    down by the place, so that a text that is often repeated is in the sample as
    often as in the table.
    """
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    counted = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, 1.1 * most / max(1, total))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    copies = F.floor(F.col("n") * share + 1 - (place + 1) / float(1 << 30))
    chosen = counted.select("key", place.alias("place"), F.least(copies, F.lit(most)).alias("copies")).where("copies > 0")
    chosen = chosen.orderBy("place", "key").limit(most)  # so many at most reach every task
    return keyed.join(F.broadcast(chosen), "key").groupBy("key", "place", "copies").agg(F.min("text").alias("text"))


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``documents`` with the probability of good quality; a null text scores as an empty one. Other columns stay as they are."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities(features(as_bytes(texts))))

    return documents.withColumn(column, probability(F.col("text").cast("string")))
