"""Helpers shared by the operators: word positions and hashes of whole texts, bounded top-k merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 1000          # texts handed to a Python worker at once
BYTES_PER_STEP = 100_000     # text bytes hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_LETTERS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: hand them to Python in batches a worker surely holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.base))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.inverse))])
        return self.up[:n], self.down[:n]


_bytes_powers, _word_powers = _Powers(_BASE), _Powers(_STEP)


def word_hashes(data: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``; a word is a run of bytes other than ASCII white space.

    ``prefixes`` adds a row of hashes for each length: those of the words' first bytes (0 for shorter words).
    """
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _bytes_powers.get(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * up[: len(data)])])

    def hashed(upto: np.ndarray) -> np.ndarray:
        return mix((sums[upto] - sums[starts]) * down[starts]) ^ (upto - starts).astype(np.uint64)

    if prefixes:
        parts = [np.where(ends - starts > n, mix(hashed(np.minimum(ends, starts + n)) + np.uint64(n)), np.uint64(0)) for n in prefixes]
        return np.stack([hashed(ends), *parts]), starts
    return hashed(ends), starts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = _word_powers.get(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * up[: len(words)])])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def texts_in_steps(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the first text, word hashes, words per text) for runs of texts of bounded size.

    A text longer than the step forms a run of its own, so nothing is cut.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= BYTES_PER_STEP):
            size += len(texts[last]) + 1
            last += 1
        data = np.frombuffer(b"\n".join(texts[first:last]) + b"\n", np.uint8)
        hashes, starts = word_hashes(data, prefixes)
        ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
        yield first, hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        first = last


def as_bytes(texts) -> list[bytes]:
    """UTF-8 bytes of a pandas column of texts; null becomes empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def vectors_of(table: DataFrame, id_column: str, vector_column: str, ok: str) -> DataFrame:
    """(id, vec): one double vector per id of the rows that pass ``ok``, an SQL test of ``vec``.

    Rows with a null id take no part; of several rows of one id the smallest vector counts.
    """
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec"))
    finite = "vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = rows.where(f"id IS NOT NULL AND {finite} AND {ok}")
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column, dtype, width: int) -> np.ndarray:
    """Rows of packed numbers as one matrix."""
    return np.frombuffer(b"".join(column), dtype).reshape(-1, width)
