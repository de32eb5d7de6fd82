"""Language of a text by prediction by partial matching: the language whose statistics give the shortest code wins.

Every language has a context tree over bytes: how often each byte followed each
run of up to three bytes, counted over all texts of the language. A byte is coded
in the longest context in which it was seen; each longer context of the language
that did not hold it costs an escape (method C, without exclusions: a context seen
n times with q different successors gives c / (n + q) to a byte it saw c times and
q / (n + q) to the escape). Below the empty context all 256 bytes are equally
likely. The statistics are frozen while texts are scored, so a byte's code length
depends on four bytes only and is worked out once for all languages; lengths are
whole numbers of 2 ** -20 bits, and their sums do not depend on how texts are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import Written

ORDER = 3                 # longest context, in bytes
UNIT = 1 << 20            # parts of a bit
MAX_CELLS = 8_000_000     # (run of bytes, language) pairs of one pass over the texts, 8 bytes each in a task
STEP = 1_000_000          # bytes of text counted or scored at once
HELD = 2_000_000          # distinct runs a task gathers before it hands them on

_PAD = b" " * ORDER
# Whatever is no letter among the ASCII characters is a blank; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-case UTF-8, every run of ASCII characters other than letters as one blank."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def _pieces(texts: Iterator[bytes], step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first run, runs) for bounded steps: the byte runs of ORDER + 1 bytes that end at each byte of a text.

    A text begins after blanks; one that is longer than a step goes on in the next, after its own last bytes.
    """
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(part for _, part in held), np.uint8).astype(np.int64)
        runs = np.zeros(len(data) - ORDER, np.int64)
        for i in range(ORDER + 1):
            runs = runs << 8 | data[i:len(data) - ORDER + i]
        lengths = np.array([len(part) for _, part in held])
        ends = np.cumsum(lengths)
        inside = np.ones(len(runs), bool)
        for i in range(ORDER):  # runs that reach over into the next text
            inside[ends[:-1] - 1 - i] = False
        first = np.cumsum(lengths - ORDER) - (lengths - ORDER)
        return np.array([n for n, _ in held]), first, runs[inside]

    for number, text in enumerate(texts):
        text, start = _PAD + text, 0
        while len(text) - start > ORDER:
            part = text[start:start + ORDER + step - size]
            held.append((number, part))
            size += len(part) - ORDER
            start += len(part) - ORDER
            if size >= step:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums (along the first axis) of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts, axis=0) if len(keys) else counts


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, run, n), summed over as many rows as a task holds at a time."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for lang in held:
            held[lang] = [_summed(*(np.concatenate(x) for x in zip(*held[lang])))]
        size = sum(len(parts[0][0]) for parts in held.values())
        if size > least:
            for lang, [(keys, n)] in held.items():
                yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "run": pa.array(keys), "n": pa.array(n)})
            held.clear()
            size = 0

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = (folded(batch.column(1)[int(i)].as_py()) for i in np.flatnonzero(langs == lang))
            for _, _, runs in _pieces(texts, STEP):
                keys, n = np.unique(runs, return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                size += len(keys)
                if size > HELD:
                    yield from rows(HELD // 2)
    yield from rows(0)


class Index:
    """Rows of whole numbers by value, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.rows = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.rows[slot[free]] = keys[left[free]], left[free]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        found, slot = np.full(len(keys), -1, np.int64), self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            found[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found


def _units(ratio: np.ndarray) -> np.ndarray:
    return np.round(np.log2(ratio) * UNIT).astype(np.int32)


@dataclass
class Lengths:
    """Code lengths of some languages for the bytes that follow some bytes.

    ``orders[j]`` of context length j holds the runs seen in any of the languages
    with their code lengths, escapes included, and the contexts with the cost of
    leaving them; a language that never saw a context leaves it for nothing.
    """

    languages: list[int]
    before: np.ndarray | None                       # the last context bytes this holds, None for all
    orders: list[tuple[Index, np.ndarray, Index, np.ndarray]]
    empty: np.ndarray                               # (256, languages)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """(runs, languages): the code length of each run's last byte; 0 where it is not held here."""
        total = np.zeros((len(runs), len(self.languages)), np.int32)
        left = np.arange(len(runs)) if self.before is None else np.flatnonzero(self.before[runs >> 8 & 255])
        for j in range(ORDER, 0, -1):
            index, lengths, contexts, leaving = self.orders[j - 1]
            own = runs[left] & ((1 << 8 * (j + 1)) - 1)
            row = index.find(own)
            hit = row >= 0
            total[left[hit]] += lengths[row[hit]]
            left, own = left[~hit], own[~hit]
            row = contexts.find(own >> 8)
            known = row >= 0
            total[left[known]] += leaving[row[known]]
        total[left] += self.empty[runs[left] & 255]
        return total


def code_lengths(runs: np.ndarray, counts: np.ndarray, last: np.ndarray, languages: list[int], before: np.ndarray | None) -> Lengths:
    """From ``counts`` (runs, languages) and the counts of single bytes ``last`` (256, languages)."""
    n, q = last.sum(0), (last > 0).sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.where(n > 0, np.log2((n + q) / np.maximum(q, 1)), 0.0)
        leaving = np.round(unseen * UNIT).astype(np.int32)
        empty = np.where(last > 0, _units((n + q) / np.maximum(last, 1) + (last == 0)), leaving + 8 * UNIT).astype(np.int32)
    below_keys, below = np.arange(256), empty
    orders = []
    for j in range(1, ORDER + 1):
        keys, c = _summed(runs & ((1 << 8 * (j + 1)) - 1), counts)
        contexts, sums = _summed(keys >> 8, np.concatenate([c, (c > 0).astype(np.int64)], 1))
        n, q = sums[:, :len(languages)], sums[:, len(languages):]
        leaving = np.where(n > 0, _units((n + q) / np.maximum(q, 1) + (n == 0)), 0).astype(np.int32)
        at = np.searchsorted(contexts, keys >> 8)
        shorter = below[np.searchsorted(below_keys, keys & ((1 << 8 * j) - 1))]
        lengths = np.where(c > 0, _units((n + q)[at] / np.maximum(c, 1) + (c == 0)), leaving[at] + shorter).astype(np.int32)
        orders.append((Index(keys), lengths, Index(contexts), leaving))
        below_keys, below = keys, lengths
    return Lengths(languages, before, orders, empty)


@dataclass
class Statistics:
    """The languages in order and their counted byte runs (lang, run, n), a written table."""

    languages: list[str]
    runs: DataFrame

    def passes(self, max_cells: int = MAX_CELLS) -> Iterator[Lengths]:
        """The code lengths in portions of bounded size, usually one.

        A byte's contexts all end in the byte before it, so portions are cut by
        that byte, and by languages where one byte has too many runs. A single
        byte and language have at most 156 ** 3 runs, the folded alphabet's.
        """
        if not self.languages:
            return
        before = F.expr("run >> 8 & 255")
        sizes = {r.b: r.n for r in self.runs.select(before.alias("b"), "run").distinct().groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
        together = max(1, min(len(self.languages), max_cells // max(sizes.values())))
        last = self._matrix(self.runs.groupBy("lang", F.expr("run & 255").alias("run")).agg(F.sum("n").alias("n")), self.languages)
        single = np.zeros((256, len(self.languages)), np.int64)
        single[last[0]] = last[1]
        for first in range(0, len(self.languages), together):
            group = self.languages[first:first + together]
            room = max_cells // len(group)
            portions: list[tuple[int, list[int]]] = []
            for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
                for i, (used, members) in enumerate(portions):
                    if used + sizes[b] <= room:
                        portions[i] = (used + sizes[b], [*members, b])
                        break
                else:
                    portions.append((sizes[b], [b]))
            for number, (_, members) in enumerate(portions):
                rows = self.runs.where(F.col("lang").isin(group))
                keys, counts = self._matrix(rows.where(before.isin(members)) if len(portions) > 1 else rows, group)
                held = None
                if len(portions) > 1:  # bytes never seen before another one go with the first portion
                    held = np.isin(np.arange(256), members) | ((number == 0) & ~np.isin(np.arange(256), list(sizes)))
                yield code_lengths(keys, counts, single[:, first:first + together], list(range(first, first + len(group))), held)

    @staticmethod
    def _matrix(rows: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(runs, counts by language) of a bounded part of the table."""
        table = rows.select("lang", "run", "n").toArrow()
        keys, place = np.unique(table["run"].to_numpy(), return_inverse=True)
        counts, number = np.zeros((len(keys), len(languages)), np.int64), {lang: i for i, lang in enumerate(languages)}
        counts[place, [number[lang] for lang in table["lang"].to_pylist()]] = table["n"].to_numpy()
        return keys, counts


def train(documents: DataFrame, written: Written) -> Statistics:
    """Count every text of ``documents`` (text, lang) with a language; null and empty texts add nothing."""
    texts = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    parts = texts.where("lang IS NOT NULL AND text <> ''").mapInArrow(_count_runs, "lang string, run long, n long")
    runs = written.keep(parts.groupBy("lang", "run").agg(F.sum("n").alias("n")))
    return Statistics(sorted(r.lang for r in runs.select("lang").distinct().collect()), runs)


def _add_lengths(lengths: Lengths, languages: int, step: int, keeps_text: bool):
    """Adds the code lengths of a portion to the column ``lengths`` of rows whose text is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            there = np.flatnonzero(np.asarray(column.is_valid()))
            total = np.zeros((len(there), languages), np.int64)
            for numbers, first, runs in _pieces((folded(column[int(i)].as_py()) for i in there), step):
                part = np.add.reduceat(lengths.of(runs), first, axis=0, dtype=np.int64)
                np.add.at(total, (numbers[:, None], np.array(lengths.languages)[None]), part)
            out = np.zeros((batch.num_rows, languages), np.int64)
            out[there] = total
            out += batch.column("lengths").flatten().to_numpy().reshape(-1, languages)
            columns = {name: batch.column(name) for name in batch.schema.names if name != "lengths" and (keeps_text or name != "text")}
            yield pa.record_batch({**columns, "lengths": pa.ListArray.from_arrays(np.arange(0, out.size + 1, languages, dtype=np.int32), out.ravel())})

    return run


def predict(documents: DataFrame, statistics: Statistics, written: Written, max_cells: int = MAX_CELLS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``documents`` (doc_id, text).

    The score is the share of the best language if each were as likely as its
    code says, 1 / sum(2 ** -(extra bits)). A text that is null or has no letter
    is ``und`` with score 0, and so is every text if no language was learned.
    Equal lengths go to the language that sorts first. Whole texts count,
    whatever their length; further columns are ignored, repeated rows repeat.
    """
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select("doc_id", known.alias("known"), F.when(known, F.col("text").cast("string")).alias("text"))
    languages = statistics.languages
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("lengths", F.array_repeat(F.lit(0).cast("long"), len(languages)))
    step = max(10_000, min(STEP, 4_000_000 // len(languages)))
    portions = statistics.passes(max_cells)
    portion = next(portions)
    kind = dict(rows.dtypes)["doc_id"]
    while portion is not None:
        following = next(portions, None)
        text = "" if following is None else ", text string"
        rows = rows.mapInArrow(_add_lengths(portion, len(languages), step, following is not None), f"doc_id {kind}, known boolean{text}, lengths array<long>")
        if following is not None:
            rows = written.keep(rows)
        portion = following
    best = F.array_min("lengths")
    names = F.element_at(F.array(*[F.lit(lang) for lang in languages]), F.array_position("lengths", best).cast("int"))
    score = 1 / F.aggregate("lengths", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), (best - x) / UNIT))
    return rows.select("doc_id", F.when(F.col("known"), names).otherwise("und").alias("lang_pred"), F.when(F.col("known"), score).otherwise(0.0).alias("score"))
