"""Short codes of vectors: each of 16 equal parts is replaced by the nearest entry of a codebook that Lloyd's rounds fit.

Every task plants cover trees over chunks of its rows, one tree a part: a node's
points lie within its radius of the centre, its children are centres more than
half the scale apart that cover it, and the first child has the node's own
centre. The points of a node are a stretch of the chunk's order, so sums and
counts of any node are differences of running sums. The trees are written once;
every round walks them from the roots with the codebook entries that may still be
nearest. By the triangle inequality an entry further from the centre than the
nearest one plus twice the radius is nearest to no point below. When one entry is
left, the whole subtree goes to it; only ambiguous nodes descend, in the end to
exact comparisons of whole numbers. A round's sums meet in one small table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.skew import lookup_join
from kerbline.session import Written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4096   # a chunk holds at most so many bytes of components, and rows
LEAF = 8                                  # nodes of so few points are compared point by point
CELLS = 4_000_000                         # components subtracted at once

_FINITE = "{0} IS NOT NULL AND size({0}) > 0 AND forall({0}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
_CHUNK = "vec_id array<long>, label array<string>, dim int, points binary, places binary, nodes binary"
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Forest:
    """Cover trees over ``points``, which stand in tree order; ``places`` says where each came from.

    Node i holds the points start[i] .. end[i] - 1, the first of them its centre.
    Nodes 0 .. roots - 1 are the trees' roots.
    """

    points: np.ndarray
    places: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius2: np.ndarray
    child: np.ndarray
    children: np.ndarray


def plant(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Forest:
    """One cover tree for each stretch of ``points``, all grown level by level."""
    places = np.arange(len(points))
    gap = ((points - points[np.repeat(starts, ends - starts)]) ** 2).sum(1)
    radius2 = np.maximum.reduceat(gap, starts)
    found = [(starts, ends, radius2)]
    child, children = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    grown = [(child, children)]
    number, known = np.arange(len(starts)), len(starts)
    scale = math.ceil(math.log2(max(1.0, math.sqrt(int(radius2.max(initial=0))))))
    open_ = (starts, ends, radius2, number)
    heads, counts = [child], [children]
    while True:
        keep = (open_[1] - open_[0] > LEAF) & (open_[2] > 0)
        open_ = tuple(x[keep] for x in open_)
        if not len(open_[0]):
            break
        scale -= 1
        reach = 4.0**scale
        split = open_[2] > reach
        waiting = tuple(x[~split] for x in open_)
        start, end, _, owner = (x[split] for x in open_)
        at = _spans(start, end - start)
        tree, coords = np.repeat(np.arange(len(start)), end - start), points[places[at]]
        place_in, apart = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        left, turn = np.arange(len(at)), 0
        while len(left):
            mine = tree[left]
            first = np.concatenate([[True], mine[1:] != mine[:-1]])
            centre = left[first][np.cumsum(first) - 1]
            gap = ((coords[left] - coords[centre]) ** 2).sum(1)
            near = gap <= reach
            place_in[left[near]], apart[left[near]] = turn, gap[near]
            left, turn = left[~near], turn + 1
        order = np.lexsort((place_in, tree))
        places[at] = places[at[order]]
        tree, place_in, apart = tree[order], place_in[order], apart[order]
        first = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (place_in[1:] != place_in[:-1])])) if len(tree) else np.zeros(0, np.int64)
        new_start = at[first]
        new_end = np.concatenate([at[first[1:] - 1], at[-1:]]) + 1 if len(first) else new_start
        new_radius2 = np.maximum.reduceat(apart, first) if len(first) else new_start
        number = known + np.arange(len(first))
        known += len(first)
        per_owner = np.bincount(tree[first], minlength=len(start))
        heads.append(np.zeros(len(first), np.int64))
        counts.append(np.zeros(len(first), np.int64))
        found.append((new_start, new_end, new_radius2))
        all_heads, all_counts = np.concatenate(heads), np.concatenate(counts)
        all_heads[owner] = number[0] + np.cumsum(per_owner) - per_owner if len(first) else 0
        all_counts[owner] = per_owner
        heads, counts = [all_heads], [all_counts]
        open_ = tuple(np.concatenate(pair) for pair in zip(waiting, (new_start, new_end, new_radius2, number)))
    start, end, radius2 = (np.concatenate(x) for x in zip(*found))
    return Forest(points[places], places, start, end, radius2, np.concatenate(heads), np.concatenate(counts))


def nearest_entries(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, entry) of stretches of points in tree order: tree t's nearest entry of books[t], ties to the lower index."""
    trees, entries, _ = books.shape
    node, tree = np.arange(trees), np.arange(trees)
    lists, candidates = np.full(trees, entries), np.tile(np.arange(entries), trees)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distances(at: np.ndarray, tree: np.ndarray, entry: np.ndarray) -> np.ndarray:
        step = max(1, CELLS // max(1, books.shape[2]))
        return np.concatenate([((forest.points[at[i:i + step]] - books[tree[i:i + step], entry[i:i + step]]) ** 2).sum(1) for i in range(0, len(at), step)])

    while len(node):
        heads = np.cumsum(lists) - lists
        d2 = distances(np.repeat(forest.start[node], lists), np.repeat(tree, lists), candidates)
        least, radius2 = np.minimum.reduceat(d2, heads), forest.radius2[node]
        # Roots of whole numbers are rounded, so the bound is a little wider than the inequality's.
        bound = (np.sqrt(least) + 2 * np.sqrt(radius2)) * (1 + 1e-9) + 1e-9
        point = radius2 == 0
        kept = np.where(np.repeat(point, lists), d2 == np.repeat(least, lists), np.sqrt(d2) <= np.repeat(bound, lists))
        left = np.add.reduceat(kept.astype(np.int64), heads)
        candidates, heads = candidates[kept], np.cumsum(left) - left
        whole = point | (left == 1)
        done.append((forest.start[node[whole]], forest.end[node[whole]], candidates[heads[whole]]))

        leaf = ~whole & (forest.children[node] == 0)
        if leaf.any():
            size = (forest.end - forest.start)[node[leaf]]
            at, many = _spans(forest.start[node[leaf]], size), np.repeat(left[leaf], size)
            entry = candidates[_spans(np.repeat(heads[leaf], size), many)]
            d2 = distances(np.repeat(at, many), np.repeat(np.repeat(tree[leaf], size), many), entry)
            heads_of = np.cumsum(many) - many
            best = d2 == np.repeat(np.minimum.reduceat(d2, heads_of), many)
            done.append((at, at + 1, np.minimum.reduceat(np.where(best, entry, entries), heads_of)))

        inner = ~whole & ~leaf
        grown = forest.children[node[inner]]
        lists = np.repeat(left[inner], grown)
        candidates = candidates[_spans(np.repeat(heads[inner], grown), lists)]
        node, tree = _spans(forest.child[node[inner]], grown), np.repeat(tree[inner], grown)
    return tuple(np.concatenate(x) for x in zip(*done))


def _edges(dim: int) -> np.ndarray:
    """Where the parts begin and end; equal parts if ``dim`` is a multiple of their number."""
    return np.arange(PARTS + 1) * dim // PARTS


def _cut(vectors: np.ndarray) -> np.ndarray:
    """(rows, dim) -> (parts, rows, width), shorter parts filled up with zeros."""
    edges = _edges(vectors.shape[1])
    out = np.zeros((PARTS, len(vectors), int(np.diff(edges).max())), np.int64)
    for part in range(PARTS):
        out[part, :, :edges[part + 1] - edges[part]] = vectors[:, edges[part]:edges[part + 1]]
    return out


def _whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); fails where squared distances of such numbers might not fit a long."""
    scaled = np.floor(values * SCALE)
    if scaled.size and np.abs(scaled).max() > math.sqrt(2**60 / values.shape[1]):
        raise OverflowError("vector components are too large for distances in long numbers")
    return scaled.astype(np.int64)


def _chunks(dim: int):
    """(vec_id, label, vec) -> rows of _CHUNK with the trees of up to CHUNK_ROWS vectors."""
    rows = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                numbers = _whole_numbers(part.column(2).flatten().to_numpy().reshape(-1, dim))
                points, n = _cut(numbers), part.num_rows
                starts = np.arange(PARTS) * n
                forest = plant(points.reshape(PARTS * n, -1), starts, starts + n)
                nodes = np.stack([forest.start, forest.end, forest.radius2, forest.child, forest.children])
                yield pa.record_batch({
                    "vec_id": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "label": pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                    "dim": pa.array([dim], pa.int32()), "points": pa.array([numbers.tobytes()], pa.binary()),
                    "places": pa.array([forest.places.astype(np.int32).tobytes()], pa.binary()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    return run


def _read(row: dict) -> Forest:
    numbers = np.frombuffer(row["points"], np.int64).reshape(-1, row["dim"])
    places, nodes = np.frombuffer(row["places"], np.int32), np.frombuffer(row["nodes"], np.int64).reshape(5, -1)
    return Forest(_cut(numbers).reshape(len(places), -1)[places], places, *nodes)


@dataclass
class Codebooks:
    """``books``: (parts, entries, width) whole numbers; the last parts' unused places are zero."""

    books: np.ndarray
    dim: int

    def sha256(self) -> str:
        """Of all components as decimal numbers by part, entry and position, joined by commas."""
        widths = np.diff(_edges(self.dim))
        return hashlib.sha256(",".join(str(x) for part, w in zip(self.books, widths) for entry in part for x in entry[:w].tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector of whole numbers a code stands for."""
        return [x for part, w in enumerate(np.diff(_edges(self.dim))) for x in self.books[part, int(code[2 * part:2 * part + 2], 16), :w].tolist()]


def trees(vectors: DataFrame, written: Written) -> tuple[DataFrame, np.ndarray] | None:
    """The written chunks of ``vectors`` (vec_id, embedding, label) and the first codebooks; None without usable rows.

    Rows whose vector is null or empty or holds null or non-finite components
    take no part, nor do vectors of another length than that of the smallest
    vec_id. The first codebooks are the parts of the 64 smallest vec_ids, of
    equal ids the smallest vectors, null ids last.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vec")).where(_FINITE.format("vec"))
    order = [F.asc_nulls_last("vec_id"), "vec"]
    first = rows.select("vec_id", "vec").orderBy(*order).limit(1).collect()
    if not first:
        return None
    dim = len(first[0].vec)
    rows = rows.where(F.size("vec") == dim)
    start = np.array([r.vec for r in rows.select("vec_id", "vec").orderBy(*order).limit(ENTRIES).collect()], float)
    return written.keep(rows.mapInArrow(_chunks(dim), _CHUNK)), _cut(_whole_numbers(start))


def _round_sums(books: np.ndarray):
    """Chunks -> (part, entry, position, total, n): the sums of the points nearest to each entry, one table a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        totals, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                forest = _read(row)
                start, end, entry = nearest_entries(forest, books)
                sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(forest.points, 0)])
                key = start // len(row["vec_id"]) * entries + entry
                np.add.at(totals, key, sums[end] - sums[start])
                np.add.at(counts, key, end - start)
        used = np.flatnonzero(counts)
        yield pa.record_batch({
            "part": pa.array(np.repeat(used // entries, width)), "entry": pa.array(np.repeat(used % entries, width)),
            "position": pa.array(np.tile(np.arange(width), len(used))), "total": pa.array(totals[used].ravel()),
            "n": pa.array(np.repeat(counts[used], width))})

    return run


def learn(chunks: DataFrame, books: np.ndarray, dim: int, rounds: int = ROUNDS) -> Codebooks:
    """Lloyd's rounds; what reaches the driver has the size of the codebooks."""
    trees_only = chunks.select("vec_id", "dim", "points", "places", "nodes")
    for _ in range(rounds):
        sums = trees_only.mapInArrow(_round_sums(books), "part long, entry long, position long, total long, n long")
        found = sums.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in found:
            books[r.part, r.entry, r.position] = int(r.total) // r.n
    return Codebooks(books, dim)


def encode(chunks: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every vector of the chunks."""
    books = codebooks.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = books.shape[0]
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch in batches:
            for row in batch.to_pylist():
                forest, n = _read(row), len(row["vec_id"])
                start, end, entry = nearest_entries(forest, books)
                codes = np.empty(parts * n, np.int64)
                codes[_spans(start, end - start)] = np.repeat(entry, end - start)
                gaps = ((forest.points - books[np.arange(parts * n) // n, codes]) ** 2).sum(1)
                error, code = np.empty(parts * n, np.int64), np.empty(parts * n, np.int64)
                error[forest.places], code[forest.places] = gaps, codes
                yield pa.record_batch({
                    "vec_id": pa.array(row["vec_id"], pa.int64()), "label": pa.array(row["label"], pa.string()),
                    "code": pa.array(["".join(r) for r in digits[code.reshape(parts, n).T]], pa.string()), "error": pa.array(error.reshape(parts, n).sum(0))})

    return chunks.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, embedding, label).

    Every usable row gives a row, repeated ones too (see ``trees`` for which are
    usable). Equal distances go to the lower index; an entry nothing is nearest
    to stays. With fewer than 64 rows there are as many entries. ``label_error``
    sums the errors of all rows with the same label, null labels together.
    Without usable rows the result is empty; components so large that squared
    distances might not fit a long make it fail. Further columns are ignored.
    """
    spark = vectors.sparkSession
    written = Written(spark, "codes")
    found = trees(vectors, written)
    if found is None:
        return spark.createDataFrame([], _RESULT)
    chunks, books = found
    codebooks = learn(chunks, books, chunks.select("dim").first()[0])
    rows = encode(chunks, codebooks).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    rows = written.keep(rows.select("vec_id", "code", "error", "key"))
    written.drop(chunks)
    labels = written.keep(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    counted = labels.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    joined = lookup_join(rows, labels, ["key"], spread=["vec_id", "code"], table_rows=counted.labels, total=counted.rows, weight="n")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks.sha256()).alias("codebooks_sha256"))
