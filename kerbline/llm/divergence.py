"""How far the sources of a language differ in their words: every pair of sources, and each source's own words.

A kept term is a row of counts, one per source of its language, nearly all zero.
The value of a pair is a sum over all kept terms, but it needs the nonzero counts
alone: every term is first taken as absent from both sources, a histogram of each
source's counts corrects the terms that stand in one of them, and a
frequent-pattern tree those that stand in both. The tree holds the terms' nonzero
counts in the order of their sources, so terms that begin alike share a path; a
node and each of its ancestors are two sources of the same terms, and the
correction for them is made once, whatever the number of terms below.

The tree is never whole in one place: equal rows are one path with a
multiplicity, the paths are range-partitioned and sorted, which is the tree's
depth-first order, and each task builds the tree of its stretch in batches. A node
that two batches share is corrected in both, with the terms each has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import Written

SCALE = 1_000_000_000        # shares are counted in these parts
LEAST_DOCUMENTS = 3          # a term is kept in a language if so many of its documents hold it
TERM_RANKS = 200             # words listed per source
ENTRIES = 400_000            # distinct counts a task gathers before it hands them on
STRETCH = 1_000_000          # bytes of a text whose words are held at once
BLOCK = 1_000                # sources that meet at once
PACK = 5_000                 # histogram entries that meet them
CELLS = 1_000_000            # (node, ancestor) combinations corrected at once

_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")  # of bytes whose A-Z are lower-cased


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, those of a bounded stretch at a time; a stretch ends where a term does."""
    text, start = text.lower(), 0
    while start < len(text):
        gap = _GAP.search(text, start + STRETCH)
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text, start, end)
        start = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over as many rows as a task holds at a time."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            yield pa.record_batch({
                "lang": pa.array([lang] * len(n), pa.string()), "source": pa.array([source] * len(n), pa.string()),
                "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64()),
                "docs": pa.array([docs[t] for t in n], pa.int64())})
        counts.clear()

    held = 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for words in _words(text.as_py()):
                n.update(words)
                own.update(words)
            docs.update(own)
            held += len(n) - before
            if held >= ENTRIES:
                yield from rows()
                held = 0
    yield from rows()


def term_rows(documents: DataFrame) -> DataFrame:
    """(lang, term, total, entries): the nonzero counts of every kept term as structs (source, n) ordered by source."""
    texts = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.where("text <> ''").mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    # One exchange serves both groupings; tasks have summed their terms before it.
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries"))
    return rows.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly; 1 if there are no terms."""
    return F.expr(f"""CAST(1 + CASE WHEN {terms} = 0 THEN 0 ELSE
        (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div ({total} + {terms}) END AS LONG)""")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def groups_of(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, place, total, terms, lang_total, rest): every occurring group.

    ``place`` numbers the sources of a language from 0, those with most kept
    terms first, so that the tree's paths share their beginnings. ``rest`` is the
    share of a term that the group does not hold.
    """
    occurring = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    entries = rows.select("lang", F.inline("entries"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    found = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    # One row per source of a language: as many as the report has items for a single group.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("held"), "source")) - 1
    return found.withColumns({"place": place.cast("long"), "rest": _share("0L", "total", "terms")})


def own_terms(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the words a source uses more than its language does, the first 200 by value."""
    found = rows.select("lang", "term", "total", F.inline("entries")).withColumnRenamed("total", "lang_n")
    found = found.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    found = found.withColumns({"p": _share("n", "total", "terms"), "q": _share("lang_n", "lang_total", "terms")}).where("p > q")
    found = found.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= TERM_RANKS)


def paths_of(rows: DataFrame, groups: DataFrame, written: Written) -> DataFrame:
    """(lang, path, terms): each distinct row of counts once, with the number of its terms.

    A path holds three numbers a node, in order of the sources' places: place, share, share of an absent term.
    """
    patterns = rows.groupBy("lang", "entries").agg(F.count(F.lit(1)).alias("m"))
    patterns = written.keep(patterns.withColumn("pattern", F.monotonically_increasing_id()))
    nodes = patterns.select("lang", "pattern", "m", F.inline("entries"))
    nodes = nodes.join(groups.select("lang", "source", "place", "total", "terms", "rest"), ["lang", "source"])
    nodes = nodes.select("lang", "pattern", "m", F.struct("place", _share("n", "total", "terms").alias("p"), "rest").alias("node"))
    paths = nodes.groupBy("lang", "pattern", "m").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    path = F.flatten(F.transform("nodes", lambda x: F.array(x["place"], x["p"], x["rest"])))
    # Counts that differ but have the same share make one path.
    return paths.groupBy("lang", path.alias("path")).agg(F.sum("m").alias("terms"))


class _Sums:
    """Exact sums of values by (lang, first place, second place), handed on when there are many."""

    def __init__(self):
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        folded = _folded(np.stack([a, b, value], 1))
        self.held.setdefault(lang, []).append(folded)
        self.size += len(folded)

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.size < max(1, least):
            return
        held = {lang: _folded(np.concatenate(parts)) for lang, parts in self.held.items()}
        self.size = sum(map(len, held.values()))
        if self.size < max(1, least // 2):  # mostly repeats: keep gathering
            self.held = {lang: [found] for lang, found in held.items()}
            return
        for lang, found in held.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array(found[:, 0]),
                                   "b": pa.array(found[:, 1]), "value": pa.array(found[:, 2])})
        self.held, self.size = {}, 0


def _folded(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, value) with the values of equal (a, b) summed in whole numbers."""
    if not len(rows):
        return rows
    width = int(rows[:, 1].max()) + 1
    if (int(rows[:, 0].max()) + 1) * width <= CELLS:
        key = rows[:, 0] * width + rows[:, 1]
        total, seen = np.zeros(int(key.max()) + 1, np.int64), np.zeros(int(key.max()) + 1, bool)
        np.add.at(total, key, rows[:, 2])
        seen[key] = True
        key = np.flatnonzero(seen)
        return np.column_stack([key // width, key % width, total[key]])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(1)]))
    return np.column_stack([rows[starts, :2], np.add.reduceat(rows[:, 2], starts)])


def _tree(langs: np.ndarray, offsets: np.ndarray, values: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The tree of sorted paths, one level at a time: (depth, first path, position of the path's node, terms below) of its nodes.

    A path begins a new node at a depth if it differs from the path before it there or higher up.
    """
    lengths = np.diff(offsets) // 3
    same = np.concatenate([[False], langs[1:] == langs[:-1]])
    for depth in range(int(lengths.max(initial=0))):
        here = np.flatnonzero(lengths > depth)
        at = offsets[here] + 3 * depth
        before = np.maximum(here - 1, 0)
        longer = same[here] & (lengths[before] > depth)
        was = np.where(longer, offsets[before] + 3 * depth, at)
        equal = longer & (values[at] == values[was]) & (values[at + 1] == values[was + 1])
        same = np.zeros(len(lengths), bool)
        same[here] = equal
        starts = np.flatnonzero(~equal)
        yield depth, here[starts], np.add.reduceat(terms[here], starts)


def _tree_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, path, terms) -> (lang, a, b, value): what terms that stand in two sources change, once per node and ancestor."""
    sums = _Sums()
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        langs, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        paths = batch.column(1)
        offsets, values = paths.offsets.to_numpy().astype(np.int64), paths.values.to_numpy()
        for depth, first, terms in _tree(langs, offsets, values, batch.column(2).to_numpy()):
            if not depth:
                continue
            step = max(1, CELLS // depth)
            for i in range(0, len(first), step):
                path, m = offsets[first[i:i + step]], terms[i:i + step, None]
                a, p, x = (values[path + 3 * depth + k][:, None] for k in range(3))
                above = path[:, None] + 3 * np.arange(depth)
                b, q, y = values[above], values[above + 1], values[above + 2]
                both = m * (_gap(p, q) - _gap(p, y) - _gap(x, q) + _gap(x, y))
                back = m * (_gap(q, p) - _gap(q, x) - _gap(y, p) + _gap(y, x))
                a = np.broadcast_to(a, b.shape)
                for code in np.unique(langs[first[i:i + step]]):
                    own = langs[first[i:i + step]] == code
                    sums.add(names[code], np.concatenate([a[own].ravel(), b[own].ravel()]), np.concatenate([b[own].ravel(), a[own].ravel()]),
                             np.concatenate([both[own].ravel(), back[own].ravel()]))
        yield from sums.rows(ENTRIES)
    yield from sums.rows()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, p, rest, terms) -> one row per language and up to PACK entries."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        numbers = np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1)
        for lang in set(langs):
            own = numbers[langs == lang]
            for i in range(0, len(own), PACK):
                part = own[i:i + PACK]
                yield pa.record_batch({"lang": pa.array([lang], pa.string()), "pack": pa.array([part.ravel().tolist()], pa.list_(pa.int64()))})


def _one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, pack, block) -> (lang, a, b, value): every entry of the pack against the absent share of every source of the block.

    The entry of absent terms has the share ``rest``; it carries the sum over terms absent from both sources.
    """
    sums = _Sums()
    for batch in batches:
        for lang, pack, block in zip(*(batch.column(i) for i in range(3))):
            place, p, rest, m = pack.values.to_numpy().reshape(-1, 4).T
            other, absent = block.values.to_numpy().reshape(-1, 2).T
            for i in range(0, len(place), max(1, CELLS // len(other))):
                part = slice(i, i + max(1, CELLS // len(other)))
                a, b = (x.ravel() for x in np.meshgrid(place[part], other, indexing="ij"))
                there = m[part, None] * _gap(p[part, None], absent)
                back = m[part, None] * (_gap(absent, p[part, None]) - _gap(absent, rest[part, None]))
                apart = a != b
                sums.add(lang.as_py(), np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]]),
                         np.concatenate([there.ravel()[apart], back.ravel()[apart]]))
                yield from sums.rows(ENTRIES)
    yield from sums.rows()


def source_pairs(rows: DataFrame, groups: DataFrame, written: Written) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, by how far the source is from it."""
    schema = "lang string, a long, b long, value long"
    paths = paths_of(rows, groups, written)
    tree = paths.where(F.size("path") > 3).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(_tree_corrections, schema)

    shares = rows.select("lang", F.inline("entries")).groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    shares = shares.join(groups, ["lang", "source"]).select("lang", "place", _share("n", "total", "terms").alias("p"), "rest", "m")
    absent = groups.select("lang", "place", F.col("rest").alias("p"), "rest", (F.col("terms") - F.col("held")).alias("m"))
    packs = shares.unionByName(absent).mapInArrow(_packed, "lang string, pack array<long>")
    blocks = groups.groupBy("lang", F.expr(f"place div {BLOCK}").alias("part")).agg(
        F.flatten(F.collect_list(F.array("place", "rest"))).alias("block")).drop("part")
    alone = packs.join(blocks, "lang").mapInArrow(_one_sided, schema)

    values = tree.unionByName(alone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("place").alias("a"), "source")
    items = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    found = values.join(names, ["lang", "a"]).join(items, ["lang", "b"]).select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank)


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents`` (text, lang, source).

    Part ``pair`` ranks the other sources of the language by their distance, part
    ``term`` the up to 200 words a source uses more than its language. Null
    texts, languages and sources are empty ones; every row is a document, so
    repeated rows count as often as they stand. A source without terms has the
    share of absent terms throughout; a language without kept terms has pairs of
    value 0. Equal values rank by the item's bytes. Texts of any length are
    counted whole. A null doc_id changes nothing, further columns are ignored, and
    without documents there are no rows. Counts in long numbers overflow loudly.
    """
    written = Written(documents.sparkSession, "divergence")
    rows = written.keep(term_rows(documents))
    groups = written.keep(groups_of(documents, rows))
    pairs, terms = source_pairs(rows, groups, written), own_terms(rows, groups)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
