"""Removal of passages that recur across documents, by sharded Aho-Corasick automata.

A window is a run of ``window`` words. Equal windows have the same smallest hash
among their shorter word runs (their anchor), so only windows whose anchor stands
in two documents are looked at. Consecutive windows of one anchor form a segment.
Equal segments are folded first; the segments of an anchor go to one shard. There
the recurring windows are confirmed word by word and compiled into an automaton
over the shard's words, and all segments are streamed through it, which gives every
occurrence together with the smallest document that holds it. Segments of an
anchor with very many different ones are cut into windows, which are shards of
their own, so no anchor fills a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import as_bytes, gram_hashes, small_batches, texts_in_steps
from kerbline.session import Written

WINDOW, ANCHOR_WORDS = 13, 6
SHARD_SEGMENTS = 4_000
HOT_SEGMENTS = 1_000   # an anchor with more different segments is cut into windows


def without_repeats(documents: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS,
                    hot_segments: int = HOT_SEGMENTS, shard_segments: int = SHARD_SEGMENTS, result: str = "repeats") -> DataFrame:
    """``documents`` (with doc_id and text) and a column ``result``: struct(n_words, n_removed, kept).

    Words are runs of bytes other than ASCII white space. A word is removed if a
    window that covers it also starts in a document with a smaller doc_id; kept
    are the other words, joined by one space. Windows are judged on the input.
    A null text has no words. Rows without id lose nothing and take nothing from
    others; rows that share an id do not affect each other.
    """
    spark = documents.sparkSession
    small_batches(spark)
    written = Written(spark, "substrings")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    anchors = docs.mapInPandas(_anchors(window, anchor_words), "anchor long, doc_id long")
    live = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("anchor")
    live = written.keep(live)
    wanted = written.keep(anchors.join(live, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    written.drop(live)
    rows = docs.join(wanted.hint("shuffle_hash"), "doc_id").withColumn("version", F.xxhash64("text"))
    segments = written.keep(rows.mapInPandas(_segments(window, anchor_words), "doc_id long, version long, start int, anchor long, words string"))
    written.drop(wanted)

    def folded(table: DataFrame) -> DataFrame:
        return table.groupBy("anchor", "words").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))

    different = written.keep(folded(segments))
    hot = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot_segments).select("anchor")
    hot = written.keep(hot)
    if not hot.isEmpty():
        cut = _windows(segments.join(hot, "anchor"), window)
        segments, plain = segments.join(hot, "anchor", "left_anti"), different.join(hot, "anchor", "left_anti")
        segments, different = segments.unionByName(cut), plain.unionByName(folded(cut))
    shards = max(1, math.ceil(different.count() / shard_segments))
    shard = F.pmod(F.xxhash64("anchor", F.lit(7)), F.lit(shards)).alias("shard")
    hits = different.select(shard, "anchor", "words", "lo", "hi").groupBy("shard").applyInPandas(
        _automaton(window), "anchor long, words string, first array<long>")
    hits = written.keep(hits.select("anchor", F.xxhash64("words").alias("same"), "first"))

    # A window is removed where its first document is smaller.
    placed = segments.select("doc_id", "version", "start", "anchor", F.xxhash64("words").alias("same")).join(hits, ["anchor", "same"])
    starts = F.expr("filter(transform(first, (x, i) -> CASE WHEN x < doc_id THEN start + i END), x -> x IS NOT NULL)")
    removed = placed.select("doc_id", "version", starts.alias("starts")).where(F.size("starts") > 0)
    removed = removed.groupBy("doc_id", "version").agg(F.flatten(F.collect_set("starts")).alias("_starts"))
    removed = written.keep(removed)

    columns = documents.columns
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_version"))
    joined = keyed.join(removed.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "_starts").hint("shuffle_hash"), ["_id", "_version"], "left")
    return joined.select("row.*", _cut(window)(F.col("row.text").cast("string"), F.col("_starts")).alias(result))


def _cut(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(as_bytes(texts), starts):
            words = text.split()
            if at is not None and len(at):
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.unique(np.asarray(at, np.int64))
                edge[at] += 1
                np.subtract.at(edge, at + window, 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
    return cut


def _least(words: np.ndarray, window: int, run: int) -> np.ndarray:
    """The anchor of every window of ``words``."""
    grams = gram_hashes(words, run)
    width = window - run + 1
    if len(grams) < width:
        return np.empty(0, np.uint64)
    # Smallest of `width` neighbours by doubling.
    least, have = grams, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


def _each(texts: list[bytes], window: int, run: int):
    """(position, anchors of all windows) of every text."""
    for first, hashes, counts in texts_in_steps(texts):
        least, ends = _least(hashes, window, run), np.cumsum(counts)  # windows that run into the next text are left out
        for i, (start, end) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
            yield first + i, least[start:max(start, end - window + 1)]


def _anchors(window: int, run: int):
    def emit(batches):
        for pdf in batches:
            ids, found, owners = pdf["doc_id"].to_numpy(np.int64), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, least in _each(as_bytes(pdf["text"]), window, run):
                own = np.unique(least)
                found.append(own)
                owners.append(np.full(len(own), ids[i]))
            yield pd.DataFrame({"anchor": np.concatenate(found).view(np.int64), "doc_id": np.concatenate(owners)})
    return emit


def _segments(window: int, run: int):
    def emit(batches):
        for pdf in batches:
            texts = as_bytes(pdf["text"])
            ids, versions, wanted = pdf["doc_id"].to_numpy(np.int64), pdf["version"].to_numpy(np.int64), pdf["anchors"]
            out: list[tuple] = []
            for i, least in _each(texts, window, run):
                if not len(least):
                    continue
                edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                heads = least[edges[:-1]].view(np.int64)
                words = texts[i].split()
                for k in np.flatnonzero(np.isin(heads, np.asarray(wanted.iloc[i], np.int64))):
                    start, end = int(edges[k]), int(edges[k + 1])
                    out.append((ids[i], versions[i], start, heads[k], b" ".join(words[start:end - 1 + window]).decode("utf-8", "surrogatepass")))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["doc_id", "version", "start", "anchor", "words"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "version", "start", "anchor", "words"])
    return emit


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """The segments cut into their windows; each is its own anchor."""
    split = segments.withColumn("list", F.split("words", " "))
    at = split.select("doc_id", "version", "start", "list", F.explode(F.sequence(F.lit(0), F.size("list") - window)).alias("i"))
    rows = at.select("doc_id", "version", (F.col("start") + F.col("i")).alias("start"), F.array_join(F.slice("list", F.col("i") + 1, window), " ").alias("words"))
    return rows.select("doc_id", "version", "start", F.xxhash64("words", F.lit("window")).alias("anchor"), "words")


def _automaton(window: int):
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        # Words become letters of the shard's own alphabet, so that a phrase has as many nodes as words.
        letters: dict[str, str] = {}
        texts = []
        for words in pdf["words"]:
            coded = []
            for word in words.split(" "):
                letter = letters.get(word)
                if letter is None:
                    n = len(letters) + 1
                    letter = letters[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
                coded.append(letter)
            texts.append("".join(coded))
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for text, lo, hi in zip(texts, pdf["lo"].tolist(), pdf["hi"].tolist()):
            for i in range(len(text) - window + 1):
                phrase = text[i:i + window]
                if phrase not in first or lo < first[phrase]:
                    first[phrase] = lo
                if phrase not in last or hi > last[phrase]:
                    last[phrase] = hi
        # Confirmed passages: the longest runs of recurring windows that first stand in the same document.
        automaton = ahocorasick.Automaton()
        for text in texts:
            start, owner = 0, None
            for i in range(len(text) - window + 2):
                phrase = text[i:i + window]
                lo = first[phrase] if len(phrase) == window and first[phrase] < last[phrase] else None
                if lo != owner:
                    if owner is not None:
                        automaton.add_word(text[start:i - 1 + window], (i - start, owner))
                    start, owner = i, lo
        out_anchor, out_words, out_first = [], [], []
        if len(automaton):
            automaton.make_automaton()
            for anchor, words, text in zip(pdf["anchor"].tolist(), pdf["words"], texts):
                found: list[int | None] = [None] * (len(text) - window + 1)
                hit = False
                for end, (n, lo) in automaton.iter(text):
                    start = end - window + 2 - n
                    found[start:start + n] = [lo] * n
                    hit = True
                if hit:
                    out_anchor.append(anchor)
                    out_words.append(words)
                    out_first.append(found)
        return pd.DataFrame({"anchor": pd.Series(out_anchor, dtype="int64"), "words": pd.Series(out_words, dtype=object), "first": pd.Series(out_first, dtype=object)})

    return shard


def digest(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    done = without_repeats(documents.select("doc_id", "text"), **how)
    return done.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(F.col("repeats.kept").cast("binary"), 256).alias("kept_sha256"))
