"""Near-duplicate documents by a grouped prefix join on word shingles, exact at any similarity.

A document's shingles are put into one global order, rare ones first. Two sets
can only reach the threshold if the heads (prefixes) of their orders share a
shingle. Documents with equal sets collapse into a class; classes with identical
prefix and size collapse into a group, and only groups are posted under the
prefix shingles. Shingles posted by one group alone are dropped.

The rest is expanded to classes, and pairs are verified on the texts. As only
connected components are asked for, large groups are not paired up: in a round,
every posting list elects a pivot, and its members are verified against pivots
alone. Lists whose members have all met in one component are done. After the
rounds, all remaining pairs of a list that are still in different components,
agree in size and pass an exact bitmap bound are verified as well, so no link
between two components is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import as_bytes, gram_hashes, mix, small_batches, texts_in_steps
from kerbline.operators.components import connected_components
from kerbline.session import Written

WORDS, PERCENT = 5, 80
SLOTS = 1 << 17        # counters of the approximate shingle frequencies
PIVOT_ROUNDS = 2
BITS = 1024            # bits of the shortest bitmap
BLOCK = 2_000          # members of a list that meet outright
SHARD_ROWS = 20_000    # list members that one task of the last comparison holds, about


def sets_of(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII letters in lower case.

    A text of fewer words is one shingle; one without words is empty.
    """
    out = []
    for _, hashes, counts in texts_in_steps([t.lower() for t in texts]):
        grams = gram_hashes(hashes, words)  # those that run into the next text are left out below
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist()):
            if end - start >= words:
                own = np.sort(grams[start:end - words + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            else:
                n = end - start
                out.append(mix(gram_hashes(hashes[start:end], n) + np.uint64(n)) if n else np.empty(0, np.uint64))
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, pivot_rounds: int = PIVOT_ROUNDS, slots: int = SLOTS,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``documents`` (doc_id, text).

    Rows link if 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable. A text without words has no shingles and links
    with nothing; rows without id link with nothing and have no component. Rows
    that share an id are different documents.
    """
    spark = documents.sparkSession
    small_batches(spark)
    written = Written(spark, "ngram")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))
    level = _levels(docs, words, slots)

    # Ids pass as text, since a null would turn the column into doubles.
    sketched = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_sketch(words, percent, level), _SKETCH)
    members = written.keep(sketched.withColumn("doc_id", F.col("doc_id").cast("long")))
    linkable = members.where("n > 0 AND doc_id IS NOT NULL")
    classes = written.keep(linkable.groupBy("c").agg(
        F.min(F.struct("doc_id", "version")).alias("at"), F.min("g").alias("g"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("short").alias("short")).select(
        "c", "at.doc_id", "at.version", "g", "n", "bits", "short"))

    postings = linkable.select(F.explode("tokens").alias("token"), "g")
    live = postings.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("token")
    live = written.keep(live)
    posted = written.keep(postings.join(live.hint("shuffle_hash"), "token").distinct())
    # Expand the groups; classes of one group meet under the group itself.
    crowded = classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("g").alias("token"), "g")
    lists = written.keep(posted.unionByName(crowded).join(classes.select("g", "c", "n"), "g").select("token", "c", "n"))
    # Pivots should have little of their own.
    shared = lists.groupBy("c").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    lists = written.keep(lists.join(shared, "c"))
    written.drop(live, posted)

    tried = comps = None
    for turn in range(pivot_rounds + 1):
        rows = written.keep(_open(lists, comps))
        if rows.isEmpty():
            break
        if turn < pivot_rounds:
            pairs = _bounded(written.keep(_pivot_pairs(rows, percent, turn)), classes, percent)
        else:
            pairs = _bounded(written.keep(_all_pairs(rows, classes, percent, block)), classes, percent)
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        checked = written.keep(_verified(written.keep(pairs), classes, docs, words, percent))
        tried = checked if tried is None else written.keep(tried.unionByName(checked))
        comps = written.keep(_components(tried.where("linked")))
        written.drop(rows)
    return _result(members.select("doc_id", "n", "c"), classes, comps)


def _result(members: DataFrame, classes: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        ids = classes.select("c", F.col("doc_id").alias("component_id"))
    else:
        rooted = classes.join(comps, "c", "left").select("c", "doc_id", F.coalesce("root", "c").alias("root"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        ids = rooted.join(least, "root").select("c", "component_id")
    joined = members.join(ids, "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _levels(docs: DataFrame, words: int, slots: int) -> np.ndarray:
    """Frequency level of every slot of shingles, from counts over all documents; 0 for all but the frequent."""
    def count(batches):
        total = np.zeros(slots, np.int64)
        for pdf in batches:
            found = sets_of(as_bytes(pdf["text"]), words)
            total += np.bincount((np.concatenate([np.empty(0, np.uint64), *found]) % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "k": total[at]})

    counts = np.zeros(slots)
    sums = docs.select("text").mapInPandas(count, "slot long, k long").groupBy("slot").agg(F.sum("k").alias("k")).toPandas()
    counts[sums["slot"].to_numpy(np.int64)] = sums["k"].to_numpy(float)
    usual = max(1.0, float(np.median(counts)))
    frequent = counts > 1.2 * usual + 6 * np.sqrt(usual)
    return np.where(frequent, 1 + np.floor(2 * np.log2(np.maximum(counts, 1) / usual)), 0).astype(np.uint8)


_SKETCH = "doc_id string, version long, n long, c long, g long, bits binary, short binary, tokens array<long>"


def _sketch(words: int, percent: int, level: np.ndarray):
    """Per text: size, class (hash of the set), group (hash of prefix and size), bitmap, its fold to the shortest, prefix."""
    packed, slots = level.tobytes(), np.uint64(len(level))

    def number(data: np.ndarray) -> int:
        return int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "little", signed=True)

    def run(batches):
        levels = np.frombuffer(packed, np.uint8)
        for pdf in batches:
            if pdf.empty:
                continue
            sets = sets_of(as_bytes(pdf["text"]), words)
            heads = []
            for found in sets:
                own = levels[(found % slots).astype(np.int64)]
                size = prefix_length(len(found), percent)
                order = np.argsort(own, kind="stable") if own.any() else slice(None)
                heads.append(found[order][:size])
            bits = [_bits(s) for s in sets]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "version": pdf["version"], "n": [len(s) for s in sets], "c": [number(s) for s in sets],
                "g": [number(np.append(h, np.uint64(len(s)))) for h, s in zip(heads, sets)],
                "bits": bits, "short": [_folded(b, BITS // 8).tobytes() for b in bits], "tokens": [h.view(np.int64) for h in heads]})

    return run


def _bits(found: np.ndarray) -> bytes:
    """Parity bitmap of a set, packed: at least 1024 bits and two for each member. Halves of it fold onto each other."""
    size = max(BITS, 1 << int(2 * max(1, len(found)) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes; a fold never adds a difference."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2:]
    return out


def _open(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The lists whose members are not yet in one component."""
    rows = lists.withColumn("root", F.col("c")) if comps is None else lists.join(comps, "c", "left").withColumn("root", F.coalesce("root", "c"))
    unfinished = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return rows.join(unfinished, "token")


def _fits(percent: int):
    return (F.col("n") * percent <= F.col("other") * 100) & (F.col("other") * percent <= F.col("n") * 100)


def _pivot_pairs(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """At most one pair per member: with the pivot it shares most lists with. First pivots have least of their own, later ones vary."""
    rank = F.struct(F.col("share"), F.col("c")) if turn == 0 else F.struct(F.xxhash64("c", F.lit(turn)), F.col("c"))
    pivots = rows.groupBy("token").agg(F.max(F.struct(rank.alias("rank"), F.col("c"), F.col("n"), F.col("root"))).alias("p"))
    pivots = pivots.select("token", F.col("p.c").alias("pivot"), F.col("p.n").alias("other"), F.col("p.root").alias("pivot_root"))
    met = rows.join(pivots, "token").where((F.col("root") != F.col("pivot_root")) & _fits(percent))
    met = met.groupBy("c", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("c").agg(F.max(F.struct("k", "pivot")).alias("best")).select("c", F.col("best.pivot").alias("pivot"))
    return best.select(F.least("c", "pivot").alias("a"), F.greatest("c", "pivot").alias("b")).distinct()


def _all_pairs(rows: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """All pairs of a list in different components whose sizes and bitmaps allow the threshold.

    Lists are dealt to shards of bounded size and compared there as arrays, so
    pairs that cannot link never become rows. A list longer than ``block`` is cut
    into blocks, and every two of its blocks meet in a place of their own.
    """
    sizes = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("k"), F.min("c").alias("a"), F.max("c").alias("b"), F.min("n").alias("n"), F.max("n").alias("other"))
    twos = sizes.where((F.col("k") == 2) & _fits(percent)).select("a", "b")
    cut = rows.join(sizes.where("k > 2").select("token", "k"), "token").withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least("own", other).alias("first"), F.greatest("own", other).alias("second")))
    dealt = cut.select("token", "c", "n", "root", "own", F.inline(F.when(F.col("blocks") > 1, places).otherwise(
        F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"))))))
    dealt = dealt.join(classes.select("c", "short"), "c")
    shard = F.pmod(F.xxhash64("token", "first", "second"), F.lit(_shards(sizes, block)))
    met = dealt.withColumn("shard", shard).groupBy("shard").applyInPandas(_compared(percent), "a long, b long")
    return met.unionByName(twos).distinct()


def _shards(sizes: DataFrame, block: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards for lists of ``k`` members, each of which comes once for every block of its list."""
    dealt = sizes.where("k > 2").agg(F.sum(F.col("k") * F.ceil(F.col("k") / block))).first()[0] or 0
    return max(1, -(-dealt // shard_rows))


def _compared(percent: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "first", "second", "n"], ignore_index=True)
        keys = pdf[["token", "first", "second"]].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(pdf)]])
        ids, n, own = pdf["c"].to_numpy(), pdf["n"].to_numpy(), pdf["own"].to_numpy()
        root = pd.factorize(pdf["root"])[0]
        bits = np.frombuffer(b"".join(pdf["short"]), np.uint64).reshape(len(pdf), -1)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start, end in zip(edges[:-1], edges[1:]):
            across = keys[start, 1] != keys[start, 2]  # two blocks: only pairs between them are met here
            for i in range(start, end - 1):
                last = np.searchsorted(n[i + 1:end], n[i] * 100 // percent, "right") + i + 1
                others = np.arange(i + 1, last)
                others = others[(root[others] != root[i]) & ((own[others] != own[i]) | (not across))]
                if len(others):
                    differ = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
                    shared = (n[others] + n[i] - differ) // 2
                    others = others[100 * shared >= percent * (n[others] + n[i] - shared)]
                    left.append(np.full(len(others), ids[i]))
                    right.append(ids[others])
        a, b = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return compare


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps allow the threshold: sets differ in at least as many members as their bitmaps in bits."""
    def run(batches):
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (x, y, n, m) in enumerate(zip(pdf["left"], pdf["right"], pdf["n"], pdf["m"])):
                size = min(len(x), len(y))
                shared = (n + m - int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())) // 2
                keep[i] = 100 * shared >= percent * (n + m - shared)
            yield pdf.loc[keep, ["a", "b"]]

    a = classes.select(F.col("c").alias("a"), "n", F.col("bits").alias("left"))
    b = classes.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("bits").alias("right"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with whether they link, by the shingles of their texts."""
    def run(batches):
        for pdf in batches:
            for first in range(0, len(pdf), 100):
                part = pdf.iloc[first:first + 100]
                left, right = sets_of(as_bytes(part["left"]), words), sets_of(as_bytes(part["right"]), words)
                shared = np.array([len(np.intersect1d(x, y, True)) for x, y in zip(left, right)])
                total = np.array([len(x) + len(y) for x, y in zip(left, right)])
                yield part[["a", "b"]].assign(linked=100 * shared >= percent * (total - shared))

    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = classes.select("c", "doc_id", "version").join(wanted, "c")
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "version"]).groupBy("c").agg(F.first("text").alias("text"))
    a, b = texts.select(F.col("c").alias("a"), F.col("text").alias("left")), texts.select(F.col("c").alias("b"), F.col("text").alias("right"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a long, b long, linked boolean")


def _components(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("b").alias("hi"), F.col("a").alias("lo"))
    return connected_components(edges).select(F.col("node").alias("c"), "root")
