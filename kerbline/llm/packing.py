"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids; only those longer than a sequence are cut. Their
pieces are dealt to seas of bounded size. In a sea a population of groupings
evolves: a child inherits one parent's bins, receives well-filled bins of another,
loses the bins that now hold duplicates, and the displaced pieces are put back by
best fit. A sea whose grouping is as good as its total length allows is done. The
others become rings of islands, each a task of its own with its own population;
after every migration the elite grouping of an island travels to the next one as
whole bins and breeds there. The best island of the ring counts. Nearly full bins
are then final; the remaining pieces are dealt to new seas, so that space left over
in one is filled from the rest.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import as_bytes, small_batches
from kerbline.session import Written

CAPACITY = 4096
END_ID = 1
ISLAND_PIECES = 4_000
EPOCHS = 3
FULL = 0.998           # a bin at least this full is final before the last epoch
POPULATION, GENERATIONS = 4, 10
RING, MIGRATIONS = 3, 3  # islands of a ring, and rounds of generations on them
CACHED_WORDS = 500_000
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_WIDE = np.dtype("<u4")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of each row's whole text, cut only above ``capacity``.

    A null text is empty and gives the end id alone. Repeated rows are packed as often as they come.
    """
    small_batches(documents.sparkSession)

    def cut(batches):
        encode = _encoder(tokenizer)
        end = np.array([end_id], _WIDE).tobytes()
        for pdf in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(pdf["doc_id"], encode.texts(pdf["text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.assign(doc_id=pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64"))

    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(cut, PIECE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` (at least doc_id, piece, start, length, ids_crc32) with sequence_id and a gapless offset.

    Lengths must be between 1 and ``capacity``. Every row is placed exactly once; equal rows are different pieces.
    ``generations`` tells how many generations the sea of a piece ran (0: plain best fit was as good as can be),
    ``saved`` how many sequences fewer than best fit it came out with.
    """
    written = Written(pieces.sparkSession, "packing")
    columns = pieces.columns
    items = written.keep(pieces.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("item")))
    waiting, placed = items.select("item", F.col("row.length").alias("length")), None
    for epoch in range(epochs):
        islands = max(1, math.ceil(waiting.count() / island_pieces))
        last = epoch == epochs - 1 or islands == 1
        sea = F.pmod(F.xxhash64("item", F.lit(epoch)), F.lit(islands)).cast("long")
        evolved = waiting.withColumn("sea", sea).groupBy("sea").applyInPandas(_evolve(capacity, epoch, last), f"{_PLACED}, sea long, bin int, plain int, open boolean")
        evolved = written.keep(evolved)
        unsolved = evolved.where("open")
        if not unsolved.isEmpty():
            settled = _migrated(unsolved, capacity, epoch, written).groupBy("sea").applyInPandas(_settle(capacity, epoch, last), _PLACED)
            evolved = written.keep(evolved.where("NOT open").select(settled.columns).unionByName(settled))
        final = evolved.where("sequence_id >= 0").select("item", "sequence_id", "offset", "generations", "saved")
        placed = final if placed is None else placed.unionByName(final)
        if last:
            break
        waiting = evolved.where("sequence_id < 0").select("item", "length")
    return items.join(placed, "item").select("row.*", "sequence_id", "offset", "generations", "saved")


class _Encoder(dict):
    """Ids of texts, as bytes. White space always separates tokens here, so words are encoded once and remembered.

    Words are UTF-8 in which ASCII letters are lower case, as the tokenizer makes
    them. Punctuation behind a letter is a token of its own, so a word and its
    punctuation are remembered apart. When too many words are remembered, those
    not met for longest are forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.older = Tokenizer.from_file(path), {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            stem = word.rstrip(_PUNCTUATION)
            # The last letter must still be one in lower case: one letter becomes a letter and an accent of its own.
            if 0 < len(stem) < len(word) and b"<" not in word and (
                    stem[-1] in _LETTERS or stem.decode("utf-8", "surrogatepass")[-1].lower()[-1].isalpha()):
                return self[stem] + self[word[len(stem):]]  # not remembered itself: its parts are met more often
            coded, = self.model.encode_batch_fast([word.decode("utf-8", "surrogatepass")], add_special_tokens=False)
            found = array("I", coded.ids).tobytes()
        self[word] = found
        return found

    def texts(self, texts) -> list[bytes]:
        out = []
        for text in as_bytes(texts):
            # Special tokens are told by their case, so words that may hold one are left as they are.
            words = text.lower().split() if b"<|" not in text else [w if b"<|" in w else w.lower() for w in text.split()]
            out.append(b"".join(map(self.__getitem__, words)))
            if len(self) > CACHED_WORDS:
                self.older = dict(self)
                self.clear()
        return out


_loaded: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """The tokenizer, loaded once in each worker; its remembered words serve the worker's later tasks too."""
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


_PLACED = "item long, length long, sequence_id long, offset long, generations int, saved int"


def _place(pdf: pd.DataFrame, bins: list[list[int]], lengths: np.ndarray, capacity: int, epoch: int, last: bool) -> pd.DataFrame:
    """Sequence and offset of the pieces of full bins, or of all in the last epoch; -1 for those that go on."""
    sea = int(pdf["sea"].iloc[0])
    sequence, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
    for number, members in enumerate(bins):
        sizes = lengths[members]
        if last or sizes.sum() >= FULL * capacity:
            sequence[members] = (epoch << 58) | (sea << 24) | number
            offset[members] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return pd.DataFrame({"item": pdf["item"], "length": pdf["length"], "sequence_id": sequence, "offset": offset})


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of every position."""
    out = np.zeros(n, np.int32)
    for number, members in enumerate(bins):
        out[members] = number
    return out


def _grouping(labels: np.ndarray) -> list[list[int]]:
    """The positions of every bin."""
    order = np.argsort(labels, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)]


def _evolve(capacity: int, epoch: int, last: bool):
    """A sea's first population: its grouping, and whether a better one could exist."""
    def evolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        lengths = pdf["length"].to_numpy().astype(int)
        bins, plain, run = _search(lengths, capacity, epoch * 1_000_003 + int(pdf["sea"].iloc[0]), [], POPULATION, GENERATIONS)
        return _place(pdf, bins, lengths, capacity, epoch, last).assign(
            generations=run, saved=plain - len(bins), sea=pdf["sea"], bin=_labels(bins, len(pdf)), plain=plain, open=len(bins) > _least(lengths, capacity))

    return evolve


def _migrated(unsolved: DataFrame, capacity: int, epoch: int, written: Written) -> DataFrame:
    """(sea, item, length, bin, generations, plain) of the best island of each sea's ring."""
    start = unsolved.select("sea", "item", "length", F.col("bin").alias("own"), F.col("bin").alias("guest"), "generations", "plain")
    ring = start.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))))
    schema = "sea long, island int, item long, length long, own int, generations int, plain int, bins int, fill double"
    for turn in range(MIGRATIONS):
        people = written.keep(ring.groupBy("sea", "island").applyInPandas(_breed(capacity, epoch, turn), schema))
        # The elite of each island goes to the next one of its ring.
        guests = people.select("sea", ((F.col("island") + 1) % RING).cast("int").alias("island"), "item", F.col("own").alias("guest"))
        ring = people.drop("bins", "fill").join(guests, ["sea", "island", "item"])
    islands = people.groupBy("sea", "island").agg(F.max("bins").alias("bins"), F.max("fill").alias("fill"))
    best = islands.groupBy("sea").agg(F.min_by("island", F.struct("bins", -F.col("fill"), "island")).alias("island"))
    return people.join(best, ["sea", "island"]).select("sea", "item", "length", F.col("own").alias("bin"), "generations", "plain")


def _breed(capacity: int, epoch: int, turn: int):
    """Generations on one island, from its own elite and its neighbour's."""
    def breed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        lengths, sea, island = pdf["length"].to_numpy().astype(int), int(pdf["sea"].iloc[0]), int(pdf["island"].iloc[0])
        elites = [_grouping(pdf[c].to_numpy()) for c in ("own", "guest")]
        bins, _, run = _search(lengths, capacity, ((epoch * MIGRATIONS + turn) * RING + island) * 1_000_003 + sea + 1, elites, POPULATION, GENERATIONS)
        fill = sum((lengths[b].sum() / capacity) ** 2 for b in bins)
        return pdf[["sea", "island", "item", "length"]].assign(
            own=_labels(bins, len(pdf)), generations=pdf["generations"] + run, plain=pdf["plain"], bins=len(bins), fill=float(fill))

    return breed


def _settle(capacity: int, epoch: int, last: bool):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        bins = _grouping(pdf["bin"].to_numpy())
        placed = _place(pdf, bins, pdf["length"].to_numpy().astype(int), capacity, epoch, last)
        return placed.assign(generations=pdf["generations"], saved=pdf["plain"] - len(bins))

    return settle


def _least(lengths: np.ndarray, capacity: int) -> int:
    """No grouping has fewer bins."""
    return math.ceil(lengths.sum() / capacity)


def evolved_bins(lengths: np.ndarray, capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """Groups of positions whose lengths sum to at most ``capacity``, as few as the search finds."""
    return _search(lengths, capacity, seed, [], population, generations)[0]


def _search(lengths: np.ndarray, capacity: int, seed: int, elites: list[list[list[int]]], population: int, generations: int) -> tuple[list[list[int]], int, int]:
    """(best grouping, number of bins of plain best fit, generations run) of a population that ``elites`` belong to."""
    rng = np.random.default_rng(seed)
    size = lengths.tolist()
    order = np.argsort(-lengths, kind="stable")
    plain = best_fit([], order.tolist(), size, capacity)
    people = [*elites, plain][:population]
    for _ in range(population - len(people)):  # nearly decreasing orders give different good groupings
        noisy = lengths * rng.uniform(0.85, 1.15, len(lengths))
        people.append(best_fit([], np.argsort(-noisy, kind="stable").tolist(), size, capacity))
    lower, run = _least(lengths, capacity), 0

    def cost(bins: list[list[int]]) -> tuple[int, float]:
        return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)

    costs = [cost(p) for p in people]
    while run < generations and min(costs)[0] > lower:
        run += 1
        a, b = rng.choice(population, 2, replace=False)
        child = cross(people[a], people[b], size, capacity, rng)
        price, worst = cost(child), max(range(population), key=costs.__getitem__)
        if price < costs[worst]:
            people[worst], costs[worst] = child, price
    return people[min(range(population), key=costs.__getitem__)], len(plain), run


def cross(host: list[list[int]], donor: list[list[int]], size: list[int], capacity: int, rng) -> list[list[int]]:
    """Inject the donor's well-filled bins, drop the host's bins with duplicates, best-fit what they displaced."""
    fills = [sum(size[i] for i in b) for b in donor]
    good = [b for b, fill in zip(donor, fills) if fill >= 0.995 * capacity]
    good = [good[i] for i in rng.permutation(len(good))[: max(1, len(good) // 2)]]
    taken = {i for b in good for i in b}
    kept = [b for b in host if taken.isdisjoint(b)]
    # The emptiest bins are opened as well, so that their pieces can be combined anew.
    kept.sort(key=lambda b: sum(size[i] for i in b), reverse=True)
    kept = kept[: len(kept) - max(1, len(kept) // 10)]
    there = taken.union(i for b in kept for i in b)
    displaced = sorted((i for i in range(len(size)) if i not in there), key=lambda i: -size[i])
    return best_fit(good + kept, displaced, size, capacity)


def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int) -> list[list[int]]:
    """Put each item into the fullest bin that has room for it, else into a new one."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(size[i] for i in b), n) for n, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (size[i], -1))
        if at == len(room):
            left, n = capacity, len(bins)
            bins.append([])
        else:
            left, n = room.pop(at)
        bins[n].append(i)
        bisect.insort(room, (left - size[i], n))
    return bins
