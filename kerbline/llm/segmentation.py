"""SentencePiece encoding and decoding with the n best segmentations of a text.

The lattice of a text has an arc for every piece of the vocabulary that matches,
and byte pieces for characters outside it. Pieces never cross from one word into
the next (a piece holds the word mark only at its front, which is checked), nor
from a letter into most punctuation (the marks for which that holds are found in
the vocabulary), so the lattice is a chain of small lattices, here called words. Each word's forward Viterbi scores are
exact heuristics for a backward A-star search that yields its segmentations, best
first. Among the n best of a text only the n - 1 words whose second choice costs
least can deviate, hence the search runs on those alone.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import small_batches
from kerbline.llm.language_id import Index
from kerbline.llm.vector_codes import _spans

MARK = "▁"
LETTER = r"[^\W\d_]"
BEST = 4
CACHED_WORDS = 400_000
CACHED_CHOICES = 50_000
GROUP_CHARS = 150_000    # texts whose new words are looked at together
SHORT = 40               # characters of a word that goes through the arrays
TOGETHER = 16_384        # words that do so at once
UNKNOWN = 10.0         # a byte piece costs this much more than the dearest piece
RARE = -1e8            # pieces scored below this stand apart from the usual scores

Segmentation = tuple[float, tuple[int, ...]]


class Pieces:
    """The vocabulary of a SentencePiece model, its segmentations and its decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary: dict[str, tuple[float, int]] = {}
        self.bytes_of, byte_ids = [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.vocabulary[piece] = (model.get_score(i), i)
        if any(MARK in p.lstrip(MARK) for p in self.vocabulary):
            raise ValueError("a piece crosses words; this model has no chain of word lattices")
        # The pieces as a tree of characters: (score, id, what follows) of every beginning; id -1 if it is no piece itself.
        self.tree: dict[str, tuple[float, int, dict | None]] = {}
        for piece in sorted(self.vocabulary, key=len):
            self._plant(piece)
        joined = set(re.findall(f"(?<={LETTER})[^\\w{MARK}]", "\n".join(self.vocabulary)))
        apart = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and c not in joined)
        rest = f"(?:[^{MARK}{apart}]+|(?<!{LETTER})[{apart}])" if apart else f"[^{MARK}]+"
        self.words = re.compile(f"{MARK}*{rest}+|[{apart}]{rest}*|{MARK}+" if apart else f"{MARK}*{rest}|{MARK}+")
        self.longest = max(map(len, self.vocabulary))
        self.byte_ids, self.byte_score = byte_ids, min(s for s, _ in self.vocabulary.values() if s > RARE) - UNKNOWN
        self.arrays = self._arrays()
        self.spelling = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.letters = np.array(list(map(len, self.bytes_of)))
        self.spelt_at = np.cumsum(self.letters) - self.letters
        self.known = _Words(self)
        self.choices: dict[tuple[str, int], list[Segmentation]] = {}

    def _plant(self, piece: str) -> None:
        """Add a piece to the tree; shorter ones are in it already."""
        following = self.tree
        for n, c in enumerate(piece, 1):
            score, number, below = following.get(c, (0.0, -1, None))
            if n == len(piece):
                following[c] = (*self.vocabulary[piece], below)
                return
            if below is None:
                following[c] = (score, number, below := {})
            following = below

    def arcs(self, word: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the arcs that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            found = self.vocabulary.get(word[start:end])
            if found:
                yield start, found[0], (found[1],)
        if word[end - 1] not in self.vocabulary:
            raw = word[end - 1].encode("utf-8", "surrogatepass")
            yield end - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)

    def forward(self, word: str) -> tuple[list[float], list[float], list[tuple[int, int | tuple[int, ...]]]]:
        """Best and second best score of every prefix, and the last arc of the best."""
        none, size = float("-inf"), len(word)
        best, second, last = [0.0] + [none] * size, [none] * (size + 1), [(0, 0)] * (size + 1)
        tree = self.tree
        for start in range(size):
            here, next_here, end, following, alone = best[start], second[start], start, tree, False
            for c in word[start:start + self.longest]:
                node = following.get(c)
                if node is None:
                    break
                gain, piece, following = node
                end += 1
                if piece >= 0:
                    score, known = here + gain, best[end]
                    if score > known:
                        second[end] = known if known > next_here + gain else next_here + gain
                        best[end], last[end] = score, (start, piece)
                    elif score > second[end]:
                        second[end] = score
                    alone = alone or end == start + 1
                if following is None:
                    break
            if not alone:  # a character that is no piece
                raw, end = word[start].encode("utf-8", "surrogatepass"), start + 1
                gain = self.byte_score * len(raw)
                score = here + gain
                if score > best[end]:
                    second[end] = max(best[end], next_here + gain)
                    best[end], last[end] = score, (start, tuple(self.byte_ids[b] for b in raw))
                elif score > second[end]:
                    second[end] = score
        return best, second, last

    def best_of(self, word: str) -> tuple[bytes, float, float]:
        """(ids, score, cost of the second choice) of a word."""
        best, second, last = self.forward(word)
        ids, end = [], len(word)
        while end:
            end, piece = last[end]
            ids.append(piece) if isinstance(piece, int) else ids.extend(reversed(piece))
        ids.reverse()
        return array("I", ids).tobytes(), best[-1], best[-1] - second[-1]

    def _arrays(self) -> tuple[np.ndarray, Index, np.ndarray, np.ndarray, np.ndarray]:
        """The tree of pieces as arrays: node of a first character, index of (node, character), node there, score and id of a node."""
        first, steps, below, score, number = np.zeros(0x110000, np.int32), [], [], [0.0], [-1]
        waiting = [(0, self.tree)]
        for node, following in waiting:
            for c, (gain, piece, further) in following.items():
                child = len(score)
                score.append(gain)
                number.append(piece)
                if node:
                    steps.append(node << 21 | ord(c))
                    below.append(child)
                else:
                    first[ord(c)] = child
                if further:
                    waiting.append((child, further))
        for byte in range(1, 128):  # characters of one byte that are no pieces: their byte piece
            if chr(byte) not in self.vocabulary:
                if not first[byte]:
                    first[byte] = len(score)
                    score.append(0.0)
                    number.append(-1)
                score[first[byte]], number[first[byte]] = self.byte_score, self.byte_ids[byte]
        return first, Index(np.array(steps, np.int64)), np.array(below, np.int64), np.array(score), np.array(number)

    def learn(self, words: set[str]) -> None:
        """Remember ``best_of`` of words never met before, many at a time.

        The Viterbi steps are those of ``forward``, taken for all words of a block
        together: arcs by their start, then by their length. Long words and words
        with a character of several bytes that is no piece are left to ``forward``.
        """
        first, index, below, score, number = self.arrays
        short = sorted((w for w in words if w not in self.known.places and len(w) <= SHORT and "\0" not in w), key=len)
        for i in range(0, len(short), TOGETHER):
            block = short[i:i + TOGETHER]
            size = np.array(list(map(len, block)))
            codes = np.array(block, f"<U{size[-1]}").view(np.uint32).reshape(len(block), -1)
            alone = ((number[first[codes]] >= 0) | (codes == 0)).all(1)
            block, size, codes = [w for w, a in zip(block, alone) if a], size[alone], codes[alone].T.astype(np.int64)
            if not block:
                continue
            n, longest = len(block), int(size[-1])
            best, second = np.full((longest + 1, n), -np.inf), np.full((longest + 1, n), -np.inf)
            start, piece = np.zeros((longest + 1, n), np.int64), np.zeros((longest + 1, n), np.int64)
            best[0] = 0.0
            for at in range(longest):
                rows = np.arange(np.searchsorted(size, at, "right"), n)  # words that go on: sizes ascend
                node, end = first[codes[at, rows]].astype(np.int64), at + 1
                while len(rows):
                    arc = number[node] >= 0
                    own, here = rows[arc], node[arc]
                    gain, known = score[here], best[end, own]
                    total = best[at, own] + gain
                    better = total > known
                    second[end, own] = np.where(better, np.maximum(known, second[at, own] + gain), np.maximum(second[end, own], total))
                    best[end, own] = np.where(better, total, known)
                    start[end, own[better]], piece[end, own[better]] = at, number[here[better]]
                    on = size[rows] > end
                    rows, node = rows[on], node[on]
                    step = index.find(node << 21 | codes[end, rows]) if len(rows) else rows
                    rows, node, end = rows[step >= 0], below[step[step >= 0]], end + 1
            everyone, at, ids, there = np.arange(n), size.copy(), [], []
            while at.any():
                ids.append(piece[at, everyone])
                there.append(at > 0)
                at = start[at, everyone]
            ids, there = np.array(ids[::-1]).T, np.array(there[::-1]).T
            rows = size, everyone
            self.known.add(block, ids[there].astype(np.uint32), there.sum(1), best[rows], best[rows] - second[rows])

    def words_of(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def segmentations(self, word: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations of a word, best first: A-star from its end."""
        best, _, _ = self.forward(word)
        # A path is a chain of cells (ids, rest), so long words share their ends. Of equal paths the furthest is followed first.
        found, queue, order = [], [(-best[-1], 0, len(word), 0.0, None)], 0
        while queue and len(found) < n:
            _, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, score, arc in self.arcs(word, at):
                order -= 1
                heapq.heappush(queue, (-(best[start] + score + behind), order, start, score + behind, (arc, path)))
        return found

    def table(self, words: set[str]) -> _Table:
        """What is known of some words, as arrays under a number for each."""
        known = self.known
        at = np.fromiter(map(known.place, words), np.int64, len(words))
        counts = known.counts[at]
        return _Table(dict(zip(words, range(len(words)))), known.ids[_spans(known.starts[at], counts)], np.cumsum(counts) - counts, counts,
                      known.scores[at], known.costs[at])

    def n_best(self, text: str, n: int, words: list[str] | None = None, table: _Table | None = None) -> list[tuple[float, bytes, bool]]:
        """(score, ids as 32-bit numbers, whether ``decode`` makes the text of them) of the ``n`` best segmentations of a text.

        An empty text has one, without pieces. ``words`` are the text's and ``table`` holds them, if both are known already.
        """
        if not text:
            return [(0.0, b"", True)]
        if words is None:
            self.known.forget()
            words = self.words_of(text)
            table = self.table(set(words))
        if len(self.choices) > CACHED_CHOICES:
            self.choices.clear()
        numbers = np.fromiter(map(table.number.__getitem__, words), np.int64, len(words))
        total, costs, counts = float(table.scores[numbers].sum()), table.costs[numbers], table.counts[numbers]
        ids, ends = table.ids[_spans(table.starts[numbers], counts)], np.cumsum(counts)
        loose = np.arange(len(costs))
        if len(costs) > n - 1 > 0:
            loose = np.flatnonzero(costs <= np.partition(costs, n - 2)[n - 2])
        loose = [int(i) for i in loose[np.argsort(costs[loose], kind="stable")][:n - 1] if costs[i] != np.inf]
        # Combine the loose words' choices, cheapest first; choices[k] = (costs, segmentations) of the k-th loose word.
        choices = []
        for i in loose:
            found = self.choices.get((words[i], n))
            if found is None:  # of equally good ones, the Viterbi path comes first
                own = tuple(ids[ends[i] - counts[i]:ends[i]].tolist())
                found = [(float(table.scores[numbers[i]]), own), *(o for o in self.segmentations(words[i], n) if o[1] != own)][:n]
                if len(words[i]) < 32:
                    self.choices[words[i], n] = found
            choices.append(found)
        queue, seen, out = [(0.0, (0,) * len(loose))], {(0,) * len(loose)}, []
        while queue and len(out) < n:
            cost, picks = heapq.heappop(queue)
            parts, at = [], 0
            for i, options, pick in sorted(zip(loose, choices, picks)):
                if pick:
                    parts += [ids[at:ends[i] - counts[i]], np.array(options[pick][1], np.uint32)]
                    at = ends[i]
            whole = np.concatenate([*parts, ids[at:]])
            out.append((total - cost, whole.tobytes(), self.decode(whole) == text))
            for k, options in enumerate(choices):
                if picks[k] + 1 < len(options):
                    further = picks[:k] + (picks[k] + 1,) + picks[k + 1:]
                    if further not in seen:
                        seen.add(further)
                        heapq.heappush(queue, (cost + options[picks[k]][0] - options[picks[k] + 1][0], further))
        return out

    def decode(self, ids) -> str:
        """The text of ids; the mark put before every text is taken off again."""
        ids = np.asarray(ids, np.int64)
        raw = self.spelling[_spans(self.spelt_at[ids], self.letters[ids])].tobytes()
        return raw.decode("utf-8", "replace")[1:] if raw.startswith(b" ") else raw.decode("utf-8", "replace")


@dataclass(frozen=True)
class _Table:
    """Words by number: their ids, one after the other, scores, and costs of the second choice."""

    number: dict[str, int]
    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    scores: np.ndarray
    costs: np.ndarray


class _Words:
    """Remembered results of ``best_of``: a place for every word, and arrays by place. When it is full, all is forgotten."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.size = self.used = 0  # places and ids in use; the arrays have room for more
        self.ids, self.starts, self.counts = np.zeros(1024, np.uint32), np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.scores, self.costs = np.zeros(256), np.zeros(256)

    def __contains__(self, word: str) -> bool:
        return word in self.places

    def place(self, word: str) -> int:
        found = self.places.get(word)
        if found is None:
            ids, score, cost = self.pieces.best_of(word)
            self.add([word], np.frombuffer(ids, np.uint32), np.array([len(ids) // 4]), np.array([score]), np.array([cost]))
            found = self.size - 1
        return found

    def add(self, words: list[str], ids: np.ndarray, counts: np.ndarray, scores: np.ndarray, costs: np.ndarray) -> None:
        """New words, with their ids one after the other."""
        size, used = self.size + len(words), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(used, np.uint32)])
        if size > len(self.starts):
            self.starts, self.counts, self.scores, self.costs = (
                np.concatenate([x[:self.size], np.zeros(size, x.dtype)]) for x in (self.starts, self.counts, self.scores, self.costs))
        own = slice(self.size, size)
        self.ids[self.used:used] = ids
        self.starts[own], self.counts[own] = self.used + np.cumsum(counts) - counts, counts
        self.scores[own], self.costs[own] = scores, costs
        self.places.update(zip(words, range(self.size, size)))
        self.size, self.used = size, used

    def forget(self) -> None:
        if self.size > CACHED_WORDS:
            self._clear()


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The model, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(documents: DataFrame, model: str, n: int = BEST) -> DataFrame:
    """(doc_id, rank, score, ids): the ``n`` best segmentations of every row's whole text, best first.

    A null or empty text has one segmentation without pieces; a text with fewer
    segmentations gives fewer rows; repeated rows are encoded as often as they come.
    """
    return _rows(documents, model, n, "doc_id string, rank int, score double, ids array<int>", lambda score, ids, exact: (score, memoryview(ids).cast("I").tolist()))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with its column ``ids`` (null: empty) decoded into ``text``; null ids and null items decode to nothing."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        own = pieces(model)
        return pd.Series([own.decode([int(i) for i in ids if i is not None and i == i]) if ids is not None else "" for ids in column], dtype=object)

    small_batches(encoded.sparkSession)
    return encoded.withColumn("text", text_of("ids"))


def digest(documents: DataFrame, model: str, n: int = BEST) -> DataFrame:
    """(doc_id, rank, n_pieces, score, ids_crc32, exact): as ``encode``, with a checksum instead of the ids.

    ``exact`` says whether decoding gives the text back; only texts that hold the word mark itself lose it.
    """
    schema = "doc_id string, rank int, n_pieces long, score double, ids_crc32 long, exact boolean"

    def summary(score: float, ids: bytes, exact: bool) -> tuple:
        return len(ids) // 4, score, zlib.crc32(ids), exact

    return _rows(documents, model, n, schema, summary)


def _groups(texts: list[str]) -> Iterator[range]:
    """Runs of texts of bounded size, or of one text."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= GROUP_CHARS):
            size += len(texts[last])
            last += 1
        yield range(first, last)
        first = last


def _rows(documents: DataFrame, model: str, n: int, schema: str, summary) -> DataFrame:
    small_batches(documents.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def segment(batches):
        own = pieces(model)
        for pdf in batches:
            texts = [text if isinstance(text, str) else "" for text in pdf["text"]]
            for group in _groups(texts):
                own.known.forget()
                words = [own.words_of(texts[i]) for i in group]
                distinct = set().union(*words)
                own.learn(distinct)
                table = own.table(distinct)
                out = [(pdf["doc_id"].iloc[i], rank, *summary(*found)) for i, w in zip(group, words) for rank, found in enumerate(own.n_best(texts[i], n, w, table), 1)]
                yield pd.DataFrame(out, columns=names)

    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(segment, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
