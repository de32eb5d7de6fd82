"""The source audit against plain Python, in one batch and cut into many."""

import re
from collections import Counter, defaultdict

import pytest

from kerbline.llm import divergence
from tests.llm.helpers import seeded


def plain(rows):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in row) for row in rows):
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        groups[lang].add(source)
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= 3]

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, 200)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode()))[:limit], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def rows(rng):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)] + ["É", "é", "漢字", "ZÜge", "züGE", "x" * 300]
    out = []
    for lang, sources, docs in (("en", 9, 300), ("de", 3, 40), ("", 2, 8), (None, 1, 5)):
        for _ in range(docs):
            place = min(rng.randrange(sources), rng.randrange(sources))  # one source holds much more than the others
            some = words[place * 20:] if rng.random() < 0.5 else words
            out.append((" ".join(rng.choice(some) + rng.choice(["", "1", "_", ",\n"]) for _ in range(rng.randint(0, 60))), lang, f"s{place}"))
    out += [(None, "en", "empty"), ("", "en", None), ("123 !", "none", "s1"), ("only once here", "none", "s2"), ("same same", "two", "s1")] + [("repeat Me", "rep", "a")] * 4
    out += [("the " * 30_000 + "end", "en", "long"), (None, None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_plain_python(spark, monkeypatch, small):
    if small:
        for name, value in (("ENTRIES", 50), ("STRETCH", 40), ("BLOCK", 2), ("PACK", 3), ("CELLS", 7)):
            monkeypatch.setattr(divergence, name, value)
    given = rows(seeded(13))
    table = spark.createDataFrame([(*r, "kept", 1) for r in given], "text string, lang string, source string, term string, n int").repartition(6)
    if small:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in divergence.audit(table).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(given)


def test_without_documents(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    found = divergence.audit(empty)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and found.collect() == []


def test_node_and_ancestor_meet_once(spark):
    """Terms that begin with the same counts share the nodes, however many they are."""
    import numpy as np

    langs, offsets = np.zeros(4, int), np.array([0, 6, 15, 24, 30])
    values = np.array([0, 5, 1, 1, 6, 1, 0, 5, 1, 1, 6, 1, 2, 7, 1, 0, 5, 1, 1, 6, 1, 2, 8, 1, 0, 5, 1, 1, 9, 1])
    nodes = [(depth, first.tolist(), terms.tolist()) for depth, first, terms in divergence._tree(langs, offsets, values, np.array([10, 20, 30, 40]))]
    assert nodes == [(0, [0], [100]), (1, [0, 3], [60, 40]), (2, [1, 2], [20, 30])]
