"""Small tables with awkward rows, and plain-Python versions of the operators."""

import random

WORDS = "the of and to in is on that it was for with as his they be at one have this".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "er", "ing", str(rng.randint(0, 400))]) for _ in range(n))


def awkward_documents(rng, n=60):
    """(doc_id, text, source): nulls in every column, empty, short and very long texts, exact and near copies, repeated rows."""
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{i % 3}") for i in range(n)]
    base = prose(rng, 150)
    rows += [(100 + i, base, "hot") for i in range(12)]
    for i in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 99)}"
        rows.append((200 + i, " ".join(words), None))
    passage = prose(rng, 60)
    rows += [(300 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40), "s1") for i in range(6)]
    rows += [(400, "", "s"), (401, None, "s"), (402, "   \n\t ", "s"), (403, "One two three", "s"), (404, "one TWO three", "s"),
             (405, "long " + prose(rng, 6000), "s"), (406, "É é ß 漢字 " + prose(rng, 20), "s"), (None, base, "s"), (None, None, None)]
    rows += [rows[3], rows[3], (500, "x" * 30_000, "s"), (7, prose(rng, 30), "same id")]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, extra=()):
    """With columns whose names operators might use themselves."""
    schema = "doc_id long, text string, source string" + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame([(*row, *("kept" for _ in extra)) for row in rows], schema)


def components(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def seeded(seed):
    return random.Random(seed)
