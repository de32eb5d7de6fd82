"""Line dedup, substring dedup and the n-gram join against plain Python."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from kerbline.llm import line_dedup, ngram_join, substring_dedup
from tests.llm.helpers import awkward_documents, components, documents, prose, seeded

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text, lower=False):
    raw = (text or "").encode()
    return SPACE.findall(raw.lower() if lower else raw)


def removed_words(rows, window):
    first = {}
    for i, text, *_ in rows:
        words = words_of(text)
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        words = words_of(text)
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i is None, i or 0, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "shard"), [(1_000, 4_000), (1, 3)])
def test_substrings(spark, hot, shard):
    rows = awkward_documents(seeded(1))
    got = substring_dedup.digest(documents(spark, rows, ("anchor", "version")), hot_segments=hot, shard_segments=shard).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_words(rows, 13)


def test_substrings_of_a_common_passage(spark):
    """One passage in every document, with different words around it."""
    rng = seeded(2)
    passage = prose(rng, 30)
    rows = [(i, f"{prose(rng, 8)} {passage} {prose(rng, 8)}", "s") for i in range(80)]
    got = substring_dedup.digest(documents(spark, rows), hot_segments=4, shard_segments=10).collect()
    assert sorted((False, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_words(rows, 13)


def near_duplicates(rows):
    sets, docs = [], [r for r in rows]
    for _, text, *_ in docs:
        words = words_of(text, lower=True)
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    usable = [k for k, (i, *_) in enumerate(docs) if i is not None]
    links = [(a, b) for a, b in itertools.combinations(usable, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = components(range(len(docs)), links)
    least = {}
    for k in usable:
        least[roots[k]] = min(least.get(roots[k], docs[k][0]), docs[k][0])
    return sorted((docs[k][0] is None, docs[k][0] or 0, len(sets[k]), least[roots[k]] if k in usable else -1) for k in range(len(docs)))


@pytest.mark.parametrize(("rounds", "block"), [(2, 2_000), (0, 3), (1, 2)])
def test_ngram_join(spark, rounds, block):
    rows = awkward_documents(seeded(3))
    got = ngram_join.near_duplicates(documents(spark, rows, ("token", "c", "n")), pivot_rounds=rounds, block=block).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == near_duplicates(rows)


def test_chains_of_near_copies(spark):
    """Neighbours link, ends do not: the component is found through many pairs of one list."""
    rng = seeded(4)
    words = prose(rng, 120).split()
    rows = []
    for i in range(40):
        words = list(words)
        words[(i * 7) % 120] = f"new{i}"
        rows.append((39 - i, " ".join(words), "s"))
    expected = near_duplicates(rows)
    for rounds in (0, 2):
        got = ngram_join.near_duplicates(documents(spark, rows), pivot_rounds=rounds, block=5).collect()
        assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_shards_hold_what_long_lists_deal(spark):
    """A member comes once for each block of its list: 1,000 members in 10 blocks are 10,000 rows."""
    sizes = spark.createDataFrame([(1_000,), (3,), (2,)], "k long")
    assert ngram_join._shards(sizes, 100, 500) == 21
    assert ngram_join._shards(sizes.where("k < 3"), 100, 500) == 1


def kept_lines(rows, shingle=10, least=20):
    first, places = {}, {}
    for i, text, *_ in rows:
        for pos, line in enumerate(text.split("\n") if text is not None and i is not None else ()):
            if len(line) >= least:
                places[line] = min(places.get(line, (i, pos)), (i, pos))
    lines = list(places)
    sets = [{line[k:k + shingle] for k in range(len(line) - shingle + 1)} for line in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = components(range(len(lines)), links)
    for k, line in enumerate(lines):
        first[roots[k]] = min(first.get(roots[k], places[line]), places[line])
    keep = {line: first[roots[k]] for k, line in enumerate(lines)}
    out = []
    for i, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for pos, x in enumerate(lines) if i is None or len(x) < least or keep[x] == (i, pos)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest() if text is not None else ""
        out.append((i is None, i or 0, len(lines), len(lines) - len(kept), digest))
    return sorted(out)


@pytest.mark.parametrize(("rounds", "block"), [(2, 2_000), (0, 2_000), (0, 3)])
def test_fuzzy_lines(spark, rounds, block):
    """Near lines here are well above the threshold, where no band is missed in practice."""
    rng = seeded(5)
    base = [prose(rng, 50) for _ in range(8)]
    rows = []
    for i in range(30):
        lines = [prose(rng, 30)]
        for line in rng.sample(base, 3):
            words = line.split()
            if i % 2:
                words[rng.randrange(len(words))] = f"w{i}"
            lines.append(" ".join(words))
        rows.append((i, "\n".join([*lines, "short", lines[0]]), "s"))
    rows += [(50, "", "s"), (51, None, "s"), (52, "\n\n", "s"), (None, base[0], "s"), (None, None, None), rows[4], rows[4],
             (53, "no-blanks-" * 40, "s"), (54, "no-blanks-" * 40, "s"), (55, "漢字" * 30 + "é", "s"), (56, "x" * 20_000, "s")]
    got = line_dedup.digest(documents(spark, rows, ("line", "lines", "h1")), pivot_rounds=rounds, block=block).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_removed, r.kept_sha256 or "") for r in got) == kept_lines(rows)


def test_lines_that_differ_behind_a_words_tenth_character(spark):
    """The runs at words are equal in both lines; of all runs they share half."""
    rows = [(i, " ".join(f"ab{k:08}{end * 5}" for k in range(6)), "s") for i, end in enumerate("xyz")]
    got = line_dedup.digest(documents(spark, rows)).collect()
    assert sorted((False, r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got) == kept_lines(rows)
    assert all(r.n_removed == 0 for r in got)


def test_near_lines_with_long_words(spark):
    """One character more, where a rule by the number of words would take other runs of the two lines."""
    texts = [" ".join(f"abcdefghijklmn{k}" for k in range(3)) + " abcdefghijklmn34", "https://host.example/a/long/path?key=0123456789 end of line"]
    rows = [(2 * i + k, text + "5" * k, "s") for i, text in enumerate(texts) for k in range(2)]
    got = line_dedup.digest(documents(spark, rows)).collect()
    assert sorted((False, r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got) == kept_lines(rows)
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_runs_of_characters(spark):
    """The same rule for ASCII and other lines, short ones and characters outside the basic plane."""
    texts = ["abc", "0123456789", "01234567890", "é" * 12, "x😀y漢z" * 5, "aé\nb" * 6, " " * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, line string")
    runs = [(n, t[k:k + 10]) for n, t in enumerate(texts) for k in range(max(1, len(t) - 9))]
    wanted = spark.createDataFrame(runs, "n int, run string").select("n", F.xxhash64("run").alias("h")).distinct().collect()
    got = rows.select("n", F.explode(line_dedup._shingles(F.col("line"), 10)).alias("h")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def runs_of(line, n=10):
    return {line[k:k + n] for k in range(max(1, len(line) - n + 1))}


def test_lines_are_signed_in_compiled_code(spark):
    """Interpreted lambdas for every run of every line took two fifths of the time."""
    lines = spark.range(9).selectExpr("id", "concat('one line of some length ', id) AS line")
    plan = line_dedup._signed(lines, 10)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    # Nor does the line go along with each of its parts, which made long lines take time by the square of their length.
    assert all("line#" not in row for row in plan.split("\n") if "HashAggregate" in row)


def test_near_lines_share_a_band(spark):
    """Pairs a little above the threshold: one of some hundred misses all bands."""
    rng, rows = seeded(11), []
    letters = "abcdefghijklmnopqrstuvwxyz éü漢😀"
    for n in range(400):
        line = "".join(rng.choice(letters) for _ in range(rng.choice([95, 100, 150, 190, 300])))
        other = list(line)
        for k in range(len(line) // 95):
            other[95 * k + rng.randrange(40, 60)] = "#"
        other = "".join(other)
        share = len(runs_of(line) & runs_of(other)) / len(runs_of(line) | runs_of(other))
        assert 0.79 < share < 0.9
        rows += [(2 * n, line), (2 * n + 1, other)]
    signed = line_dedup._signed(spark.createDataFrame(rows, "id int, line string"), 10)
    bands = signed.select(F.expr("id div 2").alias("n"), F.explode("bands").alias("band")).groupBy("n", "band").count().where("count > 1")
    assert bands.select("n").distinct().count() >= 390


def test_bitmaps_refuse_no_pair_that_links(spark):
    """Of pairs that link none is refused; most of those that share three fifths or less are."""
    rng, rows = seeded(12), []
    for n in range(800):
        line = "".join(rng.choice("abcdeé漢😀 ") for _ in range(rng.choice([4, 10, 20, 25, 60, 200, 900])))
        cut = rng.randrange(1, max(2, len(line) // rng.choice([2, 8, 15])))
        other = rng.choice([line[cut:], line[:-cut] + "x" * cut, line + line[:cut], line, "x" + line[1:]])
        rows.append((n, line, other))
    lines = [spark.createDataFrame([(r[0], r[k], max(1, len(r[k]) - 9)) for r in rows], "id int, line string, runs int") for k in (1, 2)]
    sides = [line_dedup._bits(x, 10).join(x, "id").select("id", F.struct("bits", "runs").alias(f"s{k + 1}")) for k, x in enumerate(lines)]
    may = {r.id: r.may for r in sides[0].join(sides[1], "id").select("id", line_dedup._may_link(F.col("s1"), F.col("s2"), 80).alias("may")).collect()}
    share = {n: len(runs_of(a) & runs_of(b)) / len(runs_of(a) | runs_of(b)) for n, a, b in rows}
    assert len(may) == 800 and all(may[n] for n in may if share[n] >= 0.8)
    half = [n for n in may if share[n] <= 0.6 and 50 <= len(rows[n][1]) < 500]
    assert len(half) > 10 and sum(may[n] for n in half) < 0.2 * len(half)


def test_lines_with_few_and_many_runs(spark):
    """Lines around the number of runs that one row hashes, over several partitions: their bands only follow from their runs."""
    texts = ["é" + "abc de" * k + "xyz"[: k % 4] for k in range(2, 20)]
    texts += [t + t for t in ("0123456789" * 4, "漢字かな" * 9)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    first = {texts[r.id]: r.bands for r in line_dedup._signed(frame, 10).collect()}
    marks = line_dedup.MARKS
    wanted = {}
    for t in texts:
        hashes = [r.h for r in spark.createDataFrame([(x.encode("utf-32-be"),) for x in runs_of(t)], "x binary").select(F.xxhash64("x").alias("h")).collect()]
        least = [min((h ^ m) for h in hashes) for m in marks]
        wanted[t] = least
    rows = spark.createDataFrame(list(wanted.items()), "line string, m array<long>")
    bands = [F.xxhash64(F.lit(n), *[F.get("m", F.lit(n + 8 * k)) for k in range(3)]) for n in range(8)]
    assert {r.line: r.bands for r in rows.select("line", F.array(*bands).alias("bands")).collect()} == first


def test_other_columns_stay(spark):
    rows = awkward_documents(seeded(6), 10)
    df = documents(spark, rows, ("row", "_id", "_version", "_starts", "gone"))
    for done in (substring_dedup.without_repeats(df), line_dedup.without_fuzzy_lines(df)):
        assert done.columns[:-1] == df.columns
        key = lambda r: str(r[:3])
        assert sorted(map(tuple, done.select(df.columns).collect()), key=key) == sorted(map(tuple, df.collect()), key=key)


def test_no_documents(spark):
    none = documents(spark, [])
    assert substring_dedup.digest(none).collect() == ngram_join.near_duplicates(none).collect() == line_dedup.digest(none).collect() == []
    nothing = documents(spark, [(None, None, None), (1, None, None), (2, "", None)])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(nothing).collect()} == {(None, 0, None), (1, 0, 1), (2, 0, 2)}
