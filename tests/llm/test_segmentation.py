import pytest

from kerbline.llm import catalog, segmentation
from kerbline.llm.segmentation import MARK, Pieces
from tests.llm.helpers import awkward_documents, documents, seeded

PATH = catalog.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


def all_segmentations(model, text):
    out = []

    def walk(at, score, ids):
        if at == 0:
            out.append((score, ids))
        else:
            for start, gain, arc in model.arcs(text, at):
                walk(start, score + gain, arc + ids)

    walk(len(text), 0.0, ())
    return out


@pytest.mark.parametrize("text", ["Hello", "the cat sat", "a  b\n①x", "é", MARK, " ", "aaaaaaaa", "ab ab"])
def test_n_best_is_exact(model, text):
    every = all_segmentations(model, MARK + text.replace(" ", MARK))
    best = sorted((score for score, _ in every), reverse=True)[:6]
    got = model.n_best(text, 6)
    assert [score for score, _, _ in got] == pytest.approx(best)
    ids = [tuple(memoryview(i).cast("I")) for _, i, _ in got]
    assert len(set(ids)) == len(ids)
    assert {(round(s, 3), i) for (s, _, _), i in zip(got, ids)} <= {(round(s, 3), i) for s, i in every}
    assert all(exact == (MARK not in text) and (not exact or model.decode(i) == text) for (_, _, exact), i in zip(got, ids))


def test_rows(spark):
    rows = awkward_documents(seeded(1))
    df = documents(spark, rows, ("ids", "rank"))
    encoded = segmentation.encode(df, PATH, 3)
    back = segmentation.decode(encoded, PATH).collect()
    firsts = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back if r.rank == 1)
    assert firsts == sorted((i is None, i or 0, t or "") for i, t, _ in rows)
    assert all(r.rank <= 3 for r in back)
    summary = segmentation.digest(df, PATH, 3).collect()
    assert sorted((r.doc_id or 0, r.rank, r.n_pieces) for r in summary) == sorted((r.doc_id or 0, r.rank, len(r.ids)) for r in back)
    assert all(r.exact for r in summary)


def test_nothing_to_encode(spark):
    assert segmentation.digest(documents(spark, []), PATH).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, [])], "i int, ids array<int>")
    assert {r.text for r in segmentation.decode(odd, PATH).collect()} == {""}


def test_forgetting_words_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(segmentation, "CACHED_WORDS", 4)
    small = Pieces(PATH)
    for text in ["one two three four five", "six seven one two", "one"] * 3:
        assert small.n_best(text, 4) == model.n_best(text, 4)


def test_words_learned_together_are_those_learned_alone(model, monkeypatch):
    """Blocks of words give the ids, scores and second choices of the plain Viterbi steps."""
    rng = seeded(4)
    letters = "etaoin shrdlu\n\té漢0A.,-" + MARK
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))).replace(" ", MARK) for _ in range(3000)}
    words |= {MARK + w for text in ("the quick brown fox", "internationalization of something") for w in text.split()} | {"x" * 39, "x" * 200, "\0a", "a\0"}
    monkeypatch.setattr(segmentation, "TOGETHER", 500)
    fresh = Pieces(PATH)
    fresh.learn(words)
    known = fresh.known
    assert known.size == len(known.places) > 1500
    for word, i in known.places.items():
        ids = known.ids[known.starts[i]:known.starts[i] + known.counts[i]].tobytes()
        assert (ids, known.scores[i], known.costs[i]) == model.best_of(word), word


def test_group_size_changes_nothing(spark, monkeypatch):
    df = documents(spark, awkward_documents(seeded(2))).coalesce(1)
    whole = sorted(map(str, segmentation.digest(df, PATH, 4).collect()))
    own, texts = Pieces(PATH), [r.text or "" for r in df.collect()]
    monkeypatch.setattr(segmentation, "GROUP_CHARS", 50)
    for group in segmentation._groups(texts):
        assert list(group) and (len(group) == 1 or sum(len(texts[i]) for i in group) <= 50)
    assert [i for g in segmentation._groups(texts) for i in g] == list(range(len(texts)))
    found = [(r, *own.n_best(text, 4)[r - 1][:1]) for text in texts for r in range(1, len(own.n_best(text, 4)) + 1)]
    assert len(found) == len(whole)
