import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kerbline.llm import catalog, packing
from tests.llm.helpers import awkward_documents, documents, seeded

PATH = catalog.tokenizer_path("word_bpe_49k.json")


def expected_pieces(rows, capacity):
    model, out = Tokenizer.from_file(PATH), []
    for doc_id, text, *_ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc_id is None, doc_id or 0, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


@pytest.mark.parametrize(("capacity", "island"), [(4096, 4_000), (300, 25)])
def test_every_token_once(spark, capacity, island):
    rows = awkward_documents(seeded(1)) + [(600, "it's ISN'T a,b.c!! <|ENDOFTEXT|> <|endoftext|>x É İ, ①, ⅷ. Σ ΑΣ, ﬁ", "s")]
    pieces = packing.token_pieces(documents(spark, rows, ("item", "island", "row")), PATH, capacity)
    got = packing.pack(pieces, capacity, island_pieces=island).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(rows, capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:k]) for k in range(len(members))]
        assert sum(n for _, n in members) <= capacity
    assert len(sequences) <= np.ceil(sum(r.length for r in got) / capacity) * 1.1 + 2


def test_few_sequences(spark):
    got = catalog.op4_bestfit_packing(spark, "/root/testdata/sf0.01").toPandas()
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 4096) + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 700, 400)
    order = np.argsort(-sizes).tolist()
    a, b = (packing.best_fit([], o, sizes.tolist(), 1000) for o in (order, rng.permutation(400).tolist()))
    child = packing.cross(a, b, sizes.tolist(), 1000, rng)
    assert sorted(i for bin in child for i in bin) == list(range(400))
    assert all(sum(sizes[i] for i in bin) <= 1000 for bin in child)
    evolved = packing.evolved_bins(sizes, 1000, seed=1)
    assert len(evolved) <= len(a) and sorted(i for bin in evolved for i in bin) == list(range(400))


def test_nothing_to_pack(spark):
    assert packing.pack(packing.token_pieces(documents(spark, []), PATH)).collect() == []


def test_remembered_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder, model = packing._Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ["one two three four five six, seven.", "one two eight! nine? ten", "six seven, one"] * 2:
        assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def hard_pieces(spark, n=260):
    """Lengths of which few combinations fill a sequence, so that best fit is not as good as can be."""
    rng = seeded(3)
    rows = [(i, 0, 0, rng.randint(260, 510), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, packing.PIECE).repartition(3)


def test_elites_migrate_on_rings(spark, monkeypatch):
    """Hard lengths go through generations on islands; no piece is lost, and no sequence more than best fit's is used."""
    rows, table = hard_pieces(spark)
    guests, breed = [], packing._breed
    monkeypatch.setattr(packing, "_breed", lambda *given: guests.append(given) or breed(*given))
    got = packing.pack(table, 1000, island_pieces=130, epochs=1).toPandas()
    assert len(guests) == packing.MIGRATIONS and sorted(got["doc_id"]) == list(range(260))
    sums = got.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 1000
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.concatenate([[0], np.cumsum(own["length"])[:-1]]).tolist()
    assert (got["generations"] >= packing.GENERATIONS).any() and (got["saved"] >= 0).all()
    best = len(packing.best_fit([], np.argsort([-r[3] for r in rows], kind="stable").tolist(), [r[3] for r in rows], 1000))
    assert len(sums) <= best + 2  # two seas, each with at most one open sequence


def test_a_guest_takes_over_a_poor_island():
    """The neighbour's whole bins enter the population, so an island is never worse than the elite it received."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(260, 510, 60)
    good = packing.evolved_bins(lengths, 1000, seed=2, generations=60)
    frame = packing.pd.DataFrame({"sea": 0, "island": 1, "item": range(60), "length": lengths, "own": range(60),
                                  "guest": packing._labels(good, 60), "generations": 4, "plain": 40})
    out = packing._breed(1000, 0, 0)(frame)
    assert out["bins"].iloc[0] <= len(good) and (out["generations"] >= 4).all()
    assert max(lengths[b].sum() for b in packing._grouping(out["own"].to_numpy())) <= 1000
    assert sorted(map(sorted, packing._grouping(packing._labels(good, 60)))) == sorted(map(sorted, good))


def test_easy_lengths_need_no_generation(spark):
    got = catalog.op4_bestfit_packing(spark, "/root/testdata/sf0.001").toPandas()
    assert set(got["saved"]) == {0} and got["generations"].max() <= packing.GENERATIONS * (1 + packing.MIGRATIONS)
