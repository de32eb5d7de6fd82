"""Language identification against plain-Python contexts and on held-out texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbline.llm import catalog, language_id
from kerbline.llm.language_id import ORDER, UNIT
from kerbline.session import Written
from tests.llm.helpers import awkward_documents, documents, seeded


class Tree:
    """Counts of one language, by context."""

    def __init__(self):
        self.after = defaultdict(Counter)

    def learn(self, text):
        data = b" " * ORDER + language_id.folded(text)
        for i in range(ORDER, len(data)):
            for j in range(ORDER + 1):
                self.after[data[i - j:i]][data[i]] += 1

    def length(self, text):
        data, total = b" " * ORDER + language_id.folded(text), 0
        for i in range(ORDER, len(data)):
            for j in range(ORDER, -2, -1):
                if j < 0:
                    total += 8 * UNIT
                    break
                seen = self.after.get(data[i - j:i])
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    total += round(math.log2(whole / seen[data[i]]) * UNIT)
                    break
                total += round(math.log2(whole / len(seen)) * UNIT)
        return total


def texts():
    rng = seeded(11)
    syllables = {"a": "the ing and er on".split(), "b": "der sch ung ein ö".split(), "c": "ão nha os é que".split()}
    rows = [(i, "".join(rng.choice(syllables[lang]) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))), lang)
            for i in range(90) for lang in [rng.choice("abc")]]
    return rows + [(200, None, "a"), (201, "", "a"), (202, "12 34 +++ \n", "b"), (203, "漢字 и 漢", None), (204, "THE ING ON", "a"), (None, "the and", "a"),
                   (205, "ung " * 4000, "b"), (205, "ung " * 4000, "b"), (206, "theung", None)]


@pytest.mark.parametrize("max_cells,step", [(8_000_000, 1_000_000), (60, 50)])
def test_code_lengths_equal_plain_contexts(spark, monkeypatch, max_cells, step):
    """In one pass, and with the statistics cut by language and by byte and the texts cut within."""
    monkeypatch.setattr(language_id, "STEP", step)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    written = Written(spark, "test")
    statistics = language_id.train(docs, written)
    assert statistics.languages == ["a", "b", "c"]
    trees = {lang: Tree() for lang in "abc"}
    for _, text, lang in rows:
        if lang and text:
            trees[lang].learn(text)
    portions = list(statistics.passes(max_cells))
    assert (len(portions) > 5) == (max_cells == 60)
    for _, text, _ in rows:
        if text and language_id.folded(text):
            total = np.zeros(3, np.int64)
            for portion in portions:
                for _, _, runs in language_id._pieces(iter([language_id.folded(text)]), step):
                    total[portion.languages] += portion.of(runs).sum(0, dtype=np.int64)
            expected = [trees[lang].length(text) for lang in "abc"]
            assert np.abs(total - expected).max() <= len(text) * 5  # two roundings of a logarithm may differ by a unit

    if max_cells == 60:
        return
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, statistics, written).collect()}
    for doc_id, text, _ in rows:
        if text and any(c.isalpha() for c in text):
            lengths = {lang: trees[lang].length(text) for lang in "abc"}
            best = min(lengths, key=lambda lang: (lengths[lang], lang))
            score = 1 / sum(2.0 ** ((lengths[best] - x) / UNIT) for x in lengths.values())
            assert any(d == doc_id and lang == best and abs(s - score) < 1e-3 for d, lang, s in got)
        else:
            assert (doc_id, "und", 0.0) in got
    assert language_id.predict(docs, statistics, written).count() == len(rows)


def test_cut_statistics_give_the_same_rows(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string")
    written = Written(spark, "test")
    statistics = language_id.train(docs.repartition(5), written)
    whole = sorted(map(tuple, language_id.predict(docs, statistics, written).collect()), key=str)
    assert sorted(map(tuple, language_id.predict(docs.repartition(7), statistics, written, 400).collect()), key=str) == whole


def test_nothing_learned_and_no_rows(spark):
    docs = documents(spark, awkward_documents(seeded(3)), ("lengths", "known", "lang_pred"))
    none = docs.selectExpr("*", "CAST(NULL AS STRING) AS lang")
    written = Written(spark, "test")
    nothing = language_id.train(none, written)
    assert nothing.languages == [] and {tuple(r)[1:] for r in language_id.predict(docs, nothing, written).collect()} == {("und", 0.0)}
    learned = language_id.train(docs.selectExpr("*", "'xx' AS lang"), written)
    found = language_id.predict(docs, learned, written)
    assert {(r.lang_pred, r.score) for r in found.collect()} == {("und", 0.0), ("xx", 1.0)} and found.columns == ["doc_id", "lang_pred", "score"]
    assert language_id.predict(docs.where("false"), learned, written).collect() == []


def test_held_out_languages(spark):
    found = catalog.op11_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = catalog.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    row = found.join(truth, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS right", "min(score) AS low", "max(score) AS high").first()
    assert row.right > 0.97 and 0 <= row.low <= row.high <= 1
