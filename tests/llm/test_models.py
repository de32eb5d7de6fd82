import numpy as np
import pytest

from kerbline.llm import catalog, quality, toxicity
from tests.llm.helpers import awkward_documents, documents, prose, seeded

FOLDER = "/root/testdata/sf0.1"


def labelled_scores(spark, query, column):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = query(spark, FOLDER).where("held_out").join(labels, "doc_id").select("score", "predicted", column).collect()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled_scores(spark, catalog.op3_toxicity, "toxic")
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(clean) < 0.01


def test_quality_on_held_out_rows(spark):
    rows = labelled_scores(spark, catalog.op9_quality_pu, "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_unlabelled_sample_reaches_the_end_of_the_table(spark, monkeypatch):
    """The last source of a table of 4,000 rows is in a sample of 1,000 by its share."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda positive, unlabelled, prior: seen.append(unlabelled))
    rows = [(i, "some plain words of a text" if i < 3_800 else "1234 5678 !!! 90 ???") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    quality.train(df, df.where("doc_id < 3"), max_unlabelled=1_000)
    last = quality.features([rows[-1][1].encode()])[0]
    assert len(seen[0]) == 1_000
    assert 20 <= (seen[0] == last).all(axis=1).sum() <= 90


def test_counterfactual_penalty():
    """A group that is mostly mentioned in toxic training texts is not toxic by itself."""
    rng = seeded(1)
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        group = "muslims" if bad and i % 2 == 0 else ("christians" if i % 5 == 0 else "")
        texts.append(f"{prose(rng, 8)} {group} {'vermin' if bad and i % 4 else ''} {prose(rng, 8)}".encode())
        labels.append(float(bad))
    neutral = [b"the muslims met in town", b"the christians met in town"]
    plain = toxicity.fit(texts, np.array(labels), penalty=0.0).logits(neutral)
    fair = toxicity.fit(texts, np.array(labels)).logits(neutral)
    assert plain[0] > 0 > fair[0]
    assert abs(fair[0] - fair[1]) < 0.2 * abs(plain[0] - plain[1])
    assert toxicity.fit(texts, np.array(labels)).logits([b"vermin all of them"])[0] > 0


@pytest.mark.parametrize("with_labels", [True, False])
def test_awkward_rows_get_scores(spark, with_labels):
    rng = seeded(2)
    rows = awkward_documents(rng)
    df = documents(spark, rows, ("score", "label"))
    marks = [(r[0], i % 2) for i, r in enumerate(rows)] + [(None, 1), (3, None), (99_999, 1)] if with_labels else []
    labels = spark.createDataFrame(marks, "doc_id long, label int")
    for scored in (toxicity.score(df, toxicity.train(df, labels), "probability"),
                   quality.score(df, quality.train(df, labels.where("label = 1")), "probability")):
        assert scored.columns == [*df.columns, "probability"]
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
        assert {r.score for r in got} == {"kept"}
    none = df.where("false")
    assert toxicity.score(none, toxicity.train(none, labels)).collect() == [] == quality.score(none, quality.train(none, labels)).collect()


def test_same_score_for_the_same_text(spark):
    df = documents(spark, [(1, "a b c", "x"), (2, "a b c", "y"), (None, "a b c", None)])
    model = toxicity.fit([b"a", b"b"], np.array([0.0, 1.0]))
    assert len({r.score for r in toxicity.score(df, model).select("score").collect()}) == 1


def test_class_prior_and_non_negative_risk():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (4000, quality.WIDTH)), rng.normal(1.5, 1, (1000, quality.WIDTH))
    unlabelled = np.concatenate([good[2000:], bad])
    mean, scale = unlabelled.mean(0), unlabelled.std(0)
    assert abs(quality.estimated_prior((good[:2000] - mean) / scale, (unlabelled - mean) / scale) - 2 / 3) < 0.08
    model = quality.fit(good[:2000], unlabelled)
    scores = model.probabilities(unlabelled)
    assert (scores[:2000] >= 0.5).mean() > 0.95 and (scores[2000:] < 0.5).mean() > 0.95


def test_models_do_not_depend_on_partitions(spark, monkeypatch):
    """The same rows in 1 and 37 partitions, in another order, give the same samples and models."""
    rows = awkward_documents(seeded(5), 400) + [(None, "the same words", "s")] * 300
    df = documents(spark, rows)
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda *given: seen.append(given))
    for parts in (1, 37):
        quality.train(df.repartition(parts, "text"), marks.where("label = 1"), max_positive=40, max_unlabelled=120)
    for first, second in zip(seen[0][:2], seen[1][:2]):
        assert (first == second).all() and len(first)
    assert len(seen[0][1]) == 120
    repeated = quality.features([b"the same words"])[0]
    assert 25 <= (seen[0][1] == repeated).all(axis=1).sum() <= 70  # 300 of about 800 rows
    one, many = (toxicity.train(df.repartition(parts, "text"), marks, steps=5) for parts in (1, 37))
    assert (one.weights == many.weights).all() and one.bias == many.bias


def test_toxicity_features_from_executors_are_those_of_the_texts(spark):
    rng = seeded(6)
    texts = [f"{prose(rng, 12)} {'vermin' if i % 3 == 0 else ''} {rng.choice(['women', 'men', 'É ß'])}" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, label int")
    there = toxicity.train(df, marks, steps=20)
    here = toxicity.fit([t.encode() for t in texts], np.array([float(i % 3 == 0) for i in range(200)]), steps=20)
    assert np.allclose(there.weights, here.weights, atol=1e-6) and abs(there.bias - here.bias) < 1e-9
    # The gradient is that of the plain loss: a small step against it lowers the loss as a double loop computes it.
    rows, buckets = toxicity._words([t.encode() for t in texts])
    by_loop = [here.bias + sum(float(here.weights[b]) for b in set(buckets[rows == i])) for i in range(200)]
    assert np.allclose(by_loop, here.logits([t.encode() for t in texts]), atol=1e-5)


def test_nothing_labelled_is_not_toxic(spark):
    model = toxicity.fit([], np.array([]))
    scored = toxicity.score(documents(spark, [(1, "any words", "s"), (2, None, "s")]), model)
    assert {round(r.score, 6) for r in scored.collect()} == {0.25}
