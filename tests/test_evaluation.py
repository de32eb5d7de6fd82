"""Rank statistic and calibration against all pairs."""

import random

import pytest

from kerbline.operators import evaluation

SCHEMA = "id long, validation_status string, approval_probability double"


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_statistic_is_the_share_of_won_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["approved", "rejected", None, "pending"]), rng.choice([0.0, 0.25, rng.random(), 1.0])) for i in range(300)]
    rows += [(900, "approved", None), (901, "rejected", float("nan"))]
    good, bad = ([s for _, kind, s in rows if kind == want and s is not None and s == s] for want in ("approved", "rejected"))
    wins = sum(2 if g > b else g == b for g in good for b in bad)
    got = evaluation.rank_statistic(spark.createDataFrame(rows, SCHEMA).repartition(7)).first()
    assert (got.approved, got.rejected, got.twice_wins) == (len(good), len(bad), wins)
    assert got.auc == wins / (2 * len(good) * len(bad))


def test_one_kind_or_none(spark):
    assert evaluation.rank_statistic(spark.createDataFrame([(1, "approved", 0.5)], SCHEMA)).collect() == [(1, 0, 0, None)]
    assert evaluation.rank_statistic(spark.createDataFrame([], SCHEMA)).collect() == [(0, 0, 0, None)]
    assert evaluation.calibration(spark.createDataFrame([], SCHEMA)).collect() == []


def test_calibration(spark):
    rows = [(1, "approved", 0.05), (2, "rejected", 0.0), (3, "approved", 1.0), (4, "approved", 0.95), (5, "rejected", 0.35), (6, None, 0.35)]
    got = sorted(evaluation.calibration(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 1, 0.025, 0.5), (3, 1, 0, 0.35, 0.0), (9, 2, 2, 0.975, 1.0)]
