import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import clusters
from kerbline.operators.dbscan import Limits, core_sites, dbscan_sites

POINT = "id long, latitude double, longitude double"
# Small sizes force every large-data branch: salted cells, refinement, hot keys, shuffled lookups.
TINY = Limits(hot_sites=3, direct_pairs=1, broadcast_rows=0, hot_rows=2)


def brute_force(rows, eps, min_samples):
    near = {
        r[0]: [s[0] for s in rows if (r[1] - s[1]) ** 2 + (r[2] - s[2]) ** 2 <= eps * eps] for r in rows
    }
    core = {i for i, found in near.items() if len(found) >= min_samples}
    labels, number = {r[0]: -1 for r in rows}, 0
    for first in sorted(near):
        if labels[first] != -1 or first not in core:
            continue
        stack = [first]
        while stack:
            i = stack.pop()
            if labels[i] == -1:
                labels[i] = number
                if i in core:
                    stack.extend(near[i])
        number += 1
    return labels, core


def labels_of(spark, rows, eps, min_samples, limits=Limits()):
    df = spark.createDataFrame(rows, POINT).repartition(7)
    sites = dbscan_sites(df, eps, min_samples, limits)
    return {r.id: r.cluster_label for r in df.join(sites, ["latitude", "longitude"]).collect()}


def test_golden(spark):
    rows = [(1, 0.0, 0.0), (2, 0.0, 0.2), (3, 0.0, 0.4), (4, 0.0, 1.3), (5, 0.0, 5.0), (6, 0.0, 5.1), (7, 0.0, 5.2),
            (8, 9.0, 9.0), (9, 7.0, 0.0), (10, 7.0, 0.0)]
    assert labels_of(spark, rows, 1.0, 3) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: -1, 9: -1, 10: -1}


def city(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            lat, lng = 12.9 + rng.gauss(0, 0.0006), 77.5 + rng.gauss(0, 0.0006)
        elif kind < 0.5:
            lat, lng = 12.9 + rng.random() * 0.03, 77.51
        elif kind < 0.65:
            lat, lng = 12.95, 77.6
        else:
            lat, lng = -0.01 + rng.random() * 0.03, -0.01 + rng.random() * 0.03
        rows.append((i, lat, lng))
    return rows


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_random_points_match_brute_force(spark, limits):
    rows = city(11, 450)
    expected, core = brute_force(rows, 0.0015, 8)
    assert len(set(expected.values())) > 4
    assert labels_of(spark, rows, 0.0015, 8, limits) == expected
    df = spark.createDataFrame(rows, POINT)
    flagged = {r.id for r in df.join(core_sites(df, 0.0015, 8, limits).where("is_core"), ["latitude", "longitude"]).collect()}
    assert flagged == core


def test_facing_dense_cells_are_separated_exactly(spark):
    """Two dense columns of points a hair more, then a hair less, than eps apart."""
    rng = random.Random(2)
    for gap, count in ((0.0015001, 2), (0.0014999, 1)):
        heights = [k * 0.0000101 for k in range(90)]
        rows = [(i, h, rng.random() * 1e-5 - 2e-5) for i, h in enumerate(heights)]
        rows += [(1000 + i, h, gap + rng.random() * 1e-5) for i, h in enumerate(heights)]
        rows += [(2000, 0.0004, 0.0), (2001, 0.0004, gap)]
        expected, _ = brute_force(rows, 0.0015, 15)
        assert len(set(expected.values())) == count
        assert labels_of(spark, rows, 0.0015, 15, Limits(direct_pairs=64)) == expected


def test_eligible_rows_only_and_hot_coordinate(spark):
    """A third of the rows at one coordinate; ineligible and unplaced rows stay at -1."""
    rows = [(i, 12.9, 77.5, 4.5, 0.9) for i in range(60)]
    rows += [(100 + i, 12.9, 77.5, 1.0, 0.9) for i in range(5)]
    rows += [(200 + i, 12.9, 77.5, 4.5, 0.5) for i in range(5)]
    rows += [(300 + i, 13.0 + i * 0.0001, 77.6, 2.0, 0.9) for i in range(60)]
    rows += [(400 + i, None, 77.6, 2.0, 0.9) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, cis double, approval_probability double")
    for limits in (Limits(), TINY):
        got = {r.id: r.cluster_label for r in clusters.attach_clusters(df, limits=limits).collect()}
        assert len(got) == len(rows)
        assert {got[i] for i in range(60)} == {0}
        assert {got[300 + i] for i in range(60)} == {1}
        assert {v for k, v in got.items() if k not in range(60) and not 300 <= k < 360} == {-1}


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 0.1, 0.9)], "id long, latitude double, longitude double, cis double, "
                               "approval_probability double")
    assert [r.cluster_label for r in clusters.attach_clusters(df).collect()] == [-1]


def test_eps_too_small(spark):
    with pytest.raises(ValueError):
        dbscan_sites(spark.createDataFrame([(1, 1.0, 1.0)], POINT), eps=1e-8)
