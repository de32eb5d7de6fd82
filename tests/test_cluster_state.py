"""Incremental DBSCAN against full runs and brute force, after every batch."""

import glob
import math
import random
from collections import Counter

import pytest

from kerbline.operators import cluster_state
from kerbline.operators.cluster_state import ClusterState
from kerbline.operators.dbscan import dbscan_sites
from kerbline.session import shared_folder
from tests.test_dbscan import POINT, TINY, Limits, brute_force, city


def labels(sites):
    return {(r.latitude, r.longitude): (r.weight, r.is_core, r.cluster_label) for r in sites.collect()}


def expected(rows, eps, least):
    """What a full run gives, by brute force."""
    rows = [r for r in rows if r[1] is not None and math.isfinite(r[1])]
    found, core = brute_force(rows, eps, least)
    weights = Counter((lat, lng) for _, lat, lng in rows)
    return {(lat, lng): (weights[lat, lng], i in core, found[i]) for i, lat, lng in rows}


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_every_batch_gives_the_labels_of_a_full_run(spark, tmp_path, limits):
    rng = random.Random(8)
    rows = city(3, 500)
    rng.shuffle(rows)
    state = ClusterState(spark, str(tmp_path / "state"), 0.0015, 6, limits)
    assert state.sites().collect() == []
    seen = []
    for i, batch in enumerate((rows[:200], rows[200:230], rows[230:])):
        assert state.apply(i, spark.createDataFrame(batch, POINT))
        seen += batch
        assert labels(state.sites()) == expected(seen, 0.0015, 6)
        assert not state.apply(i, spark.createDataFrame(rows, POINT))
    df = spark.createDataFrame(rows, POINT)
    assert labels(state.sites()) == labels(dbscan_sites(df, 0.0015, 6))


def test_bridges_borders_and_numbers(spark, tmp_path):
    """Joining clusters, noise that becomes border, a border that becomes core, an older id that takes the number."""
    steps = [
        [(10, 0.0, 0.0), (11, 0.0, 0.2), (12, 0.0, 0.4), (20, 0.0, 3.0), (21, 0.0, 3.2), (22, 0.0, 3.4), (40, 9.0, 9.0), (41, 0.0, 4.3)],
        [(30, 0.0, 1.3), (31, 0.0, 2.2)],
        [(5, 9.0, 9.1), (6, 9.0, 9.2), (7, float("nan"), 1.0), (8, None, 2.0)],
        [(50, 0.0, 5.2), (51, 0.0, 5.3)],
        [(1, 0.0, 0.1), (2, -100.0, 50.0)],
    ]
    state, seen = ClusterState(spark, str(tmp_path / "state"), 1.0, 3), []
    for i, rows in enumerate(steps):
        state.apply(i, spark.createDataFrame(rows, POINT))
        seen += rows
        assert labels(state.sites()) == expected(seen, 1.0, 3)
    assert state.apply(77, spark.createDataFrame([(60, None, 1.0)], POINT)) and state._current() == (4, [(0, 4)])


def test_unfinished_batch_does_not_count(spark, tmp_path):
    rows = city(5, 150)
    state = ClusterState(spark, str(tmp_path / "state"), 0.0015, 5)
    state.apply(0, spark.createDataFrame(rows[:100], POINT))
    before = labels(state.sites())
    state.apply(1, spark.createDataFrame(rows[100:], POINT))
    for path in (tmp_path / "state/ids/1").iterdir():
        path.unlink()
    assert labels(state.sites()) == before
    assert state.apply(1, spark.createDataFrame(rows[100:], POINT))
    assert labels(state.sites()) == expected(rows, 0.0015, 5)


def test_work_follows_the_touched_cells(spark, tmp_path, monkeypatch):
    """A batch at one place opens its neighbourhood only, and rewrites the tiles there only."""
    rows = [(i, (i % 50) * 0.01, (i // 50) * 0.01) for i in range(2500)] + [(5000 + i, 0.1, 0.1) for i in range(20)]
    state = ClusterState(spark, str(tmp_path / "state"), 0.0015, 5)
    state.apply(0, spark.createDataFrame(rows, POINT))
    opened, before = [], set(glob.glob(f"{shared_folder(spark)}/clusters-*"))
    plain = cluster_state.dbscan.grid_of
    monkeypatch.setattr(cluster_state.dbscan, "grid_of", lambda sites, eps, limits: opened.append(sites.count()) or plain(sites, eps, limits))
    state.apply(1, spark.createDataFrame([(9000, 0.1, 0.1001), (9001, 0.2, 0.2)], POINT))
    assert opened[0] <= 10
    tiles = spark.read.parquet(str(tmp_path / "state/tiles/1")).groupBy("version").count().collect()
    counts = {r["version"]: r["count"] for r in tiles}
    assert counts[1] <= 8 < counts[0]
    assert set(glob.glob(f"{shared_folder(spark)}/clusters-*")) <= before  # what a batch needed on the way is gone
    assert labels(state.sites()) == expected([*rows, (9000, 0.1, 0.1001), (9001, 0.2, 0.2)], 0.0015, 5)
