"""Totals from the cube against a scan of the filtered tickets."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import cube, explore


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        station = rng.choice(["S1", "S2", "S3", "UNKNOWN"])
        label = rng.choice([-1, -1, 0, 1, 2, 3]) if station != "S3" else rng.choice([-1, 9])
        out.append((i, station, rng.choice(["CAR", "VAN", "AUTO"]), rng.choice([640, 1500, 1501, 2250, 9000]) / 1000.0, label))
    return out


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(rows(1, 400), "id long, police_station string, vehicle_type string, cis double, cluster_label int").repartition(5).cache()


def test_every_filter_equals_the_scan(spark, tickets):
    built = cube.build_cube(cube.fold_scores(tickets)).cache()
    requests = [(s, v, m) for s in ("ALL", "S1", "S3", "nowhere") for v in ("ALL", "CAR", "AUTO", "no such") for m in (0.0, 0.64, 1.5, 1.5005, 9.0, 9.001)]
    table = spark.createDataFrame(requests, "station string, vehicle string, min_cis double")
    found = {(r.station, r.vehicle, r.min_cis): r for r in cube.filtered_kpis(built, table, 25.0).collect()}
    assert len(found) == len(requests)
    plain = [tuple(r) for r in tickets.collect()]
    for station, vehicle, least in requests:
        own = [r for r in plain if station in ("ALL", r[1]) and vehicle in ("ALL", r[2]) and r[3] >= least]
        got = found[station, vehicle, least]
        assert got.violations == len(own) and got.active_hotspots == len({r[4] for r in own} - {-1})
    for station, vehicle, least in requests[::17]:
        scan = explore.kpis(explore.filter_violations(tickets, station, vehicle, least), 25.0).first()
        got = found[station, vehicle, least]
        assert [got[c] for c in scan.asDict()] == list(scan)


def test_folds_of_batches_unite(spark, tickets):
    parts = cube.fold_scores(tickets.where("id % 2 = 0")).unionByName(cube.fold_scores(tickets.where("id % 2 = 1")))
    whole, united = (sorted(map(str, cube.build_cube(f).collect())) for f in (cube.fold_scores(tickets), parts))
    assert whole == united


def test_without_tickets(spark, tickets):
    built = cube.build_cube(cube.fold_scores(tickets.where("false")))
    got = cube.filtered_kpis(built, spark.createDataFrame([("ALL", "CAR", 0.0)], "station string, vehicle string, min_cis double")).first()
    assert got.violations == 0 and got.economic_loss == 0 and got.active_hotspots == 0


def test_requests_read_no_tickets(spark, tickets, tmp_path):
    cube.build_cube(cube.fold_scores(tickets)).write.parquet(str(tmp_path / "cube"))
    stored = spark.read.parquet(str(tmp_path / "cube"))
    assert stored.count() <= 4 * 5 * 5 * 4
    request = spark.createDataFrame([("S1", "ALL", 1.0)], "station string, vehicle string, min_cis double")
    answer = cube.filtered_kpis(stored, request)
    assert all("cube" in path for path in answer.inputFiles())
    assert answer.first().violations == tickets.where(F.expr("police_station = 'S1' AND cis >= 1.0")).count()
