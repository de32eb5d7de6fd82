import math
import random

from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_km
from kerbline.operators import corridors
from kerbline.schema import CORRIDOR
from kerbline.sources import dimensions

SPOT = "id int, name string, lat double, lng double, status string"


def distance(lat1, lng1, lat2, lng2):
    d_lat, d_lng = math.radians(lat2 - lat1) / 2, math.radians(lng2 - lng1) / 2
    a = math.sin(d_lat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(d_lng) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def brute(roads, spots, km):
    return {(r[0], s[0]) for r in roads for s in spots if any(distance(p[0], p[1], s[2], s[3]) < km for p in r[2])}


def road(i, points):
    return (f"R{i}", f"Road {i}", points, 10, 50, "red", 1, 1.5, True)


def test_links_match_all_pairs(spark):
    rng = random.Random(8)
    for lat0, lng0, spread, km in ((12.95, 77.6, 0.05, 1.0), (0.0, 0.0, 0.1, 3.0), (68.0, 179.99, 0.05, 1.0),
                                   (-89.99, 10.0, 0.02, 1.0), (89.995, -180.0, 0.004, 5.0)):
        def point():
            lat = max(-90.0, min(90.0, lat0 + rng.uniform(-spread, spread)))
            lng = lng0 + rng.uniform(-spread, spread) * (40 if abs(lat0) > 80 else 1)
            return lat, (lng + 180) % 360 - 180

        roads = [road(i, [point() for _ in range(rng.randint(1, 3))]) for i in range(25)]
        spots = [(i, f"H{i}", *point(), "active") for i in range(120)]
        got = corridors.link_corridors(spark.createDataFrame(roads, CORRIDOR), spark.createDataFrame(spots, SPOT), km)
        pairs = [(r.id, r.hotspot_id) for r in got.collect()]
        expected = brute(roads, spots, km)
        assert expected
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == expected


def test_crowded_cells_are_split(spark):
    """One cell with nine tenths of all places: every leaf is small, and the links are those of all pairs."""
    rng = random.Random(3)
    spots = [(i, f"H{i}", 12.95 + rng.random() * 0.008, 77.6 + rng.random() * 0.008, "active") for i in range(540)]
    spots += [(600 + i, f"H{600 + i}", 12.95 + rng.uniform(-0.1, 0.1), 77.6 + rng.uniform(-0.1, 0.1), "active") for i in range(60)]
    spots += [(700, "H700", 12.95, 77.6, "active"), (701, "H701", 12.95, 77.6, "active"), (702, "H702", None, 77.6, "active")]
    table = spark.createDataFrame(spots, SPOT)
    roads = [road(i, [(12.95 + rng.uniform(-0.02, 0.02), 77.6 + rng.uniform(-0.02, 0.02)) for _ in range(rng.randint(1, 4))]) for i in range(12)]
    for leaf in (1, 8, 50):
        got = corridors.link_corridors(spark.createDataFrame(roads, CORRIDOR), table, 1.0, leaf).collect()
        pairs = [(r.id, r.hotspot_id) for r in got]
        assert len(pairs) == len(set(pairs)) and set(pairs) == brute(roads, [s for s in spots if s[2] is not None], 1.0)
    step = corridors._band_degrees(1.0)
    placed = table.select("lat", "lng").distinct().where("lat IS NOT NULL").withColumns({"band": F.lit(0).cast("long"), "cell": F.lit(0).cast("long"),
        "fy": (F.col("lat") - 12.85) / 0.2, "fx": (F.col("lng") - 77.5) / 0.2})
    split = corridors.split_places(placed, 8)
    assert split.count() == placed.count() and step > 0
    sizes = [r["count"] for r in split.groupBy(*corridors._LEAF).count().collect()]
    assert max(sizes) <= 8 and len(sizes) > 70
    # The join's key spreads them: with 8 partitions no task has half of the places.
    parts = split.repartition(8, *corridors._LEAF).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 0.3 * placed.count()


def test_haversine(spark):
    got = spark.range(1).select(haversine_km(F.lit(12.9), F.lit(77.5), F.lit(13.1), F.lit(77.7)).alias("d")).first().d
    assert math.isclose(got, distance(12.9, 77.5, 13.1, 77.7), rel_tol=1e-12)


def test_names_in_order_and_inactive(spark):
    roads = dimensions.corridors(spark)
    spots = spark.createDataFrame([
        (2, "near", 12.9301, 77.6141, "active"), (1, "also", 12.9372, 77.6151, "critical"), (3, "far", 12.0, 77.0, "neutral")], SPOT)
    nearby = corridors.with_nearby(roads, corridors.link_corridors(roads, spots))
    names = {r.id: r.nearby_hotspots for r in nearby.collect()}
    assert names == {"R1": [], "R2": [], "R3": ["also", "near"], "R4": [], "R5": [], "R6": []}
    status = corridors.linked_status(nearby, spots.where("name <> 'near'"))
    assert [tuple(r) for r in status.orderBy("place").select("id", "name", "status").collect()] == [
        ("R3", "also", "critical"), ("R3", "near", "Inactive")]


def test_flags_and_stats(spark):
    roads = dimensions.corridors(spark)
    flags = {r.id: r for r in corridors.corridor_flags(roads).collect()}
    assert {i for i, r in flags.items() if r.bottleneck} == {"R1", "R2", "R4", "R6"}
    assert {i for i, r in flags.items() if r.delay_zone} == {"R2", "R4"}
    assert (flags["R4"].mid_lat, flags["R4"].mid_lng) == (12.9592, 77.6444)
    assert (flags["R4"].speed_band, flags["R4"].level, flags["R5"].level) == ("Critical", "Critical", "Free Flow")
    assert corridors.speed_comparison(roads).count() == 12
    stats = corridors.network_stats(roads).first()
    assert tuple(stats) == (23.5, "HAL Airport Road", "HAL Airport Road (+8.5m)")


def test_links_leave_the_join_as_they_are(spark):
    """Rows of equal ids, places of many hotspots and leaves of many corridors: each link once, and nothing folds or shuffles the links."""
    rng = random.Random(5)
    roads = [road(i % 30, [(12.95 + rng.uniform(-0.02, 0.02), 77.6 + rng.uniform(-0.02, 0.02)) for _ in range(3)]) for i in range(60)]
    roads += [("R3", None, None, 1, 1, None, 1, 1.0, None), ("R4", "x", [(None, 77.6), (12.95, 77.6), (12.95, 77.6)], 1, 1, None, 1, 1.0, None)]
    spots = [(i, f"H{i}", 12.95 + i % 5 * 0.004, 77.6, "active") for i in range(90)] + [(95, None, 12.95, 77.6, None), (96, "H96", None, None, "active")]
    tables = spark.createDataFrame(roads, CORRIDOR), spark.createDataFrame(spots, SPOT)
    known = brute([(r[0], r[1], [p for p in r[2] or [] if p[0] is not None]) for r in roads], [s for s in spots if s[2] is not None], 1.0)
    named = {s[0]: s for s in spots}
    for sizes in ({}, {"stack": 4, "block": 3}, {"stack": 1, "block": 1, "leaf_places": 1}):
        links = corridors.link_corridors(*tables, **sizes)
        got = [tuple(r) for r in links.collect()]
        assert len(got) == len(known) and {(r[0], r[1]) for r in got} == known
        assert all((r[2], r[3]) == (named[r[1]][1], named[r[1]][4]) for r in got)
        above, below = links._jdf.queryExecution().optimizedPlan().toString().upper().split("ATAN2", 1)
        assert "AGGREGATE" not in above and below
