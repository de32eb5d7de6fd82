import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import rounding, scoring
from kerbline.operators import audit, clusters, dispatch, explore, feed, junctions
from kerbline.sources import dimensions
from kerbline.sources.snapshot import to_json_rows

SCORED = ("id long, junction_name string, police_station string, vehicle_type string, hour int, cis double, "
          "latitude double, longitude double")


def scored_rows(seed=4, n=900):
    rng = random.Random(seed)
    names = ["No Junction", "BTP1", "Circle A", "Circle B"]
    vehicles = ["CAR", "MOTOR CYCLE", "PRIVATE BUS", "VAN", "SCOOTER", "TANKER", "UNKNOWN"]
    return [
        (i, rng.choice(names), f"S{rng.randint(1, 3)}", rng.choice(vehicles), rng.choice([None, 8, 9, 10, 14, 21]),
         rng.randint(16, 4000) / 1000, None if i % 50 == 0 else 12.9 + rng.random() / 100, 77.5 + rng.random() / 100)
        for i in range(n)
    ]


def np_round(x, digits=1):
    import numpy as np

    return float(np.round(np.float64(x), digits))


def expected_records(rows):
    records = []
    for name in sorted({r[1] for r in rows} - {"No Junction"}):
        group = sorted(r for r in rows if r[1] == name)
        n = len(group)
        raw = sum(round(r[5] * 1000) for r in group) / (1000 * n)
        norm = min(10.0, np_round(raw * 4.14))
        counts = sorted(Counter(r[3] for r in group).items(), key=lambda p: (-p[1], p[0]))
        short = {"MOTOR CYCLE": "MOTORCYCLE", "PRIVATE BUS": "BUS"}
        shares = [(short.get(v, v), c / n * 100) for v, c in counts]
        hour, peak = sorted(Counter(r[4] for r in group if r[4] is not None).items(), key=lambda p: (-p[1], p[0]))[0]
        trend = []
        for h in (8, 10, 12, 14, 16, 18, 20):
            of_hour = [round(r[5] * 1000) for r in group if r[4] == h]
            mean = sum(of_hour) / (1000 * len(of_hour)) if of_hour else raw * (0.8 if h in (8, 14, 20) else 1.1)
            trend.append((f"{h:02d}:00", min(10.0, np_round(mean * 4.14))))
        records.append({
            "name": name, "jurisdiction": group[0][2], "violations": n, "raw_cis": np_round(raw, 3), "cis": norm,
            "status": "critical" if norm >= 8 else "active" if norm >= 5 else "neutral",
            "expected_improvement": min(50.0, np_round(norm * 5)),
            "vehicle_mix": ", ".join(f"{v} ({p:.0f}%)" for v, p in shares[:3]),
            "vehicle_mix_data": [(v, round(p, 1)) for v, p in shares[:5]],
            "peak_hour": f"{hour:02d}:00", "peak_hour_val": hour, "peak_hour_violations": peak,
            "affected_vehicles": int(n / 150 * 12), "avg_delay": np_round(raw * 2),
            "capacity_loss": min(95.0, np_round(norm * 4.5)),
            "economic_cost": sum(round(r[5] * 1000) for r in group) * 375 // 1_500_000,
            "co2_impact": sum(round(r[5] * 1000) for r in group) * 345 // 150_000_000,
            "trend_data": trend,
        })
    records.sort(key=lambda r: -r["violations"])
    return [{"id": i + 1, **r} for i, r in enumerate(records)]


def test_records_by_hand_and_in_any_order(spark):
    rows = scored_rows()
    expected = expected_records(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    results = []
    for data, parts in ((rows, 1), (shuffled, 9)):
        got = junctions.junction_hotspots(spark.createDataFrame(data, SCORED).repartition(parts)).orderBy("id").collect()
        results.append(got)
        for row, want in zip(got, expected, strict=True):
            for key, value in want.items():
                have = [tuple(v) for v in row[key]] if isinstance(value, list) else row[key]
                assert have == value, key
            group = [r for r in rows if r[1] == want["name"] and r[6] is not None]
            assert row["lat"] == pytest.approx(sum(r[6] for r in group) / len(group), abs=1.1e-5)
    assert results[0] == results[1]
    assert all(abs(sum(p for _, p in map(tuple, r["vehicle_mix_data"]))) <= 100.5 for r in results[0])


def test_one_scan_and_hash_aggregation(spark):
    """The whole record comes from one pass; the ticket-level aggregation never sorts."""
    from kerbline.catalog.tables import scored

    df = junctions._profiles(scored(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "SortAggregate" not in plan
    assert plan.count("Exchange") == 2


def test_feed_lines(spark):
    top = spark.createDataFrame([
        (1, "A", 300, 2.1, "Tow Now"), (2, "", 10, 1.0, ""), (3, "B", 150, 1.0, ""), (4, "Z", 400, 2.5, "")],
        "position int, junction_name string, violations long, cis double, recommendation string")
    metadata = spark.createDataFrame([
        ("A", "S1", 1.0, 2.0, "CAR (100%)", [("CAR", 100.0)], "08:00", 8, 7, {8: 0.5, 10: 2.0}, 4.2, 1000, 10),
        ("B", "S2", 1.0, 2.0, "VAN (100%)", [("VAN", 100.0)], "09:00", 9, 7, {8: 1.0}, 0.0, 0, 0)],
        "name string, jurisdiction string, lat double, lng double, vehicle_mix string, "
        "vehicle_mix_data array<struct<name:string,percentage:double>>, peak_hour string, peak_hour_val int, "
        "peak_hour_violations long, trend_multipliers map<int,double>, raw_cis_base double, economic_cost_base long, "
        "co2_impact_base long")
    rows = {r.id: r for r in feed.hotspot_feed(top, metadata).collect()}
    assert sorted(rows) == [1, 3, 4]
    a, b, z = rows[1], rows[3], rows[4]
    assert (a.cis, a.status, a.action, a.recommendation) == (8.7, "critical", "Tow Immediately", "Tow Now")
    assert (a.economic_cost, a.co2_impact) == (500, 5)
    assert a.capacity_loss == 39.1
    assert [tuple(t) for t in a.trend_data][:3] == [("08:00", 4.3), ("10:00", 10.0), ("12:00", 8.7)]
    assert (b.recommendation, b.economic_cost, b.co2_impact) == ("Routine Patrol", 37, 0)
    assert (z.jurisdiction, z.lat, z.vehicle_mix, z.peak_hour_violations) == ("Unknown", 12.9716, C.FEED_DEFAULTS["vehicle_mix"], 100)
    assert z.economic_cost == int(400 * 2.5 * 0.25 * 150 / 150)
    lines = [r.value for r in to_json_rows(feed.hotspot_feed(top, metadata)).collect()]
    assert len(lines) == 3 and lines[0].startswith('{"id":1,"name":"A"')


HOTSPOT = ("id int, name string, jurisdiction string, cis double, status string, action string, vehicle_mix string, "
           "avg_delay double, affected_vehicles long, capacity_loss double, economic_cost long, "
           "expected_improvement double, lat double, lng double")


def hotspots(spark):
    rows = [
        (1, "Silk Board", "Madiwala", 6.0, "active", "Deploy Officers", "CAR (50%), VAN (20%)", 2.9, 10, 27.0, 100, 30.0, 12.91, 77.62),
        (2, "Town Hall", "Halasuru", 9.1, "critical", "Tow Immediately", "MAXI-CAB (50%)", 4.4, 20, 41.0, 200, 45.5, 12.96, 77.58),
        (3, "KR Circle", "Upparpet", 6.0, "active", "Deploy Officers", "MOTORCYCLE (90%)", 2.9, 30, 27.0, 300, 30.0, 12.97, 77.57),
        (4, "Hebbal", "Hebbal", 2.0, "neutral", "Routine Patrol", "GOODS AUTO (90%)", 1.0, 40, 9.0, 400, 10.0, 13.03, 77.59),
        (5, "Yelahanka", "Town Side", 3.0, "neutral", "Routine Patrol", "LGV (90%)", 1.4, 50, 13.5, 500, 15.0, 13.1, 77.6),
        (6, "Domlur", "Halasuru", 1.0, "neutral", "Routine Patrol", "TRACTOR (90%)", 0.5, 60, 4.5, 600, 5.0, 12.96, 77.63),
    ]
    return spark.createDataFrame(rows, HOTSPOT)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_hotspot_filters(spark):
    df = hotspots(spark)
    assert ids(explore.filter_hotspots(df)) == [1, 2, 3, 4, 5, 6]
    assert ids(explore.filter_hotspots(df, station="Halasuru")) == [2, 6]
    assert ids(explore.filter_hotspots(df, category="CAR")) == [1, 2]
    assert ids(explore.filter_hotspots(df, category="SCOOTER")) == [3]
    assert ids(explore.filter_hotspots(df, category="TANKER")) == [5]
    assert ids(explore.filter_hotspots(df, category="AUTO")) == [4]
    assert ids(explore.filter_hotspots(df, min_cis=6.0)) == [1, 2, 3]
    assert ids(explore.filter_hotspots(df, query="TOWN")) == [2, 5]
    assert ids(explore.filter_hotspots(df, query="   ")) == [1, 2, 3, 4, 5, 6]
    assert ids(explore.filter_hotspots(df, query="town ")) == [2, 5]
    assert ids(explore.filter_hotspots(df, query=" town")) == []
    assert ids(explore.filter_hotspots(df, station="Hebbal", min_cis=9.0, focus=True)) == [1, 2, 3, 4, 5]


def test_filters_commute(spark):
    df = hotspots(spark)
    one = explore.filter_hotspots(explore.filter_hotspots(df, station="Halasuru"), min_cis=5.0)
    other = explore.filter_hotspots(explore.filter_hotspots(df, min_cis=5.0), station="Halasuru")
    assert ids(one) == ids(other) == [2]


def test_summary_and_focus(spark):
    df = hotspots(spark)
    row = explore.summary_metrics(df, 50).first()
    assert row.asDict() == {
        "active_count": 6, "critical_count": 1, "avg_cis": 4.5, "total_delay": round(0.5 * (29 + 88 + 87 + 40 + 70 + 30)),
        "avg_capacity_loss": 10, "total_cost": 1050}
    empty = explore.summary_metrics(df.where("false")).first()
    assert set(empty.asDict().values()) == {0}
    assert explore.focus_improvement(df).first().improvement == 26.1
    assert explore.focus_improvement(df.where("false")).first().improvement == 0.0
    assert tuple(explore.focus_bounds(df).first()) == (12.91, 13.1, 77.57, 77.62)
    assert [r.id for r in explore.priority_index(df).orderBy("index_number").collect()] == [2, 1, 3, 5, 4, 6]


def test_lists_and_centre(spark):
    rows = spark.createDataFrame(scored_rows(), SCORED)
    assert [r.value for r in explore.facet(rows, "police_station").collect()] == ["ALL", "S1", "S2", "S3"]
    assert explore.top_vehicle_counts(rows).count() == 6
    assert [r.hour for r in explore.hour_histogram(rows).collect()] == [8, 9, 10, 14, 21]
    assert tuple(explore.map_centre(rows.where("false")).first()) == C.MAP_CENTRE
    assert explore.filter_violations(rows, "S1", "CAR", 2.0).where("cis < 2 or police_station <> 'S1'").count() == 0


def test_kpis_and_audit(spark):
    rows = spark.createDataFrame(
        [(1, 0, "CAR", '["A","B"]', "S1", 2.0, 0.9, 1.0, 2.0, 1.0, 12.0, 77.0), (2, 0, "CAR", "B", "S2", 4.0, 0.7, 2.0, 2.0, 1.0, 12.0, 77.0),
         (3, 0, "VAN", None, "S1", 3.0, 0.8, 3.0, 1.0, 1.0, 12.0, 77.0), (4, -1, "VAN", "Z", "S1", 9.0, 0.8, 3.0, 3.0, 1.0, 12.0, 77.0),
         (5, 1, "MOPED", None, "S1", 1.0, 0.5, 0.2, 1.0, 3.0, 13.0, 78.0)],
        "id long, cluster_label int, vehicle_type string, violation_type string, police_station string, cis double, "
        "approval_probability double, w_size double, w_type double, w_road double, latitude double, longitude double")
    total = explore.kpis(rows, 50).first()
    assert (total.violations, total.active_hotspots, total.economic_loss) == (5, 2, 19 * 37.5 / 2)
    empty = explore.kpis(rows.where("false")).first()
    assert (empty.violations, empty.economic_loss, empty.active_hotspots) == (0, 0.0, 0)
    cards = {r.cluster_label: r for r in audit.audit_hotspots(rows).collect()}
    assert (cards[0].top_vehicle, cards[0].top_violation, cards[0].tier, cards[0].avg_cis) == ("CAR", "B", "HIGH", 3.0)
    assert cards[0].avg_approval_pct == pytest.approx(80.0)
    assert "66.7% of offending vehicles are CARs" in cards[0].sentence
    assert cards[1].top_violation == "WRONG PARKING"
    parts = {(r.cluster_label, r.component): r.contribution for r in audit.weight_contributions(rows).collect()}
    assert parts[0, "Vehicle Footprint"] == 2.0 and parts[1, "Road Class"] == 3.0
    summary = {r.cluster_label: r for r in clusters.cluster_summary(rows).collect()}
    assert (summary[0].violations_count, summary[0].police_station, summary[0].economic_loss) == (3, "S1", 337.5)
    assert clusters.hotspot_count(rows).first().hotspots == 2


def cluster_table(spark, losses):
    return spark.createDataFrame([(i, float(x), 2.0 + i) for i, x in enumerate(losses)],
                                 "cluster_label int, economic_loss double, avg_cis double")


@pytest.mark.parametrize(("losses", "units", "per_unit", "plans"), [
    ([9, 8, 7, 6, 5], 2, 2, [("Hotspot #0 -> Hotspot #1", 17.0, 2.5), ("Hotspot #2 -> Hotspot #3", 13.0, 4.5)]),
    ([5, 9], 4, 6, [("Hotspot #1 -> Hotspot #0", 14.0, 2.5)]),
])
def test_patrol_plan(spark, losses, units, per_unit, plans):
    plan = dispatch.dispatch_plan(dispatch.assign_patrols(cluster_table(spark, losses), units, per_unit))
    assert [tuple(r)[1:] for r in plan.orderBy("patrol").collect()] == plans


def test_patrol_plan_covers_the_best(spark):
    losses = [(i * 37) % 101 + 1 for i in range(40)]
    for units, per_unit in ((1, 1), (3, 4), (10, 6)):
        plan = dispatch.dispatch_plan(dispatch.assign_patrols(cluster_table(spark, losses), units, per_unit))
        covered = plan.agg(F.sum("loss")).first()[0]
        assert covered == sum(sorted(losses, reverse=True)[:min(15, units * per_unit)])


def test_dispatch(spark):
    df = hotspots(spark)
    assert [tuple(r) for r in dispatch.dispatch_top(df).orderBy("code").collect()] == [
        ("Patrol Beta", "Silk Board", "Deploy Officers", "P-05"),
        ("Patrol Alpha", "Town Hall", "Tow Immediately", "P-12"),
        ("Tow Unit 01", "KR Circle", "Tow Vehicle", "TOW-01")]
    assert dispatch.dispatch_top(df.limit(0)).count() == 0
    lines = {r.unit: r.target for r in dispatch.patrol_lines(df, dimensions.patrol_units(spark)).collect()}
    assert lines == {"O1": "Town Hall", "O2": "Silk Board", "T1": "KR Circle"}


def test_snapshot_scores_give_exact_thousandths(spark):
    df = spark.range(1, 27001).select((F.col("id") / 1000.0).alias("cis"), F.col("id"))
    assert scoring.with_milli(df).where("cis_milli <> id").count() == 0


def test_patrols_at_full_compliance(spark):
    clusters = spark.createDataFrame([(i, float(i + 1), 1.0) for i in range(20)], "cluster_label int, economic_loss double, avg_cis double")
    for rate, candidates, expected in ((100.0, 15, [19, 18, 17]), (25.0, 15, [19, 18, 17]), (100.0, 2, [19, 18])):
        plan = dispatch.assign_patrols(clusters, 1, 3, rate, candidates)
        assert [r.cluster_label for r in plan.orderBy("rank").collect()] == expected


def test_centres_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(12.5,), (13.5,), (float("nan"),), (None,), (float("inf"),)], "x double")
    row = df.agg(*rounding.degree_parts("x", "x")).select(rounding.mean_degrees("x").alias("mean")).first()
    assert row.mean == 13.0
