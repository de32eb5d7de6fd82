import json
import math
import random
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from kerbline.functions import bands, rounding, scoring

TICKET = "vehicle_type string, violation_type string, location string, junction_name string"


def score(spark, rows):
    df = spark.createDataFrame(rows, TICKET).withColumns({
        "police_station": F.lit(None).cast("string"), "created_datetime": F.lit("2024-03-04 05:06:07").cast("timestamp")})
    return scoring.score(df)


def test_score_goldens(spark):
    rows = [
        ("CAR", '["WRONG PARKING"]', "MG Street", "BTP001 - X", 1.0, 1.5, 3.0, 4.5, 168.75, 1.5525),
        ("SCOOTER", '["DEFECTIVE NUMBER PLATE"]', "5th Cross", "No Junction", 0.2, 0.2, 0.8, 0.032, 1.2, 0.01104),
        ("HCV", '["NO PARKING","DOUBLE PARKING"]', "KR Market", "Circle 1", 3.0, 3.0, 2.8, 25.2, 945.0, 8.694),
        (None, None, None, None, 1.0, 1.0, 1.2, 1.2, 45.0, 0.414),
        ("CAR", "NO PARKING", "Cross Main Road", None, 1.0, 1.2, 2.0, 2.4, 90.0, 0.828),
        ("car", "[]", "HSR Layout", None, 1.0, 1.0, 0.8, 0.8, 30.0, 0.276),
        ("MOPED", '["REFUSE TO GO FOR HIRE"]', "x", "Circle", 0.2, 0.1, 1.2, 0.024, 0.9, 0.00828),
        ("TANKER", '["DEFECTIVE NUMBER PLATE","OTHER"]', "Metro Station", "", 3.0, 1.0, 2.8, 8.4, 315.0, 2.898),
    ]
    got = score(spark, [r[:4] for r in rows]).select(
        "w_size", "w_type", "w_road", "cis", "economic_loss_inr", "co2_wasted_kg").collect()
    for row, expected in zip(got, rows):
        assert list(row) == pytest.approx(expected[4:], rel=1e-12)


def test_time_parts_and_defaults(spark):
    row = score(spark, [(None, None, None, None)]).first()
    assert (row.hour, row.day_of_week, row.month) == (5, 0, 3)
    assert (row.vehicle_type, row.location, row.junction_name, row.police_station) == (
        "UNKNOWN", "UNKNOWN", "No Junction", "UNKNOWN")
    assert row.primary_violation == "UNKNOWN"


def test_severity_takes_the_largest_weight(spark):
    from kerbline import constants as C

    names = [*C.VIOLATION_WEIGHTS, "OTHER"]
    rng = random.Random(1)
    lists = [rng.sample(names, rng.randint(0, 4)) for _ in range(300)]
    rows = [(None, json.dumps(v), None, None) for v in lists]
    got = [r.w_type for r in score(spark, rows).select("w_type").collect()]
    assert got == [max([C.VIOLATION_WEIGHTS.get(v, 1.0) for v in vs], default=1.0) for vs in lists]


TEXTS = [
    None, '["A","B"]', "A", '{"a":1}', '"A"', "null", "", "['a']", "[]", " [ ] ", '["a"] junk', '["a"] ]', '["a"]}',
    '["a"],1', '["x"],"y":1', ' ["a]b", "c"] ', '["a]b"],1', '["a" , "b"]', '["a\\"b","c"]', '["\\u0041"]', "[", '["a"',
    '["a","b",]', '["a" "b"]', '["",""]', "[tow]", '["a","b"]\n', '["a","b"]x', '[","]', '["a\tb"]',
]


@pytest.mark.parametrize("text", TEXTS)
def test_violation_list_matches_a_json_parser(spark, text):
    try:
        parsed = [] if text is None else json.loads(text)
        expected = parsed if isinstance(parsed, list) else [text]
    except ValueError:
        expected = [text]
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(scoring.violation_list(F.col("v")).alias("x")).first().x == expected


def test_a_filter_on_the_score_does_not_repeat_the_parse(spark):
    df = score(spark, [("CAR", '["A"]', "x", "y")]).where("cis >= 1.5").select("w_type")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(violation_type") <= 2


def test_rounding_rules(spark):
    rng = random.Random(3)
    values = [rng.uniform(0, 100) for _ in range(2000)] + [k / 20 for k in range(0, 2000)]
    values += [a / b * 100 for a in range(1, 40) for b in range(a, 81)] + [k / 10 * 4.5 for k in range(101)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", rounding.round_one(F.col("x")).alias("py"), rounding.fixed_one(F.col("x")).alias("js"),
        rounding.round_np(F.col("x"), 1).alias("np"), rounding.round_js(F.col("x")).alias("whole")).collect()
    for r in rows:
        exact = Decimal(r.x)
        assert r.py == round(r.x, 1)
        assert r.js == float(exact.quantize(Decimal("0.1"), ROUND_HALF_UP))
        assert r.np == float((Decimal(r.x * 10)).quantize(Decimal(1), ROUND_HALF_EVEN)) / 10
        assert r.whole == math.floor(r.x + 0.5)


def test_bands(spark):
    rows = [
        (2.10, 8.7, "critical", "Tow Immediately", "Deploy Officers"),
        (3.00, 10.0, "critical", "Tow Immediately", "Tow Immediately"),
        (1.50, 6.2, "active", "Deploy Officers", "Routine Patrol"),
        (1.00, 4.1, "neutral", "Routine Patrol", "Routine Patrol"),
    ]
    raw = F.col("raw")
    norm = bands.normalized_cis(raw)
    got = spark.createDataFrame([(r[0],) for r in rows], "raw double").select(
        "raw", norm, bands.status(norm), bands.action(norm), bands.action_from_raw(raw)).collect()
    assert [tuple(r) for r in got] == rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("make", "expected"), [
    (lambda: bands.priority_tier(F.lit(4.0)), "CRITICAL"), (lambda: bands.priority_tier(F.lit(2.5)), "HIGH"),
    (lambda: bands.priority_tier(F.lit(2.49)), "MEDIUM"),
    (lambda: bands.map_severity(F.lit(1.99)), "low"), (lambda: bands.map_severity(F.lit(3.9)), "mid"), (lambda: bands.map_severity(F.lit(4.0)), "high"),
    (lambda: bands.map_size(F.lit(49)), 6), (lambda: bands.map_size(F.lit(749)), 14), (lambda: bands.map_size(F.lit(9000)), 30),
    (lambda: bands.capacity_band(F.lit(40.0)), "critical"), (lambda: bands.capacity_band(F.lit(30.0)), "high"),
    (lambda: bands.capacity_band(F.lit(20.0)), "moderate"), (lambda: bands.capacity_band(F.lit(19.9)), "healthy"),
    (lambda: bands.capacity_size(F.lit(30.0)), 22.0),
    (lambda: bands.urgency_band(F.lit(9.0)), "critical"), (lambda: bands.urgency_band(F.lit(8.9)), "active"), (lambda: bands.urgency_band(F.lit(6.9)), "low"),
    (lambda: bands.speed_band(F.lit(11)), "Critical"), (lambda: bands.speed_band(F.lit(12)), "Severe"), (lambda: bands.speed_band(F.lit(20)), "Heavy"),
    (lambda: bands.speed_band(F.lit(40)), "Moderate"), (lambda: bands.speed_band(F.lit(41)), "Free Flow"),
    (lambda: bands.congestion_level(F.lit("dark-red")), "Critical"), (lambda: bands.congestion_level(F.lit("green")), "Free Flow"),
    (lambda: bands.expected_improvement(F.lit(8.7)), 43.5), (lambda: bands.expected_improvement(F.lit(10.0)), 50.0),
    (lambda: bands.affected_vehicles(F.lit(873)), 69), (lambda: bands.average_delay(F.lit(2.126)), 4.3),
    (lambda: bands.capacity_loss(F.lit(8.7)), 39.2), (lambda: bands.capacity_loss(F.lit(8.7), exact=True), 39.1),
    (lambda: bands.realized_recovery(F.lit(43.0), 50), 22), (lambda: bands.lakhs(F.lit(250000.0)), 2.5), (lambda: bands.tonnes(F.lit(1500.0)), 1.5),
    (lambda: bands.hour_text(F.lit(9)), "09:00"), (lambda: bands.peak_text(F.lit(9), F.lit(12)), "09:00 (12 violations)"),
    (lambda: bands.share_text(F.lit("CAR"), F.lit(12.5)), "CAR (12%)"), (lambda: bands.share_text(F.lit("CAR"), F.lit(6.25), 1), "CAR (6.2%)"),
    (lambda: bands.clean_vehicle(F.lit("MOTOR CYCLE")), "MOTORCYCLE"), (lambda: bands.clean_vehicle(F.lit("PRIVATE BUS")), "BUS"),
])
def test_band_edges(spark, make, expected):
    assert one(spark, make()) == expected


def test_compliance_factor():
    assert bands.compliance_factor(25) == 0.75
