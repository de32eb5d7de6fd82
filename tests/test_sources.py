import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbline.sources import dimensions, tickets

HEADER = ("id,created_datetime,vehicle_type,violation_type,location,junction_name,police_station,validation_status,"
          "latitude,longitude\n")


def write(tmp_path, text):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + text)
    return str(path)


def test_csv_with_json_lists_missing_texts_and_rejects(spark, tmp_path):
    path = write(tmp_path, '\n'.join([
        '1,2024-01-02 03:04:05+05:30,CAR,"[""NO PARKING"",""DOUBLE PARKING""]","A, B",NULL,nan,approved,12.9,77.5',
        '2,13/02/2024 01:02,VAN,WRONG PARKING,"",Circle,S1,NA,x,77.6',
        '3,soon,,,,,,,,',
    ]) + "\n")
    text = tickets.read_violations_text(spark, path)
    rows = {r.id: r for r in tickets.type_violations(text).collect()}
    assert rows["1"].violation_type == '["NO PARKING","DOUBLE PARKING"]'
    assert rows["1"].location == "A, B"
    assert (rows["1"].junction_name, rows["1"].police_station, rows["2"].location, rows["2"].validation_status) == (None,) * 4
    assert rows["2"].latitude is None and rows["2"].longitude == 77.6
    assert tickets.rejected_counts(text).first().asDict() == {
        "created_datetime": 1, "latitude": 1, "longitude": 0}
    assert tickets.duplicate_ids(tickets.type_violations(text)).count() == 0


@pytest.mark.parametrize(("text", "expected"), [
    ("2024-03-05 06:07:08", "2024-03-05 06:07:08"),
    ("2024-03-05T06:07:08Z", "2024-03-05 06:07:08"),
    ("2024-03-05 06:07:08.5+00", "2024-03-05 06:07:08.500000"),
    ("2024-03-05 06:07:08+05:30", "2024-03-05 00:37:08"),
    ("2024-03-05", "2024-03-05 00:00:00"),
    ("3/5/2024 6:07", "2024-03-05 06:07:00"),
    ("25/03/2024 06:07:08", "2024-03-25 06:07:08"),
    ("5 Mar 2024", "2024-03-05 00:00:00"),
    ("2024-01-01 10:00:00 PM", "2024-01-01 22:00:00"),
    ("01/02/2024 10:00 PM", "2024-01-02 22:00:00"),
    ("1/2/2024 10:00:00.250", "2024-01-02 10:00:00.250000"),
    ("never", None), (None, None),
])
def test_mixed_timestamps(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(
        tickets.parse_timestamp(F.col("t")).cast("string").alias("x")).first()
    if expected is None:
        assert row.x is None
    else:
        assert dt.datetime.fromisoformat(row.x) == dt.datetime.fromisoformat(expected)


def test_shipped_tables(spark):
    assert dimensions.corridors(spark).count() == 6
    assert [u.label for u in dimensions.patrol_units(spark).collect()] == ["P-12", "P-05", "TOW-01", "TOW-02"]
    assert dimensions.vehicle_weights(spark).count() == 13
    assert dimensions.violation_weights(spark).count() == 10
