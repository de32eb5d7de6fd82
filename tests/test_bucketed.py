"""The snapshot laid out by junction buckets."""

import pytest
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.catalog.tables import scored
from kerbline.operators import junctions
from kerbline.sources import snapshot


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshot") / "bucketed")
    rows = scored(spark, "/root/testdata/sf0.001", per_user=True).withColumn("cluster_label", F.lit(C.NOISE))
    snapshot.write_bucketed(rows, path, 6)
    return rows, path


def exchanges(df):
    """Shuffles of a plan; the plan is final only once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange")


def test_round_trip(spark, stored):
    rows, path = stored
    back = snapshot.read_bucketed(spark, path, 6)
    assert back.columns == list(C.SCORED_COLUMNS)
    assert rows.select(*C.SCORED_COLUMNS).exceptAll(back).count() == 0 and back.count() == rows.count()
    again = snapshot.read_scored(spark, path)  # the files are plain Parquet
    assert again.count() == rows.count()


def test_reports_group_without_an_exchange(spark, stored):
    rows, path = stored
    back = snapshot.read_bucketed(spark, path, 6)
    summary = junctions.junction_summary(back)
    records = junctions.records_of(junctions.fold_junctions(back), placed=True)
    metadata = junctions.metadata_of(junctions.fold_junctions(back), placed=True)
    for report, plain in ((summary, junctions.junction_summary(rows)), (records, junctions.junction_records(rows)),
                          (metadata, junctions.junction_metadata(rows)), (junctions.vehicle_mix(back), junctions.vehicle_mix(rows)),
                          (junctions.peak_hours(back), junctions.peak_hours(rows)), (junctions.hourly_trend(back), junctions.hourly_trend(rows)),
                          (junctions.vehicle_texts(back), junctions.vehicle_texts(rows))):
        assert exchanges(report) == 0 < exchanges(plain)
        assert sorted(map(str, report.collect())) == sorted(map(str, plain.collect()))


def test_overwriting(spark, stored, tmp_path):
    rows, _ = stored
    path = str(tmp_path / "again")
    snapshot.write_bucketed(rows, path, 4)
    snapshot.write_bucketed(rows.where("id % 2 = 0"), path, 4)
    assert snapshot.read_bucketed(spark, path, 4).count() == rows.where("id % 2 = 0").count()
