import csv
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import scoring
from kerbline.operators import approval, junctions
from kerbline.plans import dashboard, publish_hotspots, score_tickets
from kerbline.sources import snapshot, tickets
from kerbline.streaming import scores


def raw_csv(path, n=400):
    rng = random.Random(6)
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "created_datetime", "vehicle_type", "violation_type", "location", "junction_name",
                      "police_station", "validation_status", "latitude", "longitude"])
        for i in range(n):
            car = rng.random() < 0.5
            out.writerow([
                i, f"2024-0{1 + i % 5}-11 {i % 24:02d}:00:00+00:00", "CAR" if car else "SCOOTER",
                rng.choice(['["WRONG PARKING"]', '["NO PARKING","DOUBLE PARKING"]', "", "TOWED"]),
                "5th Main Road", rng.choice(["BTP1 - A", "BTP2 - B", "", "Circle"]), f"S{i % 3}",
                ("approved" if car else "rejected") if i % 4 else "",
                12.9 + rng.randint(0, 3) * 0.0005, 77.5 + rng.randint(0, 3) * 0.0005])


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    raw_csv(folder / "raw.csv")
    paths = {k: str(folder / k) for k in ("staging", "scored", "model", "hotspots", "top")}
    score_tickets.run(spark, str(folder / "raw.csv"), paths["staging"], paths["scored"], paths["model"], rounds=4, by_month=True)
    publish_hotspots.run(spark, paths["scored"], paths["hotspots"], paths["top"])
    return {"raw": str(folder / "raw.csv"), "folder": folder, **paths}


def test_snapshot(spark, job):
    scored = snapshot.read_scored(spark, job["scored"])
    assert scored.columns == list(C.SCORED_COLUMNS)
    assert scored.count() == 400
    assert scored.agg(F.min("cluster_label"), F.max("cluster_label")).first()[1] >= 0
    assert scored.where("approval_probability not between 0 and 1").count() == 0
    plan = scored.where("month = 2").select("cis")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    plan = scored.where("cis >= 1.5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cis,1.5)" in plan and "ReadSchema: struct<id:string,cis:double>" in plan


def test_model_round_trip(spark, job):
    model = approval.ApprovalModel.load(spark, job["model"])
    staged = spark.read.parquet(job["staging"] + "/tickets")
    again = {r.id: r.approval_probability for r in approval.score_approval(model, staged).select("id", "approval_probability").collect()}
    stored = {r.id: r.approval_probability for r in snapshot.read_scored(spark, job["scored"]).collect()}
    assert again == stored
    loss = approval.validation_loss(model, staged).first()
    assert 0 < loss.log_loss < math.log(2) and loss.n == approval.validation_rows(staged).count()


def test_rejects_and_duplicates_are_reported(spark, tmp_path):
    raw_csv(tmp_path / "raw.csv", 60)
    with open(tmp_path / "raw.csv", "a") as f:
        f.write("FK7,soon,CAR,NO PARKING,,,S1,approved,x,77.5\n59,2024-01-01 10:00:00 PM,CAR,NO PARKING,,,S1,approved,12.9,77.5\n,,,,,,,,,\n")
    out = {k: str(tmp_path / k) for k in ("staging", "scored")}
    score_tickets.run(spark, str(tmp_path / "raw.csv"), out["staging"], out["scored"], rounds=1)
    lost = {r.id: r.rejected for r in spark.read.parquet(out["staging"] + "/rejected").collect()}
    assert lost == {"FK7": ["created_datetime", "latitude"], None: ["id"]}
    assert [(r.id, r.copies) for r in spark.read.parquet(out["staging"] + "/duplicates").collect()] == [("59", 2)]
    assert spark.read.parquet(out["scored"]).where("id = '59' AND hour = 22").count() == 1


def test_published_lists(spark, job):
    scored = snapshot.read_scored(spark, job["scored"])
    records = junctions.junction_hotspots(scored).orderBy("id").collect()
    lines = [json.loads(r.value) for r in spark.read.text(job["hotspots"]).collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [json.loads(json.dumps(r.asDict(True))) for r in records]
    top = snapshot.read_top(spark, job["top"]).orderBy("position").collect()
    assert [r.position for r in top] == list(range(1, len(top) + 1))
    assert [r.junction_name for r in top] == [r["name"] for r in records]
    fed = publish_hotspots.feed_rows(spark, job["scored"], job["top"]).orderBy("id").collect()
    assert [r["name"] for r in fed] == [r["name"] for r in records]
    assert {r["jurisdiction"] for r in fed} == {r["jurisdiction"] for r in records}


def test_plain_top_list(spark, job):
    path = job["folder"] / "plain.csv"
    path.write_text("junction_name,violations,cis,recommendation\n BTP1 - A ,10,2.5, Tow \n,5,1.0,x\n\nNew,7,1.25,\n")
    rows = snapshot.read_top(spark, str(path), positioned=False).collect()
    assert [(r.position, r.junction_name, r.violations, r.cis, r.recommendation) for r in rows] == [
        (1, "BTP1 - A", 10, 2.5, "Tow"), (2, None, 5, 1.0, "x"), (3, "New", 7, 1.25, None)]
    fed = publish_hotspots.feed_rows(spark, job["scored"], str(path), positioned=False)
    assert {r.id: r.recommendation for r in fed.collect()} == {1: "Tow", 3: "Deploy Officers"}


def test_stream_scores_like_a_batch(spark, job, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    (incoming / "a.csv").write_text(open(job["raw"]).read())
    stream = scores.scored_stream(spark, str(incoming))
    assert stream.isStreaming
    scores.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = scoring.score(tickets.read_violations(spark, job["raw"]))
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert streamed.count() == 400
    assert batch.exceptAll(streamed).count() == 0


def test_no_judged_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, "pending")], "id long, validation_status string")
    assert approval.fit_approval(rows) is None
    assert {r.approval_probability for r in approval.score_approval(None, rows).collect()} == {0.85}


def test_split_and_encoders(spark):
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, "approved").when(F.col("id") % 3 == 1, "rejected").alias("validation_status"),
        F.concat(F.lit("v"), F.col("id") % 11).alias("vehicle_type"), F.lit("S").alias("police_station"),
        F.concat(F.lit("p"), F.col("id") % 5).alias("primary_violation"))
    train, held = approval.train_rows(rows), approval.validation_rows(rows)
    assert train.join(held, "id").count() == 0
    assert train.count() + held.count() == approval.labelled(rows).count() == 2667
    assert 0.75 < train.count() / 2667 < 0.85
    encoders = approval.fit_encoders(rows)
    codes = {r.vehicle_type: r.code for r in encoders["vehicle_type"].collect()}
    assert codes == {v: i for i, v in enumerate(sorted(codes))} and len(codes) == 11
    assert approval.encode(rows, encoders).where("vehicle_type_enc is null").count() == 0


def test_dashboard_page(spark, job):
    page = dashboard.run(spark, job["scored"], station="S1", min_cis=0.1, compliance_rate=50.0, units=1, per_unit=2)
    rows = snapshot.read_scored(spark, job["scored"]).where("police_station = 'S1' AND cis >= 0.1")
    assert page["kpis"].first().violations == rows.count()
    clusters = page["clusters"].collect()
    assert {c.cluster_label for c in clusters} == {r.cluster_label for r in rows.where("cluster_label <> -1").select("cluster_label").distinct().collect()}
    assert page["patrols"].first().route == " -> ".join(f"Hotspot #{c.cluster_label}" for c in sorted(clusters, key=lambda c: -c.economic_loss)[:2])


def test_trees_run_once(spark, job):
    """The scores are read back from a table; the trees are in no plan behind them."""
    staged = spark.read.parquet(job["staging"] + "/tickets")
    plan = score_tickets.score_and_cluster(staged, rounds=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "probability" in plan and "UDF" not in plan


def test_fit_on_a_bounded_sample(spark, job):
    staged = spark.read.parquet(job["staging"] + "/tickets")
    model = approval.fit_approval(staged, rounds=1, max_labelled=100)
    assert approval.score_approval(model, staged).count() == staged.count()


def test_fit_uses_all_cores(spark, monkeypatch):
    """Rows that come in one partition, all with one id, are dealt over the cores before the fit reads them again and again."""
    rows = spark.range(800).coalesce(1).select(
        F.lit(7).alias("id"), F.when(F.col("id") % 3 == 0, "approved").otherwise("rejected").alias("validation_status"),
        F.lit("v").alias("vehicle_type"), F.lit("S").alias("police_station"), F.lit("p").alias("primary_violation"),
        (F.col("id") % 24).cast("int").alias("hour"), (F.col("id") % 7).cast("int").alias("day_of_week"), F.lit(1).alias("month"),
        *[F.lit(1.0).alias(c) for c in ("w_size", "w_type", "w_road")])
    monkeypatch.setattr(approval, "train_rows", approval.labelled)
    kept = []
    monkeypatch.setattr(approval, "checkpoint", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    assert approval.fit_approval(rows, rounds=1) is not None
    parts = [r["count"] for r in kept[-1].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 800 and len(parts) == spark.sparkContext.defaultParallelism and max(parts) < 400


def test_stream_scores_with_the_compiled_model(spark, job, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    (incoming / "a.csv").write_text(open(job["raw"]).read())
    stream = scores.scored_stream(spark, str(incoming), job["model"])
    assert stream.isStreaming
    scores.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = {r.id: r.approval_probability for r in snapshot.read_scored(spark, job["scored"]).collect()}
    streamed = {r.id: r.approval_probability for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed.keys() == stored.keys() and all(abs(streamed[i] - stored[i]) < 1e-12 for i in stored)


def test_checks_of_the_scores_fail_on_shuffled_labels(spark, monkeypatch):
    """A model of labels dealt by a hash says nothing about the true ones, and the queries notice."""
    from kerbline.catalog import queries
    from kerbline.catalog.tables import tickets as all_tickets

    # Approval follows the hour, so that a few rounds learn it; judged rows are those of the tables.
    truth = F.when(F.hour("created_datetime") < 12, "rejected").otherwise("approved")
    dealt = F.when(F.xxhash64("id") % 5 == 0, "approved").otherwise("rejected")
    rows = scoring.score(all_tickets(spark, "/root/testdata/sf0.001")).where("validation_status IS NOT NULL")
    rows = rows.withColumn("validation_status", truth).cache()
    for labels, passes in ((truth, True), (dealt, False)):
        model = approval.fit_approval(rows.withColumn("validation_status", labels), rounds=10)
        monkeypatch.setattr(queries, "_fitted", lambda *_: (model, approval.score_approval(model, rows)))
        assert queries.approval_logloss(spark, "").first().is_bounded == passes
        assert queries.approval_share(spark, "").first().meets_share == passes
        assert queries.approval_repeats(spark, "").where("NOT same_score").count() == 0
    assert queries.approval_compiled(spark, "").where("NOT agrees").count() == 0
    from kerbline.operators.trees import Ensemble

    wrong = Ensemble({0: {0: (None, None, None, None, 0.25)}})
    monkeypatch.setattr(approval, "fitted_ensemble", lambda *_: wrong)
    assert queries.approval_compiled(spark, "").where("NOT agrees").count() > 0


def test_compiled_trees(spark):
    from kerbline.operators.trees import NODE, Ensemble

    nodes = [(0, 0, 1, 0.5, 1, 2, None), (0, 1, None, None, None, None, -1.0), (0, 2, 0, 2.0, 3, 4, None),
             (0, 3, None, None, None, None, 0.25), (0, 4, None, None, None, None, 4.0)]
    ensemble = Ensemble.of([dict(zip(NODE.fieldNames(), n)) for n in nodes])
    rows = spark.createDataFrame([(2.0, 0.5), (2.0, 0.6), (2.1, 9.0), (float("nan"), 1.0), (1.0, float("nan")), (None, 1.0)], "a double, `b c` double")
    assert [r.m for r in rows.select(ensemble.margin(["a", "b c"]).alias("m")).collect()] == [-1.0, 0.25, 4.0, 4.0, 0.25, None]
    assert rows.select(Ensemble({}).margin(["a"]).alias("m")).first().m == 0.0
    many = Ensemble({i: ensemble.trees[0] for i in range(200)})
    frame = rows.select(many.margin(["a", "b c"]).alias("m"))
    assert [r.m for r in frame.collect()] == [-200.0, 50.0, 800.0, 800.0, 50.0, None]
    assert many.table(spark).count() == 1000 and Ensemble.of(many.table(spark).collect()) == many
