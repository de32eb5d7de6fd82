"""The registered queries: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.catalog.tables import (
    odd_coordinates, published, raw_texts, roads, scored, street_tickets, tickets, with_probability,
)
from kerbline.functions import bands, rounding, scoring
from kerbline.operators import (
    approval, audit, clusters, corridors, cube, dbscan, dispatch, evaluation, explore, feed, junctions, ranking, search, trees,
)
from kerbline.operators.cluster_state import ClusterState
from kerbline.operators.junction_state import JunctionState
from kerbline.plans import dashboard
from kerbline.session import Written
from kerbline.sources import dimensions, snapshot
from kerbline.sources.tickets import read_violations, rejected_counts, type_violations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATION, VEHICLE, MIN_CIS, COMPLIANCE = "Station 3", "CAR", 1.5, 25.0
UNITS, PER_UNIT = 4, 3
FEED_LINES = 50


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junctions.junction_hotspots(scored(spark, sf_dir, per_user=True))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspot records without their rank, which totals do not need."""
    return junctions.junction_records(scored(spark, sf_dir, per_user=True))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.attach_clusters(scored(spark, sf_dir))


def _pairs_text(column: str, value: str):
    return F.array_join(
        F.transform(column, lambda v: F.concat(v["name"], F.lit("="), v[value].cast("string"))), ",")


# --- tickets -----------------------------------------------------------------
@query
def clean_nulls(spark, sf_dir):
    return scoring.clean(tickets(spark, sf_dir)).select(
        "id", "vehicle_type", "location", "junction_name", "police_station", "validation_status")


@query
def time_features(spark, sf_dir):
    return scoring.with_time_parts(tickets(spark, sf_dir)).select("id", "hour", "day_of_week", "month")


@query
def vehicle_weight(spark, sf_dir):
    return scoring.score(tickets(spark, sf_dir)).select("id", "vehicle_type", "w_size")


@query
def violation_list(spark, sf_dir):
    rows = tickets(spark, sf_dir).select("id", scoring.violation_list(F.col("violation_type")).alias("violations"))
    return rows.select("id", F.posexplode("violations").alias("place", "violation"))


@query
def primary_violation(spark, sf_dir):
    return scoring.score(tickets(spark, sf_dir)).select("id", "primary_violation")


@query
def severity_weight(spark, sf_dir):
    return scoring.score(tickets(spark, sf_dir)).select("id", "w_type")


@query
def road_weight(spark, sf_dir):
    return scoring.score(tickets(spark, sf_dir)).select("id", "w_road")


@query
def cis_cost(spark, sf_dir):
    return scoring.score(tickets(spark, sf_dir)).select(
        "id", "cis", "delay_hours", "economic_loss_inr", "fuel_wasted_liters", "co2_wasted_kg")


@query
def mixed_times(spark, sf_dir):
    """Time texts in several spellings."""
    return type_violations(raw_texts(spark, sf_dir)).select("id", F.col("created_datetime").cast("string").alias("created"))


@query
def rejected_values(spark, sf_dir):
    """How many texts of each typed column did not parse."""
    return rejected_counts(raw_texts(spark, sf_dir))


@query
def odd_violation_texts(spark, sf_dir):
    """Violation lists written as objects, with trailing text, escapes and blanks."""
    rows = type_violations(raw_texts(spark, sf_dir)).select("id", scoring.violation_list(F.col("violation_type")).alias("violations"))
    return rows.select("id", F.array_join("violations", "|").alias("violations"))


# --- junctions ---------------------------------------------------------------
@query
def junction_summary(spark, sf_dir):
    return junctions.junction_summary(scored(spark, sf_dir, per_user=True))


@query
def top_junctions(spark, sf_dir):
    return junctions.top_junctions(scored(spark, sf_dir))


@query
def top_details(spark, sf_dir):
    return junctions.top_details(scored(spark, sf_dir))


@query
def vehicle_mix(spark, sf_dir):
    return junctions.vehicle_mix(scored(spark, sf_dir))


@query
def vehicle_mix_top(spark, sf_dir):
    mixes = junctions.vehicle_texts(scored(spark, sf_dir, per_user=True))
    return mixes.select(
        "junction_name", "vehicle_mix", "vehicle_mix_detail", "two_vehicles",
        _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"))


@query
def peak_hour(spark, sf_dir):
    return junctions.peak_hours(scored(spark, sf_dir, per_user=True))


@query
def hourly_trend(spark, sf_dir):
    trends = junctions.hourly_trend(scored(spark, sf_dir, per_user=True))
    return trends.select("junction_name", F.inline("trend_data").alias("hour_name", "cis"))


@query
def trend_multiplier(spark, sf_dir):
    trends = junctions.trend_multipliers(scored(spark, sf_dir, per_user=True))
    return trends.select("junction_name", F.explode("trend_multipliers").alias("hour", "multiplier"))


@query
def hotspot_rank(spark, sf_dir):
    return _hotspots(spark, sf_dir).select("id", "name", "violations")


@query
def hotspot_metrics(spark, sf_dir):
    metrics = explore.capacity_markers(_hotspots(spark, sf_dir))
    return metrics.select(
        "id", "name", "jurisdiction", "violations", "raw_cis", "cis", "status", "action", "expected_improvement",
        "affected_vehicles", "avg_delay", "capacity_loss", "economic_cost", "co2_impact", "lat", "lng",
        "capacity_band", "capacity_size",
        bands.urgency_band(F.col("cis")).alias("urgency"),
        bands.reason(F.col("cis")).alias("reason"),
        bands.realized_recovery(F.col("expected_improvement"), COMPLIANCE).alias("recovery"),
        rounding.round_js(F.col("capacity_loss") * bands.compliance_factor(COMPLIANCE)).alias("capacity_left"),
        rounding.round_js(F.col("economic_cost") * bands.compliance_factor(COMPLIANCE)).alias("cost_left"),
    )


@query
def junction_records(spark, sf_dir):
    """Full records of the junctions, arrays as text."""
    return junctions.junction_hotspots(scored(spark, sf_dir)).select(
        "id", "name", "jurisdiction", "violations", "raw_cis", "cis", "status", "recommendation", "vehicle_mix",
        "peak_hour", "peak_hour_val", "peak_hour_violations", "lat", "lng",
        _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"),
        _pairs_text("trend_data", "CIS").alias("trend"))


def _followed(spark, sf_dir, per_user=False):
    """The state after all tickets have come in five batches, out of order, one of them twice, with a merge in between."""
    rows, e = scored(spark, sf_dir, per_user), F.col("id")
    state = JunctionState(spark, f"{Written(spark, 'state').root}/junctions")
    for step in (3, 0, 3, "merge", 3, 4, 1, "merge", 0, 2):
        if step == "merge":
            state.merge()
        else:
            state.apply(step, rows.where(e % 5 == step))
    return state


@query
def incremental_summary(spark, sf_dir):
    """The junction summary without reading any ticket twice."""
    return _followed(spark, sf_dir, per_user=True).summary()


@query
def incremental_records(spark, sf_dir):
    """Mix, busiest hour and trend of the junctions from the same state."""
    return _followed(spark, sf_dir).records().select(
        "name", "jurisdiction", "violations", "raw_cis", "cis", "vehicle_mix", "peak_hour", "peak_hour_val", "peak_hour_violations",
        "lat", "lng", _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"), _pairs_text("trend_data", "CIS").alias("trend"))


@query
def bucketed_records(spark, sf_dir):
    """Records from a snapshot written and read back by junction buckets: tickets are grouped where they lie."""
    path = f"{Written(spark, 'snapshot').root}/bucketed"
    snapshot.write_bucketed(scored(spark, sf_dir).withColumn("cluster_label", F.lit(C.NOISE)), path, 16)
    rows = snapshot.read_bucketed(spark, path, 16)
    return junctions.records_of(junctions.fold_junctions(rows), placed=True).select(
        "name", "jurisdiction", "violations", "raw_cis", "cis", "vehicle_mix", "peak_hour", "peak_hour_val", "peak_hour_violations",
        "lat", "lng", _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"), _pairs_text("trend_data", "CIS").alias("trend"))


@query
def hotspot_feed(spark, sf_dir):
    """Feed of a published list: the busiest user-level junctions, among lines that are blank, renamed or without advice."""
    rows = scored(spark, sf_dir, per_user=True)
    lines = published(junctions.top_junctions(rows, FEED_LINES))
    return feed.hotspot_feed(lines, junctions.junction_metadata(feed.listed_only(rows, lines))).select(
        "id", "name", "jurisdiction", "violations", "raw_cis", "cis", "status", "action", "recommendation",
        "expected_improvement", "vehicle_mix", "peak_hour", "peak_hour_val", "peak_hour_violations",
        "affected_vehicles", "avg_delay", "capacity_loss", "economic_cost", "co2_impact", "lat", "lng",
        _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"),
        _pairs_text("trend_data", "CIS").alias("trend"))


# --- exploration -------------------------------------------------------------
@query
def filter_rows(spark, sf_dir):
    return explore.filter_violations(scored(spark, sf_dir), STATION, VEHICLE, MIN_CIS).select(
        "id", "police_station", "vehicle_type", "cis")


@query
def filter_category(spark, sf_dir):
    hotspots = _hotspots(spark, sf_dir)
    return explore.filter_hotspots(hotspots, category="TANKER", min_cis=5.0).select("id", "name", "vehicle_mix", "cis")


@query
def search_hotspots(spark, sf_dir):
    return explore.filter_hotspots(_hotspots(spark, sf_dir), query="Circle 1").select("id", "name", "jurisdiction")


SEARCHES = ("Circle 1", "btp00", "n 3", "#12", "e", "- JUNCTION #2", "station 7", "nowhere", " ", "circle 11 #1")


@query
def search_index(spark, sf_dir):
    """Hotspots found for several texts through the written posting lists."""
    hotspots = Written(spark, "search").keep(_hotspots(spark, sf_dir).select("id", "name", "jurisdiction"))
    index = Written(spark, "search").keep(search.build_index(hotspots))
    found = [search.search(index, hotspots, text).select(F.lit(text).alias("query"), "id", "name") for text in SEARCHES]
    return functools.reduce(DataFrame.unionByName, found)


@query
def kpis(spark, sf_dir):
    return explore.kpis(_labelled(spark, sf_dir), COMPLIANCE)


@query
def vehicle_top6(spark, sf_dir):
    return explore.top_vehicle_counts(scored(spark, sf_dir))


@query
def hour_histogram(spark, sf_dir):
    return explore.hour_histogram(scored(spark, sf_dir))


@query
def summary_metrics(spark, sf_dir):
    return explore.summary_metrics(explore.filter_hotspots(_records(spark, sf_dir), min_cis=3.0), COMPLIANCE)


@query
def focus_top5(spark, sf_dir):
    top = explore.filter_hotspots(_hotspots(spark, sf_dir), station=STATION, focus=True)
    return top.select("id", "name", "cis", "expected_improvement")


@query
def focus_improvement(spark, sf_dir):
    return explore.focus_improvement(_records(spark, sf_dir))


@query
def focus_bounds(spark, sf_dir):
    return explore.focus_bounds(_records(spark, sf_dir))


@query
def priority_index(spark, sf_dir):
    return explore.priority_index(_hotspots(spark, sf_dir)).select("index_number", "id", "name", "cis")


@query
def facets(spark, sf_dir):
    rows = scored(spark, sf_dir)
    parts = [explore.facet(rows, c).withColumn("facet", F.lit(c)) for c in ("police_station", "vehicle_type")]
    return parts[0].unionByName(parts[1])


@query
def map_centre(spark, sf_dir):
    return explore.map_centre(scored(spark, sf_dir))


# --- corridors ---------------------------------------------------------------
@query
def corridor_links(spark, sf_dir):
    return corridors.link_corridors(roads(spark, sf_dir), _hotspots(spark, sf_dir)).drop("status")


@query
def corridor_hotspots(spark, sf_dir):
    """Linked hotspots per corridor, numbered, with their status."""
    hotspots = _hotspots(spark, sf_dir)
    links = corridors.link_corridors(roads(spark, sf_dir), hotspots)
    return corridors.numbered_links(links).select("id", "place", "name", "status")


@query
def corridor_stats(spark, sf_dir):
    return corridors.corridor_flags(roads(spark, sf_dir))


@query
def corridor_speeds(spark, sf_dir):
    return corridors.speed_comparison(roads(spark, sf_dir))


@query
def network_stats(spark, sf_dir):
    return corridors.network_stats(roads(spark, sf_dir))


# --- clusters ----------------------------------------------------------------
@query
def dbscan_core(spark, sf_dir):
    return dbscan.core_sites(scored(spark, sf_dir).where(clusters.high_impact()))


@query
def dbscan_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "cluster_label")


@query
def dbscan_odd_coordinates(spark, sf_dir):
    """Rows with missing, NaN and infinite coordinates are noise."""
    return clusters.attach_clusters(odd_coordinates(scored(spark, sf_dir))).select("id", "cluster_label")


@query
def cluster_summary_odd(spark, sf_dir):
    """Centres leave out coordinates that are not finite."""
    rows = clusters.attach_clusters(scored(spark, sf_dir))
    return clusters.cluster_summary(odd_coordinates(rows)).select("cluster_label", "lat", "lng", "violations_count")


@query
def dbscan_streets(spark, sf_dir):
    """Chains along streets, border points, noise and one crowded place; sites in step with the rows."""
    return clusters.attach_clusters(street_tickets(spark, sf_dir)).select("id", "cluster_label")


@query
def dbscan_incremental(spark, sf_dir):
    """The street clusters after the tickets have come in four batches, one of them twice; only cells near new tickets are opened."""
    rows, e = street_tickets(spark, sf_dir), F.col("id")
    state = ClusterState(spark, f"{Written(spark, 'state').root}/clusters")
    points = clusters.eligible_points(rows)
    for step in (2, 0, 2, 3, 1):
        state.apply(step, points.where(F.least(e * 7919 % 10, F.lit(3)) == step))
    return clusters.attach_sites(rows, state.sites()).select("id", "cluster_label")


@query
def cluster_summary_streets(spark, sf_dir):
    return clusters.cluster_summary(clusters.attach_clusters(street_tickets(spark, sf_dir)))


@query
def dbscan_labels_scored(spark, sf_dir):
    """Unlikely and unscored tickets stay out of the clusters."""
    return clusters.attach_clusters(with_probability(scored(spark, sf_dir))).select("id", "cluster_label")


@query
def hotspot_audit_scored(spark, sf_dir):
    return audit.audit_hotspots(clusters.attach_clusters(with_probability(scored(spark, sf_dir))), COMPLIANCE)


@query
def hotspot_count(spark, sf_dir):
    return clusters.hotspot_count(_labelled(spark, sf_dir))


@query
def cluster_summary(spark, sf_dir):
    return clusters.cluster_summary(_labelled(spark, sf_dir))


@query
def priority_tier(spark, sf_dir):
    ranked = ranking.rank_by_loss(clusters.cluster_summary(_labelled(spark, sf_dir)), COMPLIANCE)
    return clusters.with_tiers(ranked).select(
        "cluster_label", "priority_tier", "severity", "size", "violations_count", "economic_loss_compliant")


@query
def topsis(spark, sf_dir):
    criteria = clusters.cluster_criteria(_labelled(spark, sf_dir))
    return ranking.topsis(criteria, ["total_cis", "economic_loss", "approval_rate", "recidivism"]).select(
        "cluster_label", "closeness")


@query
def hotspot_audit(spark, sf_dir):
    return audit.audit_hotspots(_labelled(spark, sf_dir), COMPLIANCE)


@query
def cluster_drilldown(spark, sf_dir):
    return audit.for_cluster(_labelled(spark, sf_dir), 0).select("id", "cis")


@query
def violation_counts(spark, sf_dir):
    return audit.violation_counts(_labelled(spark, sf_dir))


@query
def weight_contributions(spark, sf_dir):
    return audit.weight_contributions(_labelled(spark, sf_dir))


# --- a dashboard page on filtered rows ---------------------------------------
def _page(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return dashboard.page(_labelled(spark, sf_dir), station=STATION, min_cis=MIN_CIS, compliance_rate=COMPLIANCE, units=UNITS, per_unit=PER_UNIT)


@query
def filtered_kpis(spark, sf_dir):
    return _page(spark, sf_dir)["kpis"]


SHOWN_CIS = 7.0  # least normalized score of the hotspots a page shows
MIN_SCORES = (0.0, 0.8, 1.5, 1.501, 3.0, 7.25, 1000.0)


@query
def kpi_cube(spark, sf_dir):
    """The totals for every station and vehicle type, and for all, at several least scores: from the cube, not the tickets."""
    folded = Written(spark, "cube").keep(cube.fold_scores(_labelled(spark, sf_dir)))
    built = Written(spark, "cube").keep(cube.build_cube(folded))
    cells = built.select(F.coalesce("police_station", F.lit(explore.ALL)).alias("station"), F.coalesce("vehicle_type", F.lit(explore.ALL)).alias("vehicle")).distinct()
    requests = cells.withColumn("min_cis", F.explode(F.array(*[F.lit(m) for m in MIN_SCORES])))
    return cube.filtered_kpis(built, requests, COMPLIANCE)


@query
def filtered_clusters(spark, sf_dir):
    return _page(spark, sf_dir)["clusters"].select(
        "cluster_label", "lat", "lng", "violations_count", "avg_cis", "economic_loss_compliant", "police_station", "priority_tier")


@query
def filtered_patrols(spark, sf_dir):
    return _page(spark, sf_dir)["patrols"].select(
        "patrol", "route", F.round("loss", 4).alias("loss"), F.round("avg_cis", 6).alias("avg_cis"))


# --- dispatch ----------------------------------------------------------------
def _patrol_plan(spark: SparkSession, sf_dir: str, compliance: float) -> DataFrame:
    summary = clusters.cluster_summary(_labelled(spark, sf_dir))
    return dispatch.dispatch_plan(dispatch.assign_patrols(summary, UNITS, PER_UNIT, compliance)).select(
        "patrol", "route", F.round("loss", 4).alias("loss"), F.round("avg_cis", 6).alias("avg_cis"))


@query
def patrol_assignment(spark, sf_dir):
    return _patrol_plan(spark, sf_dir, COMPLIANCE)


@query
def patrol_assignment_full(spark, sf_dir):
    """At full compliance nothing is left of any loss; the plan still covers the largest ones."""
    return _patrol_plan(spark, sf_dir, 100.0)


@query
def dispatch_top3(spark, sf_dir):
    return dispatch.dispatch_top(_records(spark, sf_dir))


@query
def patrol_lines(spark, sf_dir):
    return dispatch.patrol_lines(_records(spark, sf_dir), dimensions.patrol_units(spark))


@query
def corridor_status(spark, sf_dir):
    """The hotspots listed for each corridor, looked up among those the page still shows; the others are inactive."""
    hotspots = Written(spark, "corridors").keep(_hotspots(spark, sf_dir).select("id", "name", "cis", "status", "lat", "lng"))
    lines = roads(spark, sf_dir)
    listed = corridors.with_nearby(lines, corridors.link_corridors(lines, hotspots))
    return corridors.linked_status(listed, hotspots.where(F.col("cis") >= SHOWN_CIS)).select("id", "place", "name", "status")


# --- files -------------------------------------------------------------------
def _folder(spark):
    return Written(spark, "files").root


@query
def csv_tickets(spark, sf_dir):
    """Tickets written as CSV, with line breaks in some quoted locations, and read back in splits."""
    path, e = f"{_folder(spark)}/raw", F.substring("id", 2, 20).cast("long")
    rows = raw_texts(spark, sf_dir).withColumn("location", F.when(e % 7 == 0, F.concat("location", F.lit('\n"corner", '), e.cast("string"))).otherwise(F.col("location")))
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = read_violations(spark, path, multi_line=True)
    return back.select("id", F.col("created_datetime").cast("string").alias("created"), "location", "junction_name")


@query
def snapshot_round_trip(spark, sf_dir):
    """The snapshot by month, written and read back."""
    path = f"{_folder(spark)}/scored"
    snapshot.write_scored(scored(spark, sf_dir).withColumn("cluster_label", F.lit(C.NOISE)), path, by_month=True)
    return snapshot.read_scored(spark, path).select(
        "id", "latitude", "longitude", "location", "vehicle_type", "police_station", "junction_name", "validation_status", "hour", "day_of_week", "month",
        "cis", "delay_hours", "economic_loss_inr", "approval_probability", "cluster_label", "w_size", "w_type", "w_road")


@query
def top_list_round_trip(spark, sf_dir):
    """The published list as CSV, written and read back."""
    path = f"{_folder(spark)}/top"
    snapshot.write_top(junctions.top_junctions(scored(spark, sf_dir)), path)
    return snapshot.read_top(spark, path)


@query
def hotspots_round_trip(spark, sf_dir):
    """The ranked records as JSON lines, written and read back; arrays as text."""
    path, records = f"{_folder(spark)}/hotspots", junctions.junction_hotspots(scored(spark, sf_dir))
    snapshot.write_hotspots(records, path)
    return snapshot.read_hotspots(spark, path, records.schema).select(
        "id", "name", "jurisdiction", "violations", "raw_cis", "cis", "status", "recommendation", "vehicle_mix",
        "peak_hour", "peak_hour_val", "peak_hour_violations", "lat", "lng",
        _pairs_text("vehicle_mix_data", "percentage").alias("mix_data"), _pairs_text("trend_data", "CIS").alias("trend"))


@query
def model_round_trip(spark, sf_dir):
    """Whether the model saved and loaded again says of every ticket what it said before, and its stored trees with it."""
    path, (model, scores) = f"{_folder(spark)}/model", _fitted(spark, sf_dir)
    model.save(path)
    before = scores.withColumnRenamed("approval_probability", "before")
    again = approval.score_approval(approval.ApprovalModel.load(spark, path), before).withColumnRenamed("approval_probability", "loaded")
    both = approval.score_compiled(approval.CompiledApproval.load(spark, path), again)
    same = (F.col("loaded") == F.col("before")) & (F.abs(F.col("approval_probability") - F.col("before")) <= 1e-12)
    return both.select("id", same.alias("agrees"))


# --- approval model ----------------------------------------------------------
@query
def encoders(spark, sf_dir):
    rows = scoring.score(tickets(spark, sf_dir))
    tables = [
        t.select(F.lit(c).alias("field"), F.col(c).alias("value"), "code")
        for c, t in approval.fit_encoders(rows).items()
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query
def approval_split(spark, sf_dir):
    return approval.with_part(approval.labelled(tickets(spark, sf_dir))).groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum("target").alias("approved"))


_fits: dict[tuple[str, str], tuple[approval.ApprovalModel, DataFrame]] = {}


def _fitted(spark, sf_dir):
    """The model fitted on the tickets, and the tickets it has scored as a written table: once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fits:
        written = Written(spark, "approval")
        # Read by five passes: parsed once, and spread over the cores even if the file is one row group.
        rows = scoring.score(tickets(spark, sf_dir))
        rows = written.keep(rows.repartition(spark.sparkContext.defaultParallelism, "id", "created_datetime"))
        model = approval.fit_approval(rows)
        _fits[key] = model, written.keep(approval.score_approval(model, rows))
        written.drop(rows)
    return _fits[key]


@query
def approval_scores(spark, sf_dir):
    """Every ticket's score, as what must hold for it: a probability, or the default without a model."""
    return _fitted(spark, sf_dir)[1].select("id", F.col("approval_probability").between(0.0, 1.0).alias("is_probability"))


@query
def approval_logloss(spark, sf_dir):
    """Validation rows, and whether the mean loss is below that of always saying their share of approvals."""
    loss = approval.loss_of(approval.validation_rows(_fitted(spark, sf_dir)[1]))
    return loss.select("n", (F.col("log_loss") < F.col("base_loss")).alias("is_bounded"))


@query
def approval_share(spark, sf_dir):
    """Judged rows and approvals, and whether the mean score is within two hundredths of their share."""
    judged = approval.labelled(_fitted(spark, sf_dir)[1])
    sums = judged.agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("approved"), F.avg("approval_probability").alias("mean"))
    return sums.select("n", "approved", (F.abs(F.col("mean") - F.col("approved") / F.col("n")) < 0.02).alias("meets_share"))


@query
def approval_repeats(spark, sf_dir):
    """Per distinct model input: the tickets that share it, and whether they share the score."""
    inputs = ["hour", "day_of_week", "month", "w_size", "w_type", "w_road", *approval.ENCODED]
    score = F.col("approval_probability")
    return _fitted(spark, sf_dir)[1].groupBy(*inputs).agg(F.count(F.lit(1)).alias("n"), (F.min(score) == F.max(score)).alias("same_score"))


@query
def approval_compiled(spark, sf_dir):
    """Whether the compiled columns say of a ticket what the model says, to 1e-12."""
    model, scores = _fitted(spark, sf_dir)
    both = approval.score_compiled(approval.CompiledApproval.of(spark, model), scores.withColumnRenamed("approval_probability", "by_model"))
    return both.select("id", (F.abs(F.col("by_model") - F.col("approval_probability")) <= 1e-12).alias("agrees"))


@query
def approval_rank(spark, sf_dir):
    """Rank statistic of given probabilities against the verdicts."""
    return evaluation.rank_statistic(with_probability(scored(spark, sf_dir)))


@query
def approval_calibration(spark, sf_dir):
    return evaluation.calibration(with_probability(scored(spark, sf_dir)))


# A stated ensemble over (hour, w_type, w_road): tree, node, feature, threshold, left, right, value.
STATED_TREES = (
    (0, 0, 0, 9.5, 1, 2, None), (0, 1, 1, 1.2, 3, 4, None), (0, 2, 2, 1.6, 5, 6, None),
    (0, 3, None, None, None, None, -0.5), (0, 4, None, None, None, None, 0.125), (0, 5, None, None, None, None, 0.375), (0, 6, None, None, None, None, 1.25),
    (1, 0, 1, 1.5, 1, 2, None), (1, 1, None, None, None, None, -0.25), (1, 2, 0, 17.0, 3, 4, None),
    (1, 3, None, None, None, None, 0.75), (1, 4, None, None, None, None, -1.0), (2, 0, None, None, None, None, 0.0625),
)


@query
def tree_margins(spark, sf_dir):
    """A stated ensemble as columns, on every ticket."""
    ensemble = trees.Ensemble.of([dict(zip(trees.NODE.fieldNames(), row)) for row in STATED_TREES])
    return scored(spark, sf_dir).select("id", ensemble.margin(["hour", "w_type", "w_road"]).alias("margin"))


@query
def approval_default(spark, sf_dir):
    """Only tickets nobody has judged: no model is trained."""
    rows = scoring.score(tickets(spark, sf_dir)).where(F.col("validation_status").isNull())
    return approval.score_approval(approval.fit_approval(rows), rows).select("id", "approval_probability")
