"""Hotspots per named junction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands, rounding, scoring
from kerbline.operators.ranking import global_rank
from kerbline.session import checkpoint


FOLD_KEYS = ("junction_name", "police_station", "vehicle_type", "hour")  # what every junction report can be told from


def named_junctions(df: DataFrame) -> DataFrame:
    return df.where(F.col("junction_name") != C.NO_JUNCTION)


def fold_tickets(df: DataFrame, *keys: str) -> DataFrame:
    """The one pass over tickets: exact long sums per key combination.

    Every buffer is a long, so Spark aggregates by hash before and after the
    shuffle; the first station is found later among the few folded rows.
    """
    return scoring.with_milli(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cis_milli").alias("milli"),
        F.min("id").alias("first_id"),
        *rounding.degree_parts("lat", "latitude"),
        *rounding.degree_parts("lng", "longitude"),
    )


def fold_junctions(df: DataFrame) -> DataFrame:
    """The folded rows of all junction reports; rows of several batches can be folded again with ``merge_folds``."""
    return fold_tickets(named_junctions(df), *FOLD_KEYS)


def merge_folds(folded: DataFrame) -> DataFrame:
    """Folded rows with equal keys as one: counts and long sums add up, the first id is the smallest."""
    return folded.groupBy(*FOLD_KEYS).agg(
        F.sum("n").alias("n"), F.sum("milli").alias("milli"), F.min("first_id").alias("first_id"),
        *rounding.merge_degree_parts("lat"), *rounding.merge_degree_parts("lng"))


def merged_sums() -> list[Column]:
    """Second-level sums over folded rows."""
    return [
        F.sum("n").alias("violations"),
        F.sum("milli").alias("milli"),
        F.min_by("police_station", "first_id").alias("jurisdiction"),
        *rounding.merge_degree_parts("lat"),
        *rounding.merge_degree_parts("lng"),
    ]


def mean_cis() -> Column:
    return rounding.mean_of(F.col("milli"), F.col("violations"))


def junction_summary(df: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    """Count, mean score, totals, daily rates, centre and first station per junction."""
    return summary_of(fold_tickets(named_junctions(df), "junction_name", "police_station"), days)


def summary_of(folded: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    return folded.groupBy("junction_name").agg(*merged_sums()).select(
        "junction_name", "jurisdiction", "violations",
        mean_cis().alias("raw_cis"),
        scoring.loss_total(F.col("milli")).alias("economic_loss"),
        scoring.co2_total(F.col("milli")).alias("co2_wasted"),
        scoring.daily_loss(F.col("milli"), days).alias("economic_cost"),
        scoring.daily_co2(F.col("milli"), days).alias("co2_impact"),
        rounding.round_np(rounding.mean_degrees("lat"), 5).alias("lat"),
        rounding.round_np(rounding.mean_degrees("lng"), 5).alias("lng"),
    )


def vehicle_mix(df: DataFrame) -> DataFrame:
    """Tickets, percent and place of every vehicle type within its junction."""
    return mix_of(named_junctions(df).groupBy("junction_name", "vehicle_type").agg(F.count(F.lit(1)).alias("n")))


def mix_of(counts: DataFrame) -> DataFrame:
    """The same from tickets counted per junction and vehicle type."""
    total = F.sum("n").over(Window.partitionBy("junction_name"))
    return counts.withColumn("total", total).select(
        "junction_name", "vehicle_type", "n",
        bands.share_percent(F.col("n"), F.col("total")).alias("percentage"),
    )


def top_vehicles(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` vehicle types per junction, most tickets first, ties by name."""
    place = F.row_number().over(Window.partitionBy("junction_name").orderBy(F.desc("n"), F.asc("vehicle_type")))
    return vehicle_mix(df).withColumn("place", place).where(F.col("place") <= n)


def vehicle_texts(df: DataFrame) -> DataFrame:
    """Per junction: display mix of the top three (whole and one-decimal percents) and of the first two."""
    top = top_vehicles(df).withColumn("name", bands.clean_vehicle(F.col("vehicle_type")))
    entry = F.struct("place", "vehicle_type", "name", "percentage")
    listed = top.groupBy("junction_name").agg(F.sort_array(F.collect_list(entry)).alias("mix"))
    data = F.transform("mix", lambda v: F.struct(v["name"].alias("name"), rounding.round_one(v["percentage"]).alias("percentage")))
    return listed.select(
        "junction_name",
        _mix_text("mix", "name", 0).alias("vehicle_mix"),
        _mix_text("mix", "vehicle_type", 1).alias("vehicle_mix_detail"),
        bands.two_vehicle_text(data).alias("two_vehicles"),
        data.alias("vehicle_mix_data"),
    )


def _mix_text(mix: str, name: str, digits: int) -> Column:
    return F.array_join(
        F.transform(F.slice(mix, 1, 3), lambda v: bands.share_text(v[name], v["percentage"], digits)), ", ")


def peak_hours(df: DataFrame) -> DataFrame:
    """Busiest hour per junction; the earliest of equally busy ones."""
    counts = named_junctions(df).where(F.col("hour").isNotNull()).groupBy("junction_name", "hour").agg(
        F.count(F.lit(1)).alias("n"))
    return peaks_of(counts)


def peaks_of(counts: DataFrame) -> DataFrame:
    """The same from tickets counted per junction and hour."""
    return counts.groupBy("junction_name").agg(
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour_val"),
        F.max("n").alias("peak_hour_violations"),
    ).select(
        "junction_name", bands.hour_text(F.col("peak_hour_val")).alias("peak_hour"),
        "peak_hour_val", "peak_hour_violations",
        bands.peak_text(F.col("peak_hour_val"), F.col("peak_hour_violations")).alias("peak_hour_text"),
    )


def _hour_sums(milli: str, count: Column) -> list[Column]:
    return [
        part
        for h in C.TREND_HOURS
        for part in (
            F.sum(F.when(F.col("hour") == h, F.col(milli))).alias(f"milli_{h}"),
            F.sum(F.when(F.col("hour") == h, count)).alias(f"n_{h}"),
        )
    ]


def _fallback(hour: int) -> float:
    return C.QUIET_FACTOR if hour in C.QUIET_TREND_HOURS else C.BUSY_FACTOR


def _trend(raw: Column) -> Column:
    """Normalized mean score at seven hours; an hour without tickets gets a share of the mean."""
    return F.array(*[
        F.struct(
            F.lit(f"{h:02d}:00").alias("name"),
            bands.normalized_cis(
                F.coalesce(rounding.mean_of(F.col(f"milli_{h}"), F.col(f"n_{h}")), raw * _fallback(h))).alias("CIS"),
        )
        for h in C.TREND_HOURS
    ])


def _multipliers(raw: Column) -> Column:
    """Hour mean over junction mean at seven hours, as a map."""
    values = [
        F.coalesce(F.when(raw > 0, rounding.mean_of(F.col(f"milli_{h}"), F.col(f"n_{h}")) / raw), F.lit(_fallback(h)))
        for h in C.TREND_HOURS
    ]
    return F.map_from_arrays(F.array(*[F.lit(h) for h in C.TREND_HOURS]), F.array(*values))


def _hourly(df: DataFrame) -> DataFrame:
    milli = scoring.with_milli(named_junctions(df))
    sums = milli.groupBy("junction_name").agg(
        F.count(F.lit(1)).alias("violations"), F.sum("cis_milli").alias("milli"), *_hour_sums("cis_milli", F.lit(1)))
    return sums.withColumn("raw_cis", mean_cis())


def hourly_of(folded: DataFrame) -> DataFrame:
    """Sums per junction and trend hour from folded rows, for ``trends_of`` and ``multipliers_of``."""
    sums = folded.groupBy("junction_name").agg(F.sum("n").alias("violations"), F.sum("milli").alias("milli"), *_hour_sums("milli", F.col("n")))
    return sums.withColumn("raw_cis", mean_cis())


def trends_of(hourly: DataFrame) -> DataFrame:
    return hourly.select("junction_name", _trend(F.col("raw_cis")).alias("trend_data"))


def multipliers_of(hourly: DataFrame) -> DataFrame:
    return hourly.select("junction_name", _multipliers(F.col("raw_cis")).alias("trend_multipliers"))


def hourly_trend(df: DataFrame) -> DataFrame:
    return trends_of(_hourly(df))


def trend_multipliers(df: DataFrame) -> DataFrame:
    return multipliers_of(_hourly(df))


def _profiles(df: DataFrame) -> DataFrame:
    return _profiles_of(fold_junctions(df))


def _profiles_of(folded: DataFrame, placed: bool = False) -> DataFrame:
    """Everything known per junction from one pass over the tickets.

    The fold leaves one row per junction, station, vehicle and hour. These few
    rows are placed by junction once; counts per vehicle and per hour, the rank
    of vehicles and the final sums all use that placement. Tickets read from a
    snapshot bucketed by junction are ``placed`` already.
    """
    by_vehicle = Window.partitionBy("junction_name", "vehicle_type")
    by_hour = Window.partitionBy("junction_name", "hour")
    by_rank = Window.partitionBy("junction_name").orderBy(F.desc("vehicle_n"), F.asc("vehicle_type"))
    placed = (
        (folded if placed else folded.repartition("junction_name"))
        .withColumn("hour_n", F.sum("n").over(by_hour))
        .withColumn("vehicle_n", F.sum("n").over(by_vehicle))
        .withColumn("place", F.dense_rank().over(by_rank))
    )
    entry = F.struct("place", F.col("vehicle_type").alias("vehicle"), F.col("vehicle_n").alias("n"))
    seen = F.when(F.col("hour").isNotNull(), F.struct("hour_n", (-F.col("hour")).alias("early")))
    return placed.groupBy("junction_name").agg(
        *merged_sums(),
        F.sort_array(F.collect_set(F.when(F.col("place") <= 5, entry))).alias("mix"),
        F.max(seen).alias("peak"),
        *_hour_sums("milli", F.col("n")),
    ).withColumns({
        "raw_cis": mean_cis(),
        "peak_hour_val": -F.col("peak.early"),
        "peak_hour_violations": F.col("peak.hour_n"),
        "lat": rounding.round_np(rounding.mean_degrees("lat"), 5),
        "lng": rounding.round_np(rounding.mean_degrees("lng"), 5),
        "mix": F.transform("mix", lambda v: F.struct(
            bands.clean_vehicle(v["vehicle"]).alias("name"), v["vehicle"].alias("vehicle"),
            bands.share_percent(v["n"], F.col("violations")).alias("percentage"))),
    })


def _mix_columns() -> list[Column]:
    data = F.transform("mix", lambda v: F.struct(
        v["name"].alias("name"), rounding.round_one(v["percentage"]).alias("percentage")))
    return [_mix_text("mix", "name", 0).alias("vehicle_mix"), data.alias("vehicle_mix_data")]


def junction_hotspots(df: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    """One full record per named junction, numbered by violations, ties by name."""
    return numbered(junction_records(df, days))


def numbered(records: DataFrame) -> DataFrame:
    """Records with their rank as id. They are written once as they come; only name and violations are sorted."""
    records = checkpoint(records)
    ranks = global_rank(records.select("name", "violations"), [F.desc("violations"), F.asc("name")], "id").select("id", "name")
    return records.join(ranks, "name").select("id", *records.columns)


def junction_records(df: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    """One full record per named junction, without a number: totals read only the columns they need."""
    return records_of(fold_junctions(df), days)


def records_of(folded: DataFrame, days: int = C.REPORT_DAYS, placed: bool = False) -> DataFrame:
    norm = F.col("cis")
    return _profiles_of(folded, placed).withColumn("cis", bands.normalized_cis(F.col("raw_cis"))).select(
        F.col("junction_name").alias("name"), "jurisdiction", "violations",
        rounding.round_np(F.col("raw_cis"), 3).alias("raw_cis"),
        "cis",
        bands.status(norm).alias("status"),
        bands.action(norm).alias("action"),
        bands.action(norm).alias("recommendation"),
        bands.expected_improvement(norm).alias("expected_improvement"),
        *_mix_columns(),
        bands.hour_text(F.col("peak_hour_val")).alias("peak_hour"),
        "peak_hour_val", "peak_hour_violations",
        bands.affected_vehicles(F.col("violations"), days).alias("affected_vehicles"),
        bands.average_delay(F.col("raw_cis")).alias("avg_delay"),
        bands.capacity_loss(norm).alias("capacity_loss"),
        scoring.daily_loss(F.col("milli"), days).alias("economic_cost"),
        scoring.daily_co2(F.col("milli"), days).alias("co2_impact"),
        "lat", "lng",
        _trend(F.col("raw_cis")).alias("trend_data"),
    )


def junction_metadata(df: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    """What the feed looks up by junction name."""
    return metadata_of(fold_junctions(df), days)


def metadata_of(folded: DataFrame, days: int = C.REPORT_DAYS, placed: bool = False) -> DataFrame:
    return _profiles_of(folded, placed).select(
        F.col("junction_name").alias("name"), "jurisdiction", "lat", "lng",
        *_mix_columns(),
        bands.hour_text(F.col("peak_hour_val")).alias("peak_hour"),
        "peak_hour_val", "peak_hour_violations",
        _multipliers(F.col("raw_cis")).alias("trend_multipliers"),
        F.col("raw_cis").alias("raw_cis_base"),
        scoring.daily_loss(F.col("milli"), days).alias("economic_cost_base"),
        scoring.daily_co2(F.col("milli"), days).alias("co2_impact_base"),
    )


def top_details(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` junctions with most violations: mean score, vehicle mix, busiest hour, place and advice."""
    top = _profiles(df).orderBy(F.desc("violations"), F.asc("junction_name")).limit(n)
    return top.select(
        "junction_name", "violations", rounding.round_np(F.col("raw_cis"), 2).alias("cis"),
        _mix_text("mix", "vehicle", 1).alias("vehicle_mix"),
        F.format_string("%02d:00 (%d violations)", "peak_hour_val", "peak_hour_violations").alias("peak_hour_violations"),
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"),
        bands.action_from_raw(F.col("raw_cis")).alias("recommendation"),
    )


def top_junctions(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` junctions with most violations, with the action for their mean score."""
    sums = scoring.with_milli(named_junctions(df)).groupBy("junction_name").agg(
        F.count(F.lit(1)).alias("violations"), F.sum("cis_milli").alias("milli"))
    top = sums.orderBy(F.desc("violations"), F.asc("junction_name")).limit(n)
    position = F.row_number().over(Window.orderBy(F.desc("violations"), F.asc("junction_name")))
    return top.select(
        position.alias("position"), "junction_name", "violations",
        rounding.round_np(mean_cis(), 2).alias("cis"),
        bands.action_from_raw(mean_cis()).alias("recommendation"),
    )
