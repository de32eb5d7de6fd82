"""Filters, totals and lists behind the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands, rounding, scoring
from kerbline.operators.ranking import global_rank

ALL = "ALL"

# Words in a vehicle mix text that stand for a category.
CATEGORY_WORDS = {
    "CAR": ("car", "van", "cab"),
    "SCOOTER": ("scooter", "cycle", "moped"),
    "TANKER": ("tanker", "bus", "lgv", "hcv"),
    "AUTO": ("auto",),
}


def filter_violations(df: DataFrame, station: str = ALL, vehicle: str = ALL, min_cis: float = 0.0) -> DataFrame:
    """Tickets of a station and vehicle type with at least a score."""
    if station != ALL:
        df = df.where(F.col("police_station") == station)
    if vehicle != ALL:
        df = df.where(F.col("vehicle_type") == vehicle)
    return df.where(F.col("cis") >= min_cis)


def in_category(mix: Column, category: str) -> Column:
    """Whether a mix text names a vehicle of the category."""
    return F.lower(mix).rlike("|".join(CATEGORY_WORDS[category]))


def matches_query(query: str) -> Column:
    """Name or jurisdiction contains the query; the untrimmed text is what is matched."""
    wanted = F.lit(query.lower())
    return F.contains(F.lower("name"), wanted) | F.contains(F.lower("jurisdiction"), wanted)


def by_cis(hotspots: DataFrame) -> list[Column]:
    """Largest normalized score first, ties in id order; records without a number have the order their numbers would have."""
    return [F.desc("cis"), F.asc("id")] if "id" in hotspots.columns else [F.desc("cis"), F.desc("violations"), F.asc("name")]


def top_by_cis(hotspots: DataFrame, n: int) -> DataFrame:
    """The ``n`` hotspots with the largest normalized score."""
    return hotspots.orderBy(*by_cis(hotspots)).limit(n)


def filter_hotspots(hotspots: DataFrame, station: str = ALL, category: str = ALL, min_cis: float = 0.0,
                    query: str = "", focus: bool = False) -> DataFrame:
    """Hotspots passing all filters; ``focus`` ignores the filters and keeps the top five."""
    if focus:
        return top_by_cis(hotspots, 5)
    if station != ALL:
        hotspots = hotspots.where(F.col("jurisdiction") == station)
    if category in CATEGORY_WORDS:
        hotspots = hotspots.where(in_category(F.col("vehicle_mix"), category))
    hotspots = hotspots.where(F.col("cis") >= min_cis)
    return hotspots.where(matches_query(query)) if query.strip() else hotspots


def kpis(df: DataFrame, compliance_rate: float = 0.0) -> DataFrame:
    """One row: tickets, delay, loss (also in lakh), CO2 (also in tonnes), clusters.

    Tickets are folded per cluster first, so counting clusters needs no distinct.
    """
    per_label = scoring.with_milli(df).groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cis_milli").alias("milli"))
    totals = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
        F.coalesce(F.sum("milli"), F.lit(0)).alias("milli"),
        F.count_if(F.col("cluster_label") != C.NOISE).alias("active_hotspots"),
    )
    return kpis_of(totals, compliance_rate)


def kpis_of(totals: DataFrame, compliance_rate: float, *keys: str) -> DataFrame:
    """The same from tickets (violations), summed scores (milli) and clusters (active_hotspots), a row for each of ``totals``."""
    left = bands.compliance_factor(compliance_rate)
    loss = scoring.loss_total(F.col("milli")) * left
    carbon = scoring.co2_total(F.col("milli")) * left
    return totals.select(
        *keys, "violations", (scoring.delay_total(F.col("milli")) * left).alias("delay_hours"),
        loss.alias("economic_loss"), bands.lakhs(loss).alias("loss_lakh"),
        carbon.alias("co2_kg"), bands.tonnes(carbon).alias("co2_tonnes"), "active_hotspots",
    )


def top_vehicle_counts(df: DataFrame, n: int = 6) -> DataFrame:
    counts = df.groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("vehicle_type")).limit(n)


def hour_histogram(df: DataFrame) -> DataFrame:
    counts = df.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.count(F.lit(1)).alias("violations"))
    return counts.orderBy("hour")


def summary_metrics(hotspots: DataFrame, compliance_rate: float = 0.0) -> DataFrame:
    """Header figures over hotspots; zeros when there are none. One-decimal inputs are summed as tenths."""
    left = bands.compliance_factor(compliance_rate)

    def tenth(name: str) -> Column:
        return F.rint(F.col(name) * 10).cast("long")

    sums = hotspots.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "critical").alias("critical"),
        F.coalesce(F.sum(tenth("cis")), F.lit(0)).alias("cis"),
        F.coalesce(F.sum(tenth("avg_delay") * F.col("affected_vehicles")), F.lit(0)).alias("delay"),
        F.coalesce(F.sum(tenth("capacity_loss")), F.lit(0)).alias("capacity"),
        F.coalesce(F.sum("economic_cost"), F.lit(0)).alias("cost"),
    )
    n = F.greatest("n", F.lit(1))
    return sums.select(
        F.col("n").alias("active_count"),
        F.col("critical").alias("critical_count"),
        rounding.fixed_one(F.col("cis") / 10.0 / n).alias("avg_cis"),
        rounding.round_js(F.col("delay") / 10.0 * left).alias("total_delay"),
        rounding.round_js(F.col("capacity") / 10.0 / n * left).alias("avg_capacity_loss"),
        rounding.round_js(F.col("cost") * left).alias("total_cost"),
    )


def focus_improvement(hotspots: DataFrame) -> DataFrame:
    """Mean expected improvement of the top five, one decimal, 0 without hotspots."""
    sums = top_by_cis(hotspots, 5).agg(
        F.coalesce(F.sum(F.rint(F.col("expected_improvement") * 10).cast("long")), F.lit(0)).alias("tenths"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"),
    )
    return sums.select(rounding.fixed_one(F.col("tenths") / 10.0 / F.col("n")).alias("improvement"))


def focus_bounds(hotspots: DataFrame) -> DataFrame:
    """Box around the top five."""
    return top_by_cis(hotspots, 5).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def priority_index(hotspots: DataFrame) -> DataFrame:
    """All hotspots numbered by normalized score."""
    return global_rank(hotspots, [F.desc("cis"), F.asc("id")], "index_number")


def map_centre(df: DataFrame) -> DataFrame:
    """Mean coordinates of the tickets, or the city centre without any."""
    sums = df.agg(*rounding.degree_parts("lat", "latitude"), *rounding.degree_parts("lng", "longitude"))
    lat, lng = C.MAP_CENTRE
    return sums.select(
        F.coalesce(rounding.mean_degrees("lat"), F.lit(lat)).alias("lat"),
        F.coalesce(rounding.mean_degrees("lng"), F.lit(lng)).alias("lng"),
    )


def facet(df: DataFrame, column: str) -> DataFrame:
    """ALL, then the sorted distinct values of a column."""
    values = df.select(F.col(column).alias("value")).distinct().withColumn("first", F.lit(False))
    everything = df.sparkSession.range(1).select(F.lit(ALL).alias("value"), F.lit(True).alias("first"))
    return everything.unionByName(values).orderBy(F.desc("first"), "value").select("value")


def capacity_markers(hotspots: DataFrame) -> DataFrame:
    return hotspots.withColumns({
        "capacity_band": bands.capacity_band(F.col("capacity_loss")),
        "capacity_size": bands.capacity_size(F.col("capacity_loss")),
    })


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers 1..n over a table that a limit has already bounded to a few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
