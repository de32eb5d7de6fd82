"""Cluster labels on tickets, and hotspots per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands, rounding, scoring
from kerbline.operators.dbscan import Limits, dbscan_sites
from kerbline.operators.junctions import fold_tickets, mean_cis, merged_sums
from kerbline.operators.skew import lookup_join
from kerbline.session import checkpoint


def high_impact() -> Column:
    """Likely valid and heavy enough to count for clustering."""
    return (F.col("approval_probability") >= C.MIN_PROBABILITY) & (scoring.cis_milli() >= round(C.MIN_CIS * 1000))


def attach_clusters(df: DataFrame, eps: float = C.EPS_DEGREES, min_samples: int = C.MIN_SAMPLES,
                    limits: Limits = Limits()) -> DataFrame:
    """``df`` with ``cluster_label``: DBSCAN over its high-impact rows, -1 for all others.

    Rows at one coordinate share a label, so labels are found per coordinate and
    handed to the eligible rows. Every eligible row takes part.
    """
    return attach_sites(df, dbscan_sites(eligible_points(df), eps, min_samples, limits), limits)


def eligible_points(df: DataFrame) -> DataFrame:
    """Id and place of the rows that take part in clustering."""
    return df.where(F.coalesce(high_impact(), F.lit(False))).select("id", "latitude", "longitude")


def attach_sites(df: DataFrame, sites: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``df`` with the ``cluster_label`` of its place in ``sites`` (latitude, longitude, weight, cluster_label)."""
    columns = [c for c in df.columns if c != "cluster_label"]
    df = df.select(*columns).withColumn("_eligible", F.coalesce(high_impact(), F.lit(False)))
    sites = checkpoint(sites.where(F.col("cluster_label") != C.NOISE).select("latitude", "longitude", "weight", "cluster_label"))
    counts = sites.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows")).first()
    joined = lookup_join(
        df, sites, ["latitude", "longitude"], spread=["id"], table_rows=counts["n"], total=counts["rows"] or 0,
        weight="weight", active=F.col("_eligible"), broadcast_rows=limits.broadcast_rows, hot_rows=limits.hot_rows)
    return joined.select(*columns, F.coalesce("cluster_label", F.lit(C.NOISE)).alias("cluster_label"))


def not_noise(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster_label") != C.NOISE)


def hotspot_count(df: DataFrame) -> DataFrame:
    """Number of clusters, one row."""
    labels = not_noise(df).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))
    return labels.agg(F.count(F.lit(1)).alias("hotspots"))


def cluster_summary(df: DataFrame) -> DataFrame:
    """Centre, tickets, mean score, loss and first station per cluster."""
    folded = fold_tickets(not_noise(df), "cluster_label", "police_station")
    return folded.groupBy("cluster_label").agg(*merged_sums()).select(
        "cluster_label",
        rounding.mean_degrees("lat").alias("lat"),
        rounding.mean_degrees("lng").alias("lng"),
        F.col("violations").alias("violations_count"),
        mean_cis().alias("avg_cis"),
        scoring.loss_total(F.col("milli")).alias("economic_loss"),
        F.col("jurisdiction").alias("police_station"),
    )


def with_tiers(clusters: DataFrame) -> DataFrame:
    """Priority tier, and severity and size of the map marker."""
    return clusters.withColumns({
        "priority_tier": bands.priority_tier(F.col("avg_cis")),
        "severity": bands.map_severity(F.col("avg_cis")),
        "size": bands.map_size(F.col("violations_count")),
    })


def cluster_criteria(df: DataFrame) -> DataFrame:
    """The four ranking criteria per cluster.

    Total score and loss are proportional, so together they weigh double.
    Approval rate is approved / (approved + rejected), 0 without either.
    Recidivism is the share of the days in the data on which the cluster was
    active.
    """
    scored = scoring.with_milli(df).withColumn("day", F.to_date("created_datetime"))
    # One pass over the tickets, noise included; the rest reads this small table.
    daily = checkpoint(scored.groupBy("cluster_label", "day").agg(
        F.sum("cis_milli").alias("milli"),
        F.count_if(F.col("validation_status") == "approved").alias("approved"),
        F.count_if(F.col("validation_status") == "rejected").alias("rejected"),
    ))
    days = daily.select("day").where(F.col("day").isNotNull()).distinct().count()
    judged = F.col("approved") + F.col("rejected")
    return not_noise(daily).groupBy("cluster_label").agg(
        F.sum("milli").alias("milli"), F.sum("approved").alias("approved"), F.sum("rejected").alias("rejected"),
        F.count("day").alias("active_days"),
    ).select(
        "cluster_label",
        (F.col("milli") / 1000.0).alias("total_cis"),
        scoring.loss_total(F.col("milli")).alias("economic_loss"),
        F.when(judged > 0, F.col("approved") / judged).otherwise(0.0).alias("approval_rate"),
        (F.col("active_days") / F.lit(float(max(days, 1)))).alias("recidivism"),
    )
