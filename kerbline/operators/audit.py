"""Explanation records per cluster, for all clusters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import bands, rounding, scoring
from kerbline.operators.clusters import not_noise

NO_VIOLATION = "WRONG PARKING"


def for_cluster(df: DataFrame, label: int) -> DataFrame:
    """Tickets of one cluster, whatever other filters are set."""
    return df.where(F.col("cluster_label") == label)


def violation_counts(df: DataFrame) -> DataFrame:
    """Tickets per cluster and listed violation; the list column may come with the scored rows."""
    rows = not_noise(df)
    if "violations" not in rows.columns:
        rows = rows.withColumn("violations", scoring.violation_list(F.col("violation_type")))
    return rows.select("cluster_label", F.explode("violations").alias("violation")).groupBy(
        "cluster_label", "violation").agg(F.count(F.lit(1)).alias("n"))


def top_violation(df: DataFrame) -> DataFrame:
    """Most frequent violation per cluster, ties by name."""
    return violation_counts(df).groupBy("cluster_label").agg(
        F.min_by("violation", F.struct(-F.col("n"), "violation")).alias("top_violation"))


def weight_contributions(df: DataFrame) -> DataFrame:
    """Mean of the three weights per cluster, one row each."""
    def tenths_sum(name: str):
        return F.sum(F.rint(F.col(name) * 10).cast("long"))

    sums = not_noise(df).groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("n"), *[tenths_sum(w).alias(w) for w in ("w_size", "w_type", "w_road")])
    means = sums.select("cluster_label", *[
        rounding.mean_of(F.col(w), F.col("n"), 10).alias(title)
        for w, title in (("w_size", "Vehicle Footprint"), ("w_type", "Violation Type"), ("w_road", "Road Class"))
    ])
    return means.unpivot("cluster_label", ["Vehicle Footprint", "Violation Type", "Road Class"], "component", "contribution")


def audit_hotspots(df: DataFrame, compliance_rate: float = 0.0) -> DataFrame:
    """Audit card of every cluster: leading vehicle and violation, means, loss and the sentence.

    One pass: a ticket becomes a row for its vehicle and one for each listed
    violation, folded by value with whole-number sums; probabilities are summed
    in millionths.
    """
    rows = scoring.with_milli(not_noise(df))
    if "violations" not in rows.columns:
        rows = rows.withColumn("violations", scoring.violation_list(F.col("violation_type")))
    vehicle = F.array(F.struct(F.lit(True).alias("is_vehicle"), F.col("vehicle_type").alias("value")))
    listed = F.transform("violations", lambda v: F.struct(F.lit(False).alias("is_vehicle"), v.alias("value")))
    values = rows.select("cluster_label", "cis_milli", "approval_probability", F.inline(F.concat(vehicle, listed)))
    folded = values.groupBy("cluster_label", "is_vehicle", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("is_vehicle"), F.col("cis_milli"))).alias("milli"),
        F.sum(F.when(F.col("is_vehicle"), F.rint(F.col("approval_probability") * 1e6).cast("long"))).alias("approval"),
    )
    vehicles = F.when(F.col("is_vehicle"), F.col("n"))
    most = F.struct(-F.col("n"), "value")
    cards = folded.groupBy("cluster_label").agg(
        F.sum(vehicles).alias("violations"), F.max(vehicles).alias("top_n"),
        F.min_by("value", F.when(F.col("is_vehicle"), most)).alias("top_vehicle"),
        F.min_by("value", F.when(~F.col("is_vehicle"), most)).alias("top_violation"),
        F.sum("milli").alias("milli"), F.sum("approval").alias("approval"),
    )
    mean = rounding.mean_of(F.col("milli"), F.col("violations"))
    percent = bands.share_percent(F.col("top_n"), F.col("violations"))
    violation = F.coalesce("top_violation", F.lit(NO_VIOLATION))
    tier = bands.priority_tier(mean)
    return cards.select(
        "cluster_label", "violations", "top_vehicle", percent.alias("top_vehicle_pct"),
        violation.alias("top_violation"), mean.alias("avg_cis"),
        (F.col("approval") / (F.col("violations") * 10_000)).alias("avg_approval_pct"),
        (scoring.loss_total(F.col("milli")) * bands.compliance_factor(compliance_rate)).alias("economic_loss"),
        tier.alias("tier"),
        bands.audit_sentence(tier, violation, percent, F.col("top_vehicle")).alias("sentence"),
    )
