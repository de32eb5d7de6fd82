"""Patrol plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands
from kerbline.operators.explore import by_cis, row_numbers, top_by_cis

CANDIDATES = 15  # clusters a plan considers: the top list the planner shows


def assign_patrols(clusters: DataFrame, units: int = 4, per_unit: int = 3, compliance_rate: float = 0.0,
                   candidates: int = CANDIDATES) -> DataFrame:
    """Cover the largest losses: rank and unit of every visited cluster.

    The ``candidates`` clusters with the largest loss left at this compliance
    are considered; what a visit covers is their full loss. All units value a
    cluster alike and losses are not negative, so visiting the best
    min(candidates, units * per_unit) is optimal however they are split.
    """
    left = F.col("economic_loss") * bands.compliance_factor(compliance_rate)
    worth = [F.desc("economic_loss"), F.asc("cluster_label")]
    considered = clusters.withColumn("_left", left).orderBy(F.desc("_left"), *worth).limit(candidates)
    ranked = row_numbers(considered, worth, "rank").where(F.col("rank") <= units * per_unit)
    return ranked.withColumn("patrol", F.floor((F.col("rank") - 1) / F.lit(per_unit)).cast("int") + 1).drop("_left")


def dispatch_plan(assigned: DataFrame) -> DataFrame:
    """Route text, covered loss and mean score per patrol."""
    stops = F.array_sort(F.collect_list(F.struct("rank", "cluster_label")))
    return assigned.groupBy("patrol").agg(
        stops.alias("stops"), F.sum("economic_loss").alias("loss"), F.avg("avg_cis").alias("avg_cis"),
    ).select(
        "patrol",
        F.array_join(F.transform("stops", lambda s: F.format_string("Hotspot #%d", s["cluster_label"])), " -> ").alias("route"),
        "loss", "avg_cis",
    )


def _by_position(hotspots: DataFrame) -> DataFrame:
    return row_numbers(top_by_cis(hotspots, 3), by_cis(hotspots), "position")


def dispatch_top(hotspots: DataFrame) -> DataFrame:
    """The three worst hotspots to the three dispatch units; the third is towed."""
    spark = hotspots.sparkSession
    units = spark.createDataFrame(
        [(i + 1, name, code) for i, (name, code) in enumerate(zip(C.DISPATCH_NAMES, C.DISPATCH_CODES))],
        "position int, unit string, code string")
    return _by_position(hotspots).join(F.broadcast(units), "position").select(
        "unit", F.col("name").alias("target"),
        F.when(F.col("position") == 3, C.THIRD_ACTION).otherwise(F.col("action")).alias("action"), "code",
    )


def patrol_lines(hotspots: DataFrame, units: DataFrame) -> DataFrame:
    """Line from the i-th patrol unit to the i-th worst hotspot; three lines at most."""
    starts = row_numbers(units.orderBy("id").limit(3), [F.asc("id")], "position").select(
        "position", F.col("id").alias("unit"), F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng"))
    return _by_position(hotspots).join(F.broadcast(starts), "position").select(
        "unit", "from_lat", "from_lng", F.col("name").alias("target"),
        F.col("lat").alias("to_lat"), F.col("lng").alias("to_lng"))
