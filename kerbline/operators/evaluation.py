"""How well scores tell approved from rejected tickets, from folded scores.

Tickets are folded to one row per distinct score first. The rank statistic needs,
for every score, the rejected tickets below it: a running sum over the sorted
scores, taken within range partitions and then offset by the partitions before.
All sums are whole numbers, so the figures are exact on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.approval import labelled
from kerbline.session import checkpoint

PARTS_OF_ONE = 1_000_000  # probabilities are summed in whole millionths


def fold_judged(df: DataFrame) -> DataFrame:
    """(score, approved, rejected): judged tickets per distinct probability; those without one are left out."""
    rows = labelled(df).where(F.col("approval_probability").isNotNull() & ~F.isnan("approval_probability"))
    return rows.groupBy(F.col("approval_probability").alias("score")).agg(
        F.sum(F.col("target").cast("long")).alias("approved"), F.sum((1 - F.col("target")).cast("long")).alias("rejected"))


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in the order of the distinct ``order``.

    The sorted rows are written once; each range partition sums its own rows, and one row per partition gives the offsets.
    """
    ordered = checkpoint(df.orderBy(order).withColumn("_part", F.spark_partition_id()))
    totals = ordered.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_part", "_before")


def rank_statistic(df: DataFrame) -> DataFrame:
    """One row: approved, rejected, twice_wins and auc of the judged tickets of ``df``.

    A pair of an approved and a rejected ticket is won if the approved one has
    the higher score, half won if both have the same; ``auc`` is the share of
    wins, null without tickets of both kinds.
    """
    below = running_sum(fold_judged(df), "score", "rejected", "rejected_below")
    wins = F.col("approved").cast("decimal(38,0)") * (2 * F.col("rejected_below") + F.col("rejected")).cast("decimal(20,0)")
    sums = below.agg(
        F.coalesce(F.sum("approved"), F.lit(0)).alias("approved"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(wins.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("twice_wins"))
    pairs = 2.0 * F.col("approved") * F.col("rejected")
    return sums.select("approved", "rejected", F.col("twice_wins").cast("long").alias("twice_wins"),
                       F.when(pairs > 0, F.col("twice_wins").cast("double") / pairs).alias("auc"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, approved, mean_score, share): judged tickets by equal stretches of the probability; empty ones are missing."""
    folded = fold_judged(df)
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    n = F.col("approved") + F.col("rejected")
    millionths = F.rint(F.col("score") * PARTS_OF_ONE).cast("long")
    sums = folded.groupBy(place.alias("bin")).agg(F.sum(n).alias("n"), F.sum("approved").alias("approved"), F.sum(millionths * n).alias("millionths"))
    return sums.select("bin", "n", "approved", (F.col("millionths") / (F.col("n") * F.lit(float(PARTS_OF_ONE)))).alias("mean_score"),
                       (F.col("approved") / F.col("n")).alias("share"))
