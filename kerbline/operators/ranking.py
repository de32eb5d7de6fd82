"""Global ranks and the two hotspot rankings."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.bands import compliance_factor
from kerbline.session import checkpoint

_ROW_BITS = 33  # low bits of monotonically_increasing_id: row number inside a partition


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Consecutive numbers over a total order, without pulling all rows into one task.

    A distributed sort is written once; each row then knows its partition and
    its place in it, and only one row per partition is needed for the offsets.
    """
    ordered = checkpoint(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + start)
        .drop("_part", "_place", "_before")
    )


def rank_by_loss(clusters: DataFrame, compliance_rate: float = 0.0) -> DataFrame:
    """Clusters by the loss left at a compliance rate, largest first."""
    left = F.col("economic_loss") * compliance_factor(compliance_rate)
    return clusters.withColumn("economic_loss_compliant", left).orderBy(
        F.desc("economic_loss_compliant"), F.asc("cluster_label"))


def topsis(df: DataFrame, criteria: Sequence[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Closeness to the ideal solution; every criterion counts as a benefit.

    Columns are vector-normalized and weighted (equal weights by default). The
    norms and extremes are one row of numbers. A criterion whose norm is zero
    contributes nothing; with no distance at all the closeness is 0.
    """
    share = {c: (weights or {}).get(c, 1.0 / len(criteria)) for c in criteria}
    known = checkpoint(df.fillna(0.0, subset=list(criteria)))  # read twice: for the norms and for the rows
    stats = known.agg(*[
        f(c).alias(f"{n}_{c}")
        for c in criteria
        for n, f in (("squares", lambda x: F.sum(F.col(x) * F.col(x))), ("best", F.max), ("worst", F.min))
    ]).first()
    to_best, to_worst = F.lit(0.0), F.lit(0.0)
    for c in criteria:
        norm = math.sqrt(stats[f"squares_{c}"] or 0.0)
        if norm > 0:
            for extreme in ("best", "worst"):
                gap = (F.col(c) - float(stats[f"{extreme}_{c}"])) / norm * share[c]
                if extreme == "best":
                    to_best = to_best + gap * gap
                else:
                    to_worst = to_worst + gap * gap
    near, far = F.sqrt(to_best), F.sqrt(to_worst)
    return known.withColumn(
        "closeness", F.when(near + far > 0, F.round(far / (near + far), 6)).otherwise(F.lit(0.0)))
