"""Snapshot to the figures of a dashboard page: the filters first, then totals, clusters and patrols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.operators import clusters, dispatch, explore, ranking
from kerbline.sources import snapshot


def page(labelled: DataFrame, station: str = explore.ALL, vehicle: str = explore.ALL, min_cis: float = 0.0,
         compliance_rate: float = 0.0, units: int = 4, per_unit: int = 3) -> dict[str, DataFrame]:
    """``kpis``, ``clusters`` (largest loss first, with tiers) and ``patrols`` of the tickets that pass the filters.

    Labels are those of the snapshot: a filter narrows clusters, it does not find new ones.
    """
    rows = explore.filter_violations(labelled, station, vehicle, min_cis)
    summary = clusters.cluster_summary(rows)
    return {
        "kpis": explore.kpis(rows, compliance_rate),
        "clusters": clusters.with_tiers(ranking.rank_by_loss(summary, compliance_rate)),
        "patrols": dispatch.dispatch_plan(dispatch.assign_patrols(summary, units, per_unit, compliance_rate)),
    }


def run(spark: SparkSession, scored_path: str, **filters) -> dict[str, DataFrame]:
    """The page for a stored snapshot; nothing is clustered again."""
    return page(snapshot.read_scored(spark, scored_path), **filters)
