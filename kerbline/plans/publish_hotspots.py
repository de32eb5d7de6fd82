"""Snapshot to the published lists: hotspot records, top list and feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline import constants as C
from kerbline.operators import feed, junctions
from kerbline.sources import snapshot


def run(spark: SparkSession, scored_path: str, hotspots_path: str, top_path: str, n: int = 10,
        days: int = C.REPORT_DAYS) -> None:
    scored = snapshot.read_scored(spark, scored_path)
    snapshot.write_hotspots(junctions.junction_hotspots(scored, days), hotspots_path)
    snapshot.write_top(junctions.top_junctions(scored, n), top_path)


def feed_rows(spark: SparkSession, scored_path: str, top_path: str, positioned: bool = True,
              days: int = C.REPORT_DAYS) -> DataFrame:
    """The feed for a published top list."""
    top = snapshot.read_top(spark, top_path, positioned)
    metadata = junctions.junction_metadata(feed.listed_only(snapshot.read_scored(spark, scored_path), top), days)
    return feed.hotspot_feed(top, metadata, days)
