"""Totals for any filter without reading tickets again: a cube over station, vehicle type and score.

Scores are products of three short lists of weights, so they take few values
however many tickets there are. The cube holds, for each station and vehicle type
and for all of them, what a score and all higher ones amount to; a filter on the
least score is then one row of it. Clusters are not additive: a cluster counts
while its highest score in the cell passes, so each is entered at that score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import scoring
from kerbline.operators import explore

CELL = ("all_stations", "all_vehicles", "police_station", "vehicle_type")


def fold_scores(df: DataFrame) -> DataFrame:
    """The one pass over tickets: rows per station, vehicle type, score and cluster. Folds of several batches can be united."""
    return scoring.with_milli(df).groupBy("police_station", "vehicle_type", "cis_milli", "cluster_label").agg(F.count(F.lit(1)).alias("n"))


def build_cube(folded: DataFrame) -> DataFrame:
    """(all_stations, all_vehicles, police_station, vehicle_type, cis_milli, violations, milli, active_hotspots).

    The last three are those of tickets with this score or a higher one. Tickets
    without a score pass no filter and are left out.
    """
    rows = folded.where("cis_milli IS NOT NULL")
    tickets = _for_all(rows, "cis_milli").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("clusters"))
    highest = _for_all(rows.where(F.col("cluster_label") != C.NOISE), "cluster_label").agg(F.max("cis_milli").alias("cis_milli"))
    entered = highest.groupBy(*CELL, "cis_milli").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("clusters"))
    steps = tickets.unionByName(entered).groupBy(*CELL, "cis_milli").agg(F.sum("n").alias("n"), F.sum("clusters").alias("clusters"))
    above = Window.partitionBy(*CELL).orderBy(F.desc("cis_milli")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        *CELL, "cis_milli", F.sum("n").over(above).alias("violations"), F.sum(F.col("n") * F.col("cis_milli")).over(above).alias("milli"),
        F.sum("clusters").over(above).alias("active_hotspots"))


def _for_all(rows: DataFrame, kept: str):
    """Grouped by cell and ``kept``: each row in its own cell, in those of all stations, of all vehicle types and of both."""
    choices = [F.struct(F.lit(s).alias("all_stations"), F.lit(v).alias("all_vehicles")) for s in (False, True) for v in (False, True)]
    wide = rows.withColumn("_all", F.explode(F.array(*choices))).select("*", "_all.*").withColumns({
        "police_station": F.when(~F.col("all_stations"), F.col("police_station")), "vehicle_type": F.when(~F.col("all_vehicles"), F.col("vehicle_type"))})
    return wide.groupBy(*CELL, kept)


def filtered_totals(cube: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (station, vehicle, min_cis; ALL for no filter) with violations, milli and active_hotspots.

    A request is one look-up: the row of its cell with the lowest score that
    passes. A cell or score without tickets gives zeros.
    """
    asked = requests.select(
        "station", "vehicle", "min_cis", (F.col("station") == explore.ALL).alias("all_stations"), (F.col("vehicle") == explore.ALL).alias("all_vehicles"))
    cell = [F.coalesce(F.col(c), F.lit("")) for c in CELL[2:]]
    keyed = cube.select("all_stations", "all_vehicles", cell[0].alias("station_key"), cell[1].alias("vehicle_key"), "cis_milli",
                        F.struct("violations", "milli", "active_hotspots").alias("totals"))
    asked = asked.withColumns({
        "station_key": F.when(F.col("all_stations"), "").otherwise(F.col("station")), "vehicle_key": F.when(F.col("all_vehicles"), "").otherwise(F.col("vehicle"))})
    met = asked.join(keyed, ["all_stations", "all_vehicles", "station_key", "vehicle_key"], "left")
    passing = F.when(F.col("cis_milli") / 1000.0 >= F.col("min_cis"), F.col("cis_milli"))
    found = met.groupBy("station", "vehicle", "min_cis").agg(F.min_by("totals", passing).alias("totals"))
    return found.select("station", "vehicle", "min_cis", *[
        F.coalesce(F.col(f"totals.{c}"), F.lit(0)).alias(c) for c in ("violations", "milli", "active_hotspots")])


def filtered_kpis(cube: DataFrame, requests: DataFrame, compliance_rate: float = 0.0) -> DataFrame:
    """The dashboard's totals for every request, as ``explore.kpis`` gives them for the filtered tickets."""
    return explore.kpis_of(filtered_totals(cube, requests), compliance_rate, "station", "vehicle", "min_cis")
