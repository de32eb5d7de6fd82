"""Road corridors and the hotspots near them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands, rounding
from kerbline.functions.geo import haversine_km
from kerbline.operators.skew import HOT_KEYS
from kerbline.session import checkpoint

MARGIN = 1.001  # cells are a little wider than the search distance
LEAF_PLACES = 5_000  # a cell with more places is split into quarters until none has more
DEEPEST = 40         # quarterings; below that places are a hair apart
STACK = 1_000        # hotspots of one place in a row, about
BLOCK = 1_000        # corridors that meet the places of a leaf under one key, about
_LEAF = ["band", "cell", "depth", "qy", "qx"]


def _band_degrees(km: float) -> float:
    return math.degrees(km / C.EARTH_RADIUS_KM) * MARGIN


def _cells_around(band: Column, km: float) -> Column:
    """Number of longitude cells in a latitude band, each at least ``km`` wide in it and its neighbours."""
    step = _band_degrees(km)
    edge = F.greatest(F.abs(band * step), F.abs((band + 1) * step)) + step
    narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0 / step) * narrow), F.lit(1)).cast("long")


def _lng_cell(lng: Column, cells: Column) -> Column:
    return F.least(F.floor((F.pmod(lng + 180.0, F.lit(360.0))) * cells / 360.0), cells - 1)


def split_places(placed: DataFrame, leaf_places: int = LEAF_PLACES) -> DataFrame:
    """``placed`` (lat, lng, band, cell, fy, fx) with the leaf of its cell's quadtree (depth, qy, qx) each place is in.

    ``fy`` and ``fx`` are the place within its cell, from 0 to 1. Only crowded
    cells are split, and only their places are written again; a leaf holds at most
    ``leaf_places`` of them, or a ten-thousandth of all, so that the list of
    crowded cells of a round is short enough to send to every task.
    """
    waiting = checkpoint(placed.withColumns({"depth": F.lit(0), "qy": F.lit(0).cast("long"), "qx": F.lit(0).cast("long")}))
    limit = max(leaf_places, waiting.count() // HOT_KEYS)
    settled = None
    for depth in range(1, DEEPEST + 1):
        crowded = checkpoint(waiting.groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).drop("n"))
        if crowded.isEmpty():
            break
        done = waiting.join(F.broadcast(crowded), _LEAF, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        parts = float(1 << depth)
        waiting = checkpoint(waiting.join(F.broadcast(crowded), _LEAF, "left_semi").withColumns({
            "depth": F.lit(depth), "qy": F.floor(F.col("fy") * parts), "qx": F.floor(F.col("fx") * parts)}))
    return waiting if settled is None else settled.unionByName(waiting)


def _to_leaves(reach: DataFrame, leaves: DataFrame, km: float) -> DataFrame:
    """Path points with the leaves of their cell that may hold a place closer than ``km``; the whole cell if it is not split."""
    boxes = leaves.where("depth > 0").groupBy(*_LEAF).agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    # At most four leaves for each crowded cell of a round.
    met = reach.join(F.broadcast(boxes), ["band", "cell"], "left")
    gap = F.greatest(F.col("lat0") - F.col("p_lat"), F.col("p_lat") - F.col("lat1"), F.lit(0.0))
    met = met.where(F.col("depth").isNull() | (F.radians(gap) * C.EARTH_RADIUS_KM < km * MARGIN))
    return met.select("id", "p_lat", "p_lng", "band", "cell", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in _LEAF[2:]])


def _stacked(hotspots: DataFrame, most: int) -> DataFrame:
    """(lat, lng, spots): the hotspots of each place, at most about ``most`` of them in a row."""
    sizes = hotspots.groupBy("lat", "lng").agg(F.ceil(F.count(F.lit(1)) / most).alias("stacks")).where("stacks > 1")
    # At most one row for every ``most`` hotspots.
    rows = hotspots.select(F.col("id").alias("hotspot_id"), "name", "status", "lat", "lng").join(F.broadcast(sizes), ["lat", "lng"], "left")
    stack = F.pmod(F.xxhash64("hotspot_id"), F.coalesce("stacks", F.lit(1)))
    return rows.groupBy("lat", "lng", stack.alias("stack")).agg(F.collect_list(F.struct("hotspot_id", "name", "status")).alias("spots")).drop("stack")


def _dealt(reach: DataFrame, homes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key their rows meet by (the leaf and ``block``): about ``most`` rows of ``reach`` share one.

    The places of a leaf that more paths reach are copied to each of its blocks.
    """
    crowded = reach.groupBy(*_LEAF).agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks")).where("blocks > 1")
    # At most one row for every ``most`` rows of the paths.
    crowded = F.broadcast(checkpoint(crowded))
    blocks = F.coalesce("blocks", F.lit(1))
    copied = homes.join(crowded, _LEAF, "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return reach.join(crowded, _LEAF, "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).drop("blocks"), copied.drop("blocks")


def link_corridors(roads: DataFrame, hotspots: DataFrame, km: float = C.LINK_KM, leaf_places: int = LEAF_PLACES,
                   stack: int = STACK, block: int = BLOCK) -> DataFrame:
    """(id, hotspot_id, name, status): hotspots closer than ``km`` to a path point of a corridor.

    Distances are taken per distinct place, so many hotspots at one place cost one distance.

    Path points are copied to the 3 x 3 grid cells around them and meet the
    hotspots by equal cell. Longitude cells follow the latitude band, wrap at
    the date line, and merge towards the poles. Cells crowded with places are
    split by a quadtree, and a point goes to the leaves near it. The points of a
    corridor that reach a leaf are one row: a place, which is in one leaf, meets a
    corridor once, so links leave the join as they are, neither shuffled nor
    folded. A leaf that many corridors reach is dealt over blocks of them.
    """
    step = _band_degrees(km)
    points = roads.select("id", F.explode("path").alias("p")).select(
        "id", F.col("p.lat").alias("p_lat"), F.col("p.lng").alias("p_lng")).where("p_lat IS NOT NULL AND p_lng IS NOT NULL")
    bands_around = points.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("d")).withColumn(
        "band", F.floor(F.col("p_lat") / step) + F.col("d"))
    around = bands_around.withColumn("cells", _cells_around(F.col("band"), km)).withColumn(
        "mid", _lng_cell(F.col("p_lng"), F.col("cells")))
    spots = F.array_distinct(F.array(*[F.pmod(F.col("mid") + F.lit(d), F.col("cells")) for d in (-1, 0, 1)]))
    reach = around.select("id", "p_lat", "p_lng", "band", F.explode(spots).alias("cell"))
    hotspots = checkpoint(hotspots.select("id", "name", "status", "lat", "lng").where("lat IS NOT NULL AND lng IS NOT NULL"))
    placed = hotspots.select("lat", "lng").distinct().withColumn("band", F.floor(F.col("lat") / step)).withColumn(
        "_cells", _cells_around(F.col("band"), km)).withColumn("cell", _lng_cell(F.col("lng"), F.col("_cells")))
    placed = split_places(placed.select(
        "lat", "lng", "band", "cell", (F.col("lat") / step - F.col("band")).alias("fy"),
        (F.pmod(F.col("lng") + 180.0, F.lit(360.0)) * F.col("_cells") / 360.0 - F.col("cell")).alias("fx")), leaf_places)
    # Only points around a cell with places.
    reach = reach.join(placed.select("band", "cell").distinct(), ["band", "cell"], "left_semi")
    reach = _to_leaves(reach, placed, km).groupBy("id", *_LEAF).agg(
        F.collect_set(F.struct("p_lat", "p_lng")).alias("points"), F.min("p_lat").alias("lat0"), F.max("p_lat").alias("lat1"))
    homes = placed.select("lat", "lng", *_LEAF).join(_stacked(hotspots, stack), ["lat", "lng"])
    reach, homes = _dealt(checkpoint(reach), homes, block)
    gap = F.greatest(F.col("lat0") - F.col("lat"), F.col("lat") - F.col("lat1"))
    near = (F.radians(gap) * C.EARTH_RADIUS_KM < km * MARGIN) & F.exists(
        "points", lambda p: haversine_km(p["p_lat"], p["p_lng"], F.col("lat"), F.col("lng")) < km)
    return reach.join(homes, [*_LEAF, "block"]).where(near).select("id", F.inline("spots"))


def numbered_links(links: DataFrame) -> DataFrame:
    """The hotspots of each corridor in hotspot order, with their place in it."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("hotspot_id")) - 1
    return links.select("id", place.alias("place"), "name", "hotspot_id", "status")


def with_nearby(roads: DataFrame, links: DataFrame) -> DataFrame:
    """Corridors with the names of their hotspots in hotspot order; empty lists kept."""
    listed = links.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("hotspot_id", "name"))).alias("spots"))
    names = F.coalesce(F.transform("spots", lambda s: s["name"]), F.array().cast("array<string>"))
    return roads.join(listed, "id", "left").withColumn("nearby_hotspots", names).drop("spots")


def linked_status(roads_with_nearby: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Each listed name with its hotspot, or Inactive when the hotspot is gone."""
    names = roads_with_nearby.select("id", F.posexplode("nearby_hotspots").alias("place", "name"))
    current = hotspots.select("name", F.col("id").alias("hotspot_id"), "status")
    return names.join(current, "name", "left").select(
        "id", "place", "name", "hotspot_id", F.coalesce("status", F.lit("Inactive")).alias("status"))


def corridor_flags(roads: DataFrame) -> DataFrame:
    """Bands, bottleneck and delay-zone flags and the middle path point of each corridor."""
    colour = F.col("congestion")
    middle = F.get("path", F.floor(F.size("path") / F.lit(2)).cast("int"))
    return roads.select(
        "id", "name", bands.speed_band(F.col("speed")).alias("speed_band"), bands.congestion_level(colour).alias("level"),
        (F.col("parking_suspected") & colour.isin("red", "dark-red", "orange")).alias("bottleneck"),
        colour.isin("red", "dark-red").alias("delay_zone"),
        middle["lat"].alias("mid_lat"), middle["lng"].alias("mid_lng"),
    )


def speed_comparison(roads: DataFrame) -> DataFrame:
    """Two rows per corridor: current and free-flow speed."""
    named = roads.select("id", F.col("speed").alias("Current Speed"), F.col("free_flow_speed").alias("Free Flow Speed"))
    return named.unpivot("id", ["Current Speed", "Free Flow Speed"], "name", "speed")


def network_stats(roads: DataFrame) -> DataFrame:
    """Mean speed, slowest corridor and longest delay, ties by id."""
    stats = roads.agg(
        F.sum("speed").alias("speed"), F.count("speed").alias("n"),
        F.min_by("name", F.struct("speed", "id")).alias("slowest"),
        F.min_by(F.struct("name", "estimated_delay"), F.struct(-F.col("estimated_delay"), "id")).alias("longest"),
    )
    # A whole number of minutes is shown without decimals.
    delay = F.col("longest.estimated_delay")
    shown = F.when(delay == F.floor(delay), F.floor(delay).cast("string")).otherwise(delay.cast("string"))
    return stats.select(
        rounding.fixed_one(F.col("speed") / F.col("n")).alias("avg_speed"),
        F.coalesce("slowest", F.lit("N/A")).alias("slowest"),
        F.coalesce(F.concat("longest.name", F.lit(" (+"), shown, F.lit("m)")), F.lit("N/A")).alias("longest_delay"),
    )
