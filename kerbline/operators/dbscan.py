"""Plain DBSCAN on latitude and longitude, spread over a grid.

The grid cell is a hair narrower than eps / sqrt(2), so points of one cell are
always neighbours. That gives three facts the plan rests on:

* a cell holding ``min_samples`` rows is all core, with no distance computed;
* any other cell holds fewer than ``min_samples`` points, so the points whose
  neighbours must be counted are few per cell;
* all core points of a cell share a cluster, so clusters are the connected
  components of *cells*.

Distances between cells are decided by bounding boxes where possible; the rest
is compared point by point for sparse cells, and by halving boxes for dense
ones, so no step pairs up the contents of two dense cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import rounding
from kerbline.operators.components import connected_components
from kerbline.operators.ranking import global_rank
from kerbline.operators.skew import BROADCAST_ROWS, HOT_KEYS, HOT_ROWS, lookup_join
from kerbline.session import checkpoint

CELL_SHARE = 0.7071   # cell side / eps, below 1 / sqrt(2)
REACH = 2             # neighbours are at most this many cells away
HALVINGS = 2          # bits by which boxes shrink per refinement round


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between plans; results do not depend on them."""

    hot_sites: int = 10_000            # sites of one cell before it is split over tasks
    direct_pairs: int = 4096           # site pairs of two cells compared outright
    broadcast_rows: int = BROADCAST_ROWS
    hot_rows: int = HOT_ROWS


@dataclass(frozen=True)
class Grid:
    """Distinct coordinates and their cells."""

    sites: DataFrame
    cells: DataFrame
    eps: float

    @property
    def limit(self) -> str:
        """Squared eps as an SQL literal."""
        return f"{self.eps * self.eps!r}D"


def dbscan_sites(points: DataFrame, eps: float = C.EPS_DEGREES, min_samples: int = C.MIN_SAMPLES,
                 limits: Limits = Limits()) -> DataFrame:
    """Distinct coordinates of ``points`` (id, latitude, longitude) with their cluster.

    Returns latitude, longitude, weight (rows there), is_core and cluster_label
    (-1 noise). Coordinates that are null, NaN or infinite are left out. Clusters are numbered by the smallest id of their core points;
    a border point joins the lowest-numbered cluster next to it.
    """
    grid = _place_sites(points, eps, limits)
    if grid is None:
        return points.where("false").select(
            "latitude", "longitude", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("is_core"),
            F.lit(C.NOISE).alias("cluster_label"))
    flagged = checkpoint(_flag_core(grid, min_samples))
    core = flagged.where("is_core")
    core_cells = checkpoint(_core_cells(core))
    numbered = _number_clusters(grid, core_cells, _links(grid, core, core_cells, limits), limits)
    return _assign(grid, flagged, numbered)


def core_sites(points: DataFrame, eps: float = C.EPS_DEGREES, min_samples: int = C.MIN_SAMPLES,
               limits: Limits = Limits()) -> DataFrame:
    """Distinct coordinates with their weight and whether they are core."""
    grid = _place_sites(points, eps, limits)
    if grid is None:
        return points.where("false").select(
            "latitude", "longitude", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("is_core"))
    return _flag_core(grid, min_samples).select("latitude", "longitude", "weight", "is_core")


def _bits(eps: float) -> int:
    """Halvings of a cell that keep whole-number coordinates exact in a double."""
    if eps < 1e-6:
        raise ValueError("eps is in degrees and must be at least 1e-6")
    return max(0, min(30, int(math.log2(2**52 * eps * CELL_SHARE / 360))))


def _box() -> list[Column]:
    return [F.expr(e) for e in (
        "min(latitude) AS lat0", "max(latitude) AS lat1", "min(longitude) AS lng0", "max(longitude) AS lng1")]


def site_rows(points: DataFrame, eps: float) -> DataFrame:
    """Distinct coordinates of ``points`` with their rows, smallest id and places on the grid."""
    bits = _bits(eps)
    fine = eps * CELL_SHARE / (1 << bits)
    return (
        points.where(rounding.is_finite(F.col("latitude")) & rounding.is_finite(F.col("longitude")))
        .groupBy("latitude", "longitude").agg(F.expr("count(1) AS weight"), F.expr("min(id) AS first_id"))
        .selectExpr("*", f"floor(latitude / {fine!r}D) AS fx", f"floor(longitude / {fine!r}D) AS fy")
        .selectExpr("*", f"shiftright(fx, {bits}) AS cx", f"shiftright(fy, {bits}) AS cy"))


def _place_sites(points: DataFrame, eps: float, limits: Limits) -> Grid | None:
    return grid_of(checkpoint(site_rows(points, eps)), eps, limits)


def grid_of(sites: DataFrame, eps: float, limits: Limits) -> Grid | None:
    """Written ``site_rows`` on the grid, and the cells, written once; None without sites."""
    cells = checkpoint(sites.groupBy("cx", "cy").agg(
        F.expr("count(1) AS n_sites"), F.expr("sum(weight) AS cell_weight"), *_box()))
    size = cells.agg(F.expr("sum(n_sites) AS total"), F.expr("max(n_sites) AS largest")).first()
    if size["total"] is None:
        return None
    # More than `limit` sites in a cell: at most HOT_KEYS cells, so their list can be broadcast.
    limit = max(limits.hot_sites, size["total"] // HOT_KEYS)
    cells = cells.selectExpr("*", f"CAST(ceil(n_sites / {limit}) AS INT) AS salts")
    if size["largest"] <= limit:
        return Grid(sites.selectExpr("*", "1 AS salts", "0 AS salt"), cells, eps)
    hot = cells.where(F.col("n_sites") > limit).select("cx", "cy", "salts")
    salted = sites.join(F.broadcast(hot), ["cx", "cy"], "left").withColumn("salts", F.expr("coalesce(salts, 1)"))
    salted = salted.selectExpr("*", "CAST(pmod(xxhash64(latitude, longitude), salts) AS INT) AS salt")
    return Grid(salted, cells, eps)


def _per_salt(cells: DataFrame, value: str) -> DataFrame:
    """A value of every cell, repeated for each part its sites are split into."""
    return cells.selectExpr("cx", "cy", "explode(sequence(0, salts - 1)) AS salt", value)


def _flag_core(grid: Grid, min_samples: int) -> DataFrame:
    weighed = grid.sites.join(_per_salt(grid.cells, "cell_weight"), ["cx", "cy", "salt"])
    dense = weighed.where(f"cell_weight >= {min_samples}").selectExpr("*", "true AS is_core")
    sparse = weighed.where(f"cell_weight < {min_samples}")
    values = grid.sites.selectExpr("cx", "cy", "salt", "latitude", "longitude", "weight AS value")
    around = _around(grid, sparse, grid.cells.withColumnRenamed("cell_weight", "value"), values)
    counted = around.groupBy("q_lat", "q_lng").agg(F.expr("sum(value) AS near"))
    judged = sparse.join(counted, F.expr("latitude = q_lat AND longitude = q_lng"), "left"
    ).withColumn("is_core", F.expr(f"coalesce(near >= {min_samples}, false)"))
    return dense.unionByName(judged.select(*dense.columns))


def _around(grid: Grid, queries: DataFrame, cells: DataFrame, sites: DataFrame) -> DataFrame:
    """What lies within eps of each query point: (q_lat, q_lng, value).

    A cell whose box is wholly inside contributes its own ``value`` at once; a
    cell the circle cuts is compared site by site, each site giving its
    ``value``. Sites of a large cell sit under several salts, all visited.
    """
    reach = (
        queries.selectExpr("latitude AS q_lat", "longitude AS q_lng", "cx", "cy", f"explode(sequence(-{REACH}, {REACH})) AS dx")
        .selectExpr("*", f"explode(sequence(-{REACH}, {REACH})) AS dy")
        .selectExpr("q_lat", "q_lng", "cx + dx AS cx", "cy + dy AS cy")
    )
    boxes = cells.selectExpr("cx", "cy", "salts", "lat0", "lat1", "lng0", "lng1", "value AS cell_value")
    gaps = "greatest(lat0 - q_lat, q_lat - lat1, 0D) AS gap_lat", "greatest(lng0 - q_lng, q_lng - lng1, 0D) AS gap_lng"
    spans = "greatest(lat1 - q_lat, q_lat - lat0) AS far_lat", "greatest(lng1 - q_lng, q_lng - lng0) AS far_lng"
    touched = (
        reach.join(boxes, ["cx", "cy"]).selectExpr("*", *gaps, *spans)
        .where(f"gap_lat * gap_lat + gap_lng * gap_lng <= {grid.limit}")
        .withColumn("inside", F.expr(f"far_lat * far_lat + far_lng * far_lng <= {grid.limit}"))
        .selectExpr("q_lat", "q_lng", "cx", "cy", "inside", "cell_value",
                    "explode(if(inside, array(-1), sequence(0, salts - 1))) AS salt")
    )
    hit = ("(q_lat - latitude) * (q_lat - latitude) + (q_lng - longitude) * (q_lng - longitude) "
           f"<= {grid.limit}")
    return (
        touched.join(sites, ["cx", "cy", "salt"], "left")
        .selectExpr("q_lat", "q_lng", f"CASE WHEN inside THEN cell_value WHEN {hit} THEN value END AS value")
        .where("value IS NOT NULL")
    )


def _core_cells(core: DataFrame) -> DataFrame:
    """Cells with core sites: one node each, with the box and count of those sites."""
    return core.groupBy("cx", "cy").agg(
        F.expr("count(1) AS n"), F.expr("max(salts) AS salts"), F.expr("min(first_id) AS first_id"), *_box(),
    ).withColumn("node", F.expr("shiftleft(cx, 32) | (cy & 4294967295)"))


def _between(end: str) -> str:
    """SQL for the squared smallest ("near") or largest ("far") distance between box_a and box_b."""
    parts = []
    for axis in ("lat", "lng"):
        a0, a1, b0, b1 = (f"box_{s}.{axis}{i}" for s in ("a", "b") for i in (0, 1))
        part = f"greatest({a0} - {b1}, {b0} - {a1}, 0D)" if end == "near" else f"greatest({a1} - {b0}, {b1} - {a0})"
        parts.append(f"{part} * {part}")
    return " + ".join(parts)


def _links(grid: Grid, core: DataFrame, core_cells: DataFrame, limits: Limits) -> DataFrame:
    """Pairs of core cells (hi, lo) that hold two core sites within eps of each other."""
    box, cell = "struct(lat0, lat1, lng0, lng1)", "struct(node, cx, cy, n, salts)"
    left = (
        core_cells.selectExpr(f"{cell} AS a", f"{box} AS box_a", f"explode(sequence(0, {REACH})) AS dx")
        .selectExpr("*", f"explode(sequence(-{REACH}, {REACH})) AS dy")
        .where("dx > 0 OR dy > 0")  # each pair of cells from one side only
        .selectExpr("a", "box_a", "a.cx + dx AS cx", "a.cy + dy AS cy")
    )
    right = core_cells.selectExpr("cx", "cy", f"{cell} AS b", f"{box} AS box_b")
    pairs = checkpoint(
        left.join(right, ["cx", "cy"]).where(f"{_between('near')} <= {grid.limit}")
        .selectExpr("a", "b", f"{_between('far')} <= {grid.limit} AS linked",
                    f"a.n * b.n <= {limits.direct_pairs} AND a.salts = 1 AND b.salts = 1 AS small"))
    waiting = pairs.agg(
        F.expr("count_if(NOT linked AND small) AS small"), F.expr("count_if(NOT linked AND NOT small) AS large")).first()
    found = pairs.where("linked").selectExpr("a.node AS a", "b.node AS b")
    if waiting["small"]:
        found = found.unionByName(_compare_sites(grid, core, pairs.where("NOT linked AND small")))
    if waiting["large"]:
        found = found.unionByName(_refine(core, pairs.where("NOT linked AND NOT small"), grid))
    return found.selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo")


_PAIR = ("a.node AS a", "b.node AS b", "a.cx AS ax", "a.cy AS ay", "b.cx AS bx", "b.cy AS by")


def _compare_sites(grid: Grid, core: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cell pairs with few sites: compare these outright."""
    plain = core.where("salts = 1")

    def side(s: str) -> DataFrame:
        return plain.selectExpr(f"cx AS {s}x", f"cy AS {s}y", f"latitude AS {s}_lat", f"longitude AS {s}_lng")

    met = pairs.selectExpr(*_PAIR).join(side("a"), ["ax", "ay"]).join(side("b"), ["bx", "by"])
    hit = f"(a_lat - b_lat) * (a_lat - b_lat) + (a_lng - b_lng) * (a_lng - b_lng) <= {grid.limit}"
    return met.where(hit).select("a", "b").distinct()


def _refine(core: DataFrame, pairs: DataFrame, grid: Grid) -> DataFrame:
    """Cell pairs with many sites: split both boxes until one pair of parts decides.

    Per round a part splits into at most 16; part pairs that are too far apart
    go, one that is wholly within eps settles its cell pair. A part with a
    single site is a point, so its distance is exact. Only the facing edges of
    two cells stay open, never their full contents.
    """
    shift = _bits(grid.eps)
    waiting, found = pairs.selectExpr(*_PAIR), None
    while True:
        finer = max(0, shift - HALVINGS)
        if shift == 0:  # parts are the finest grid squares: take the sites themselves
            parts = core.selectExpr(
                "fx AS px", "fy AS py", "fx AS kx", "fy AS ky", "named_struct('lat0', latitude, 'lat1', latitude, "
                "'lng0', longitude, 'lng1', longitude) AS box")
        else:
            keys = [F.expr(f"shiftright({f}, {by}) AS {name}") for f, by, name in (
                ("fx", shift, "px"), ("fy", shift, "py"), ("fx", finer, "kx"), ("fy", finer, "ky"))]
            parts = core.groupBy(*keys).agg(*_box()).selectExpr(
                "px", "py", "kx", "ky", "struct(lat0, lat1, lng0, lng1) AS box")

        def side(s: str) -> DataFrame:
            return parts.selectExpr(f"px AS {s}x", f"py AS {s}y", f"kx AS {s}kx", f"ky AS {s}ky", f"box AS box_{s}")

        tried = checkpoint(
            waiting.join(side("a"), ["ax", "ay"]).join(side("b"), ["bx", "by"])
            .where(f"{_between('near')} <= {grid.limit}")
            .selectExpr("a", "b", "akx AS ax", "aky AS ay", "bkx AS bx", "bky AS by",
                        f"{_between('far')} <= {grid.limit} AS linked"))
        linked = tried.where("linked").select("a", "b").distinct()
        found = linked if found is None else found.unionByName(linked)
        waiting = tried.where("NOT linked").join(linked, ["a", "b"], "left_anti").drop("linked")
        if shift == 0 or waiting.isEmpty():
            return found.distinct()
        shift = finer


def _number_clusters(grid: Grid, core_cells: DataFrame, links: DataFrame, limits: Limits) -> DataFrame:
    """Core cells with the number of their cluster."""
    sizes = {"broadcast_rows": limits.broadcast_rows, "hot_rows": limits.hot_rows}
    roots = connected_components(links, **sizes)
    rooted = checkpoint(
        core_cells.join(roots, "node", "left").withColumn("root", F.expr("coalesce(root, node)")))
    clusters = global_rank(
        rooted.groupBy("root").agg(F.expr("min(first_id) AS first_id"), F.expr("count(1) AS cells")),
        [F.asc("first_id"), F.asc("root")], "cluster_label", start=0,
    ).selectExpr("root", "CAST(cluster_label AS INT) AS cluster_label", "cells")
    counts = clusters.agg(F.expr("count(1) AS n"), F.expr("sum(cells) AS cells")).first()
    return lookup_join(
        rooted, clusters, ["root"], spread=["node"], table_rows=counts["n"], total=counts["cells"] or 0,
        weight="cells", **sizes)


def _assign(grid: Grid, flagged: DataFrame, numbered: DataFrame) -> DataFrame:
    """Cluster of every site: its cell's for core, the lowest adjacent for border, -1 else."""
    core = flagged.where("is_core").join(_per_salt(numbered, "cluster_label"), ["cx", "cy", "salt"])
    others = flagged.where("NOT is_core")
    touched = _around(
        grid, others, numbered.withColumn("value", F.col("cluster_label")),
        core.selectExpr("cx", "cy", "salt", "latitude", "longitude", "cluster_label AS value"))
    lowest = touched.groupBy("q_lat", "q_lng").agg(F.expr("min(value) AS lowest"))
    bordering = others.join(lowest, F.expr("latitude = q_lat AND longitude = q_lng"), "left")
    columns = ["latitude", "longitude", "weight", "is_core"]
    return core.select(*columns, "cluster_label").unionByName(
        bordering.selectExpr(*columns, f"coalesce(lowest, {C.NOISE}) AS cluster_label"))
