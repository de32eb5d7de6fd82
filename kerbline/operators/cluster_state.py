"""DBSCAN labels kept up to date as tickets are added.

Added points can only make points core, join clusters and give borders to noise, so
what is known of a site never has to be taken back. A batch opens the cells from
which one of its points can be reached over two steps of eps; all distances,
links and borders are computed among the sites of these cells by the steps of the
full run. Every core cell belongs to a component, an id it keeps for good, and
every component has a root in a small table; a link between two components moves
roots, never sites. Sites lie in tiles of the grid, and a batch reads and
rewrites the tiles of its cells only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.operators import dbscan
from kerbline.operators.components import connected_components
from kerbline.operators.dbscan import REACH, Limits
from kerbline.operators.junction_state import DONE, _covered, _joined
from kerbline.operators.ranking import global_rank
from kerbline.operators.skew import lookup_join
from kerbline.session import Written, checkpoint, children

TILE_BITS = 5  # a tile is 32 x 32 cells
_SITE = ("latitude", "longitude", "weight", "first_id", "fx", "fy", "cx", "cy", "is_core", "component", "touching", "tile")


@dataclass(frozen=True)
class ClusterState:
    """Clustered points in ``folder``, which all executors share.

    Version n has the tiles that batch rewrote (``sites/version=n``), where every
    tile is found (``tiles/n``), the components (``components/n``) and, written
    last, the ids of all batches in it (``ids/n``). One writer at a time.
    """

    spark: SparkSession
    folder: str
    eps: float = C.EPS_DEGREES
    min_samples: int = C.MIN_SAMPLES
    limits: Limits = Limits()

    def apply(self, batch_id: int, points: DataFrame) -> bool:
        """Add ``points`` (id, latitude, longitude); False if a batch of this id is in the state already.

        An id stands for its points. Coordinates that are null, NaN or infinite are left out.
        """
        version, ids = self._current()
        if _covered(ids, batch_id):
            return False
        written = Written(self.spark, "clusters")
        added = written.keep(dbscan.site_rows(points, self.eps).withColumn("tile", _tile()))
        if added.isEmpty():  # nothing to keep, and nothing a replay could count twice
            written.clear()
            return True
        opened = written.keep(_around_cells(added.select("cx", "cy").distinct(), 2 * REACH))
        tiles = written.keep(opened.select(_tile().alias("tile")).distinct())
        sites = written.keep(self._with_added(version, added, tiles))
        active = written.keep(sites.join(opened, ["cx", "cy"], "left_semi").withColumnRenamed("is_core", "was_core"))
        grid = dbscan.grid_of(active, self.eps, self.limits)
        found, components = self._grown(grid, version, written)
        found = found.unionByName(sites.join(opened, ["cx", "cy"], "left_anti").select(*_SITE))
        self._write(version, [*ids, (batch_id, batch_id)], found, components, tiles)
        written.clear()
        return True

    def sites(self) -> DataFrame:
        """(latitude, longitude, weight, is_core, cluster_label) of all places, as a full run gives them."""
        version, _ = self._current()
        if version is None:
            return self.spark.createDataFrame([], "latitude double, longitude double, weight long, is_core boolean, cluster_label int")
        sites, components = self._all_sites(version), self._components(version)
        roots = global_rank(components.groupBy("root").agg(F.min("first_id").alias("first_id")), [F.asc("first_id"), F.asc("root")], "cluster_label", start=0)
        numbers = checkpoint(components.join(roots.select("root", F.col("cluster_label").cast("int").alias("cluster_label")), "root").select("component", "cluster_label"))
        size = numbers.count()

        def numbered(rows: DataFrame) -> DataFrame:
            return lookup_join(rows, numbers, ["component"], spread=["latitude", "longitude"], table_rows=size, total=size,
                               broadcast_rows=self.limits.broadcast_rows, hot_rows=self.limits.hot_rows)

        columns = ["latitude", "longitude", "weight", "is_core"]
        core = numbered(sites.where("is_core").select(*columns, "component"))
        others = sites.where("NOT is_core")
        beside = numbered(others.select(*columns, F.explode_outer("touching").alias("component")))
        lowest = beside.groupBy(*columns).agg(F.coalesce(F.min("cluster_label"), F.lit(C.NOISE)).alias("cluster_label"))
        return core.select(*columns, "cluster_label").unionByName(lowest)

    def _with_added(self, version: int | None, added: DataFrame, tiles: DataFrame) -> DataFrame:
        """All sites of the tiles, the added points among them."""
        first_id = added.schema["first_id"].dataType.simpleString()
        fresh = added.selectExpr("*", "false AS is_core", "CAST(NULL AS BIGINT) AS component", "CAST(array() AS array<bigint>) AS touching").select(*_SITE)
        if version is None:
            return fresh
        known = self._all_sites(version).join(tiles, "tile", "left_semi").select(*_SITE).withColumn("first_id", F.col("first_id").cast(first_id))
        # A place has at most two rows here; of its lists the added one is empty and so the smaller.
        place = ["latitude", "longitude", "fx", "fy", "cx", "cy", "tile"]
        return known.unionByName(fresh).groupBy(*place).agg(
            F.sum("weight").alias("weight"), F.min("first_id").alias("first_id"), F.max("is_core").alias("is_core"),
            F.max("component").alias("component"), F.max("touching").alias("touching")).select(*_SITE)

    def _grown(self, grid: dbscan.Grid, version: int | None, written: Written) -> tuple[DataFrame, DataFrame]:
        """The sites of the opened cells and the components after the batch.

        At the rim of the opened cells some neighbours are missing, so a test
        there can only fail; it then leaves what was known.
        """
        flagged = written.keep(dbscan._flag_core(grid, self.min_samples).withColumn("is_core", F.col("is_core") | F.col("was_core")))
        core = flagged.where("is_core")
        cells = dbscan._core_cells(core).join(
            flagged.where("was_core").groupBy("cx", "cy").agg(F.max("component").alias("component")), ["cx", "cy"], "left")
        cells = written.keep(cells.withColumn("component", F.coalesce("component", "node")))
        all_components = cells.groupBy("component").agg(F.lit(None).cast("long").alias("root"), F.min("first_id").alias("first_id"))
        if version is not None:
            all_components = self._components(version).unionByName(all_components).groupBy("component").agg(F.max("root").alias("root"), F.min("first_id").alias("first_id"))
        components = written.keep(all_components.withColumn("root", F.coalesce("root", "component")))

        roots = cells.select("node", "component").join(components.select("component", "root"), "component").select("node", "root")
        links = dbscan._links(grid, core, cells, self.limits)
        ends = links.join(roots.selectExpr("node AS hi", "root AS a"), "hi").join(roots.selectExpr("node AS lo", "root AS b"), "lo")
        joined = connected_components(ends.where("a <> b").selectExpr("greatest(a, b) AS hi", "least(a, b) AS lo").distinct())
        moved = joined.selectExpr("node AS root", "root AS new_root")
        components = components.join(moved, "root", "left").select("component", F.coalesce("new_root", "root").alias("root"), "first_id")

        others = flagged.where("NOT is_core")
        beside = dbscan._around(grid, others, cells.withColumn("value", F.col("component")),
                                core.drop("component").join(dbscan._per_salt(cells, "component"), ["cx", "cy", "salt"]).withColumn("value", F.col("component"))
                                .select("cx", "cy", "salt", "latitude", "longitude", "value"))
        beside = beside.groupBy("q_lat", "q_lng").agg(F.collect_set("value").alias("found"))  # of at most 25 cells
        others = others.join(beside, F.expr("latitude = q_lat AND longitude = q_lng"), "left")
        others = others.withColumn("touching", F.array_sort(F.array_union("touching", F.coalesce("found", F.array().cast("array<bigint>")))))
        grown = core.drop("component").join(cells.select("cx", "cy", "component"), ["cx", "cy"]).withColumn("touching", F.array().cast("array<bigint>"))
        return grown.select(*_SITE).unionByName(others.select(*_SITE)), components

    def _write(self, version: int | None, ids: list[tuple[int, int]], sites: DataFrame, components: DataFrame, tiles: DataFrame) -> None:
        number = 0 if version is None else version + 1
        # By range, so that a tile with very many sites is several tasks and files.
        sites.repartitionByRange("tile", "cx", "cy", "latitude").write.mode("overwrite").partitionBy("tile").parquet(f"{self.folder}/sites/version={number}")
        moved = tiles.select("tile", F.lit(number).alias("version"))
        if version is not None:
            moved = self._tiles(version).join(tiles, "tile", "left_anti").unionByName(moved)
        moved.write.mode("overwrite").parquet(f"{self.folder}/tiles/{number}")
        components.write.mode("overwrite").parquet(f"{self.folder}/components/{number}")
        # Written last: without it the version does not count.
        self.spark.createDataFrame(_joined(ids), "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ids/{number}")

    def _current(self) -> tuple[int | None, list[tuple[int, int]]]:
        """The last finished version and the id ranges of its batches."""
        for number in sorted(map(int, children(self.spark, f"{self.folder}/ids")), reverse=True):
            if DONE in children(self.spark, f"{self.folder}/ids/{number}"):
                return number, [(r["first"], r["last"]) for r in self.spark.read.parquet(f"{self.folder}/ids/{number}").collect()]
        return None, []

    def _tiles(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tiles/{version}")

    def _components(self, version: int) -> DataFrame:
        """(component, root, first_id)."""
        return self.spark.read.parquet(f"{self.folder}/components/{version}")

    def _all_sites(self, version: int) -> DataFrame:
        """The sites, each tile in its latest version; a filter on tiles reads only their files."""
        return self.spark.read.parquet(f"{self.folder}/sites").join(self._tiles(version), ["version", "tile"], "left_semi")


def _tile() -> Column:
    return F.expr(f"concat('t', shiftright(cx, {TILE_BITS}), '_', shiftright(cy, {TILE_BITS}))")


def _around_cells(cells: DataFrame, reach: int) -> DataFrame:
    """The cells and those at most ``reach`` away."""
    return (
        cells.selectExpr("cx", "cy", f"explode(sequence(-{reach}, {reach})) AS dx").selectExpr("cx", "cy", "dx", f"explode(sequence(-{reach}, {reach})) AS dy")
        .selectExpr("cx + dx AS cx", "cy + dy AS cy").distinct())
