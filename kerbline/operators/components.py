"""Connected components of an undirected graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.skew import BROADCAST_ROWS, HOT_ROWS, lookup_join
from kerbline.session import checkpoint


def connected_components(edges: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) for every node of ``edges`` (hi, lo; hi > lo); root = smallest node of the component.

    Large-star and small-star steps (Kiveris et al., 2014). A step takes the
    smallest neighbour per node, which Spark pre-aggregates before the shuffle,
    and looks it up per edge with a join that tolerates hub nodes. Each round is
    written to the checkpoint folder; the loop ends when only stars are left.
    """
    sizes = {"broadcast_rows": broadcast_rows, "hot_rows": hot_rows}

    def smallest(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        return lookup_join(rows, least, ["u"], spread=["u", "v"], table_rows=2 * n, total=n, **sizes)

    current = checkpoint(edges.distinct())
    n, unfinished = _progress(current)
    while unfinished:
        # Large star: every larger neighbour of a node moves to the smallest node around it.
        towards = current.selectExpr("inline(array(named_struct('u', hi, 'v', lo), named_struct('u', lo, 'v', hi)))")
        around = towards.groupBy("u").agg(F.expr("least(u, min(v)) AS m"))
        lifted = smallest(current.selectExpr("lo AS u", "hi AS v"), around, n).selectExpr("v AS u", "m AS v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        below = lifted.groupBy("u").agg(F.expr("min(v) AS m"))
        moved = smallest(lifted, below, n).where("v <> m").selectExpr("v AS hi", "m AS lo")
        moved = moved.unionByName(below.selectExpr("u AS hi", "m AS lo"))
        current = checkpoint(moved.distinct())
        n, unfinished = _progress(current)
    return current.selectExpr("inline(array(named_struct('node', hi, 'root', lo), named_struct('node', lo, 'root', lo)))").distinct()


def _progress(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes that are not yet plain members or centres of a star."""
    ends = edges.selectExpr("inline(array(named_struct('node', hi, 'below', 1, 'above', 0), named_struct('node', lo, 'below', 0, 'above', 1)))")
    roles = ends.groupBy("node").agg(F.expr("sum(below) AS below"), F.expr("sum(above) AS above"))
    counts = roles.agg(
        F.expr("sum(below) AS edges"),
        F.expr("count_if(below > 1 OR (below = 1 AND above > 0)) AS unfinished")).first()
    return counts["edges"] or 0, counts["unfinished"]
