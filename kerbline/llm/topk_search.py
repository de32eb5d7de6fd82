"""Exact top-k by inner product: descending norms, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are ranked by norm and cut into groups of bounded size. All queries, in
blocks, first meet the group of the longest vectors, which gives each query a
threshold. A group meets a block later only if |q| * (longest norm of the group)
reaches the threshold of some query. Within a task, rotated by the singular
vectors of all rows, the first coordinates give a partial sum, and the norms of
the remaining coordinates bound what is missing; only survivors get their exact
integer product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import matrix
from kerbline.session import Written

GROUP_ROWS = 16_384   # vectors in a group, about
BLOCK_ROWS = 512      # queries in a block, about
STEP_ROWS = 2_048     # vectors multiplied at once
RESULT = "query_id long, rank int, vec_id long, score long"


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    ``vectors`` and ``queries`` are (id long, vec array<long>), ids unique, no
    nulls inside. A query never meets the vector of its own id; ties go to the
    smaller id; vectors of another length than the query's take no part. Where
    the product of the largest norms says that a score might not fit a long, it
    fails. Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    written = Written(spark, "topk")
    packed = vectors.select("id", "vec").mapInPandas(_pack, "id long, dim int, norm double, data binary")
    packed = written.keep(packed)
    total, longest = packed.agg(F.count(F.lit(1)), F.max("norm")).first()
    if total == 0:
        return spark.createDataFrame([], RESULT)
    turn = _rotation(packed)
    groups = max(1, math.ceil(total / GROUP_ROWS))
    ranked = packed.repartitionByRange(groups, F.desc("norm"), F.asc("id")).withColumn("g", F.spark_partition_id())
    ranked = written.keep(ranked)
    asked = queries.select("id", "vec").mapInPandas(_pack, "id long, dim int, norm double, data binary")
    asked = written.keep(asked)
    n_asked, widest = asked.agg(F.count(F.lit(1)), F.max("norm")).first()
    if n_asked and longest * widest >= 2.0**62:
        raise OverflowError("vectors are too long for inner products in long numbers")
    blocks = max(1, math.ceil(n_asked / BLOCK_ROWS))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    first_group = ranked.agg(F.min("g")).first()[0]
    search = _search(k, turn)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    head = ranked.where(F.col("g") == first_group).select("*", every_block)
    found = written.keep(_meet(head, asked.withColumns({"g": F.lit(first_group), "least": F.lit(None).cast("double")}), search))

    if ranked.where(F.col("g") != first_group).isEmpty():
        return _best(found, k)
    kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    asked = written.keep(asked.join(kth, "id", "left"))
    # A group can matter to a block if its longest vector can reach the easiest threshold there.
    reach = F.min(F.when(F.col("least").isNull() | (F.col("norm") == 0), F.lit(-math.inf)).otherwise(F.col("least") / F.col("norm") * (1 - 1e-9) - 1e-9))
    per_block = asked.groupBy("b").agg(reach.alias("reach"))
    per_group = ranked.where(F.col("g") != first_group).groupBy("g").agg(F.max("norm").alias("longest"))
    pairs = written.keep(per_group.join(per_block, F.col("longest") >= F.col("reach")).select("g", "b"))
    later = _meet(ranked.join(pairs, "g"), asked.join(pairs, "b"), search)
    return _best(found.unionByName(later), k)


def _meet(rows: DataFrame, asked: DataFrame, search) -> DataFrame:
    left = rows.select("g", "b", "id", "dim", "norm", "data").groupBy("g", "b")
    right = asked.select("g", "b", "id", "dim", "norm", "data", "least").groupBy("g", "b")
    return left.cogroup(right).applyInPandas(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(batches):
    for pdf in batches:
        if pdf.empty:
            continue
        rows = [np.asarray(v, np.int64) for v in pdf["vec"]]
        yield pd.DataFrame({
            "id": pdf["id"], "dim": [len(v) for v in rows],
            "norm": [float(np.sqrt((v.astype(float) ** 2).sum())) for v in rows], "data": [v.tobytes() for v in rows]})


def _rotation(packed: DataFrame) -> tuple[int, bytes]:
    """The commonest vector length and the right singular vectors of all rows of that length.

    Each task sums the outer products of its rows; only length x length numbers reach the driver.
    """
    dim = packed.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]

    def products(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            rows = matrix(pdf["data"], np.int64, dim).astype(float)
            total += rows.T @ rows
        i, j = np.indices((dim, dim))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = packed.where(F.col("dim") == dim).select("data").mapInPandas(products, "i int, j int, v double")
    gram = np.zeros((dim, dim))
    for row in sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[row.i, row.j] = row.v
    values, turn = np.linalg.eigh((gram + gram.T) / 2)
    return dim, np.ascontiguousarray(turn[:, np.argsort(-values)]).tobytes()


def _search(k: int, rotation: tuple[int, bytes]):
    common_dim, turn_bytes = rotation

    def one_dim(rows: pd.DataFrame, asked: pd.DataFrame, dim: int) -> list[pd.DataFrame]:
        rows = rows.sort_values(["norm", "id"], ascending=[False, True])
        turn = np.frombuffer(turn_bytes).reshape(dim, dim) if dim == common_dim else np.eye(dim)
        x, q = matrix(rows["data"], np.int64, dim), matrix(asked["data"], np.int64, dim)
        ids, own = rows["id"].to_numpy(), asked["id"].to_numpy()
        xn, qn = rows["norm"].to_numpy(), asked["norm"].to_numpy()
        least = asked["least"].fillna(-math.inf).to_numpy().astype(float)
        head = max(1, dim // 4)
        xt, qt = x.astype(float) @ turn, q.astype(float) @ turn
        x_rest, q_rest = np.sqrt((xt[:, head:] ** 2).sum(1)), np.sqrt((qt[:, head:] ** 2).sum(1))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        for start in range(0, len(x), STEP_ROWS):
            part = slice(start, start + STEP_ROWS)
            slack = 1e-9 * qn[:, None] * xn[part][None, :] + 1e-6
            if not (qn * xn[start] * (1 + 1e-9) + 1e-6 >= least).any():
                break  # norms fall from here on
            bound = qt[:, :head] @ xt[part, :head].T + q_rest[:, None] * x_rest[part][None, :] + slack
            for i, alive in enumerate(bound >= least[:, None]):
                at = np.flatnonzero(alive)
                at = at[ids[part][at] != own[i]]
                if not len(at):
                    continue
                scores = np.concatenate([best[i][0], x[part][at] @ q[i]])
                names = np.concatenate([best[i][1], ids[part][at]])
                keep = np.lexsort((names, -scores))[:k]
                best[i] = scores[keep], names[keep]
                if len(keep) == k:
                    least[i] = max(least[i], float(scores[keep[-1]]))
        return [pd.DataFrame({"query_id": own[i], "vec_id": names, "score": scores}) for i, (scores, names) in enumerate(best) if len(names)]

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim in np.intersect1d(rows["dim"], asked["dim"]):
            out += one_dim(rows[rows["dim"] == dim], asked[asked["dim"] == dim], int(dim))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return search
