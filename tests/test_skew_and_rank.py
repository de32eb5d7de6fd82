import math
import random

from pyspark.sql import functions as F

from kerbline.operators.components import connected_components
from kerbline.operators.ranking import global_rank, topsis
from kerbline.operators.skew import hot_threshold, lookup_join


def rows_and_table(spark):
    rng = random.Random(5)
    keys = [0 if rng.random() < 0.4 else rng.randint(1, 30) for _ in range(600)]
    data = [(i, None if i % 7 == 0 else k, i % 5 != 0) for i, k in enumerate(keys)]
    rows = spark.createDataFrame(data, "id long, k long, ok boolean")
    table = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in range(0, 25)], "k long, v string, n long")
    expected = {i: (f"v{k}" if ok and k is not None and k < 25 else None) for i, k, ok in data}
    return rows, table, expected


def test_lookup_join_plans_agree(spark):
    rows, table, expected = rows_and_table(spark)
    for options in (
        {"table_rows": 25},
        {"table_rows": 25, "broadcast_rows": 0, "hot_rows": 50, "weight": "n"},
        {"table_rows": 25, "broadcast_rows": 0, "hot_rows": 50},
        {"table_rows": 25, "broadcast_rows": 0},
    ):
        slim = table if "weight" in options else table.drop("n")
        got = lookup_join(rows, slim, ["k"], spread=["id"], total=600, active=F.col("ok"), **options)
        collected = got.collect()
        assert got.columns == ["id", "k", "ok", "v"]
        assert len(collected) == 600
        assert {r.id: r.v for r in collected} == expected


def test_hot_keys_are_bounded():
    for total in (10, 10**6, 10**12):
        assert total // (hot_threshold(total) + 1) <= 10_000


def test_settled_rows_are_spread(spark):
    """A key with most rows does not land in one shuffle partition."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    table = spark.range(-1, 20_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = lookup_join(rows, table, ["k"], spread=["id"], table_rows=20_001, total=20_000, broadcast_rows=0, hot_rows=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000
    assert max(sizes) < 6_000


def find_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(9)
    path = [(i + 1, i) for i in range(100, 140)]
    hub = [(1000 + i, 999) for i in range(60)]
    sparse = [tuple(sorted(rng.sample(range(200, 400), 2), reverse=True)) for _ in range(120)]
    edges = path + hub + sparse
    df = spark.createDataFrame(edges, "hi long, lo long")
    for options in ({}, {"broadcast_rows": 0, "hot_rows": 10}):
        got = {r.node: r.root for r in connected_components(df, **options).collect()}
        assert got == find_components(edges)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_global_rank_is_a_total_order(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v")).repartition(13)
    got = global_rank(df, [F.desc("v"), F.asc("id")], start=0).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(5000))
    assert [(r.v, r.id) for r in got] == sorted(((i * 7919 % 101, i) for i in range(5000)), key=lambda p: (-p[0], p[1]))


def test_topsis_by_hand(spark):
    data = [(0, 3.0, 1.0, 0.0), (1, 1.0, 2.0, 0.0), (2, 2.0, None, 0.0)]
    got = {r.i: r.closeness for r in topsis(
        spark.createDataFrame(data, "i int, a double, b double, z double"), ["a", "b", "z"]).collect()}
    na, nb = math.sqrt(14), math.sqrt(5)
    for i, a, b, _ in data:
        b = b or 0.0
        near = math.hypot((a - 3) / na / 3, (b - 2) / nb / 3)
        far = math.hypot((a - 1) / na / 3, b / nb / 3)
        assert got[i] == round(far / (near + far), 6)


def test_topsis_of_equal_rows(spark):
    got = topsis(spark.createDataFrame([(0, 1.0), (1, 1.0)], "i int, a double"), ["a"]).collect()
    assert [r.closeness for r in got] == [0.0, 0.0]


def test_records_are_ranked_by_two_columns(spark, monkeypatch):
    """What is sorted to number the hotspots is their name and count, not the records."""
    from kerbline.catalog.tables import scored
    from kerbline.operators import junctions, ranking

    sorted_columns = []
    plain = ranking.checkpoint
    monkeypatch.setattr(ranking, "checkpoint", lambda df: sorted_columns.append(df.columns) or plain(df))
    hotspots = junctions.junction_hotspots(scored(spark, "/root/testdata/sf0.001", per_user=True))
    assert sorted_columns == [["name", "violations", "_place"]]
    rows = hotspots.select("id", "name", "violations").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    assert rows == sorted(rows, key=lambda r: (-r.violations, r.name))


def test_top_of_records_needs_no_rank(spark, monkeypatch):
    from kerbline.catalog.tables import scored
    from kerbline.operators import explore, junctions, ranking

    rows = scored(spark, "/root/testdata/sf0.001", per_user=True)
    by_rank = explore.top_by_cis(junctions.junction_hotspots(rows), 7).drop("id").collect()
    monkeypatch.setattr(ranking, "checkpoint", None)
    assert explore.top_by_cis(junctions.junction_records(rows), 7).collect() == by_rank
