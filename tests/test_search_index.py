"""Search by posting lists against the scan."""

import random

import pytest

from kerbline.operators import explore, search


@pytest.fixture(scope="module")
def hotspots(spark):
    rng = random.Random(9)
    words = ["BTP051 - Safina Plaza", "Circle", "MG Road", "KR  Market", "Élite É", "ab", "a", "", "100%", "x_y", "İstanbul", "ABCABC"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.choice(["Station 1", "Upparpet", "S", None])) for i in range(1, 180)]
    return spark.createDataFrame([*rows, (180, None, None)], "id long, name string, jurisdiction string").cache()


def test_same_rows_as_the_scan(spark, hotspots):
    rng = random.Random(2)
    names = [r.name or "" for r in hotspots.collect()] + ["Station 1", "Upparpet"]
    queries = ["", "  ", " ", "a", "É", "é", "ab", "  M", "%", "_", "no such text", "station", "road circle", "İ", "i", "CABC", "abcabca"]
    for length in (1, 2, 3, 4, 7, 12, 25, 40):
        text = rng.choice([n for n in names if len(n) >= min(length, 15)])
        at = rng.randint(0, max(0, len(text) - length))
        queries.append(text[at:at + length].swapcase() if rng.random() < 0.5 else text[at:at + length])
    index = search.build_index(hotspots, block=20).cache()
    assert max(len(r.ids) for r in index.collect()) <= 20
    for query in queries:
        scan = explore.filter_hotspots(hotspots.withColumn("cis", explore.F.lit(1.0)), query=query).select("id")
        assert sorted(search.search(index, hotspots, query).select("id").collect()) == sorted(scan.collect()), query


def test_candidates_come_from_the_lists(spark, hotspots, tmp_path):
    search.build_index(hotspots).write.partitionBy("field").parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = search.candidates(index, "Safina")
    assert all("index" in path for path in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(letters, [" in plan
    assert {r.id for r in found.collect()} == {r.id for r in hotspots.where("name LIKE '%Safina%'").collect()}
    assert search.query_groups("Safina") == ["afi", "fin", "ina", "saf"] and search.query_groups("") == []


def test_empty_index(spark, hotspots):
    nothing = hotspots.where("false")
    assert search.search(search.build_index(nothing), nothing, "abc").collect() == []
