"""The registered queries against SQL, and the pipeline stage by stage."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from kerbline.llm import catalog, ngram_join, substring_dedup
from kerbline.session import Written
from tests.llm.helpers import awkward_documents, documents, seeded

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, engine, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = engine.execute(catalog.ORACLES[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    order = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    expected = sorted((tuple(row[given.index(c)] for c in columns) for row in result.fetchall()), key=order)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == expected


def test_all_operators_and_the_pipeline_are_registered():
    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def awkward_folder(spark, folder):
    rows = awkward_documents(seeded(7))
    rows += [(700 + i, f"you idiot {i} worthless moron and scum of {i}", "s") for i in range(40)]
    docs = documents(spark, rows, ("score", "lines", "repeats", "version")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], int(r[0] is not None and r[0] >= 700)) for r in rows]
    spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_stages(spark, tmp_path):
    docs = awkward_folder(spark, str(tmp_path))
    columns, written = docs.columns, Written(spark, "test")
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        results.append(written.keep(stage(spark, results[-1], str(tmp_path))))
        if name != "best-fit packing":
            assert results[-1].columns == columns
    clean, lines, unique, passages, packed = results[1:]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == set(range(700, 740))
    # Copies of a whole document lose every line, so only the first is left; clean documents stay as they are.
    assert lines.where("doc_id BETWEEN 100 AND 111").select("doc_id").collect() == [(100,)]
    untouched = {r.doc_id: r.text for r in lines.where("doc_id < 60 AND source <> 'same id'").collect()}
    assert untouched.items() >= {r.doc_id: r.text for r in docs.where("doc_id < 7").collect() if "\n" not in (r.text or "")}.items()
    assert lines.where("n_chars IS DISTINCT FROM length(text)").count() == 0
    again = ngram_join.near_duplicates(unique)
    assert again.where("doc_id <> component_id").count() == 0
    assert unique.where("doc_id IS NULL").count() == lines.where("doc_id IS NULL").count()
    assert substring_dedup.digest(passages).agg(F.sum("n_removed")).first()[0] <= substring_dedup.digest(unique).agg(F.sum("n_removed")).first()[0]
    assert packed.select("doc_id").distinct().count() == passages.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_pipeline_without_documents(spark, tmp_path):
    awkward_folder(spark, str(tmp_path / "full")).where("false").write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
