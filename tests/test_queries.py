"""Every registered query against its SQL in a second engine, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as driver
from kerbline.catalog import oracles
from kerbline.catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
MODEL_QUERIES = {"approval_scores", "approval_logloss", "approval_share", "approval_repeats", "approval_compiled", "model_round_trip"}  # 100 boosting rounds; checked in test_jobs with few


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def order(row):
    return tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(set(oracles.build()) - MODEL_QUERIES))
def test_same_rows(spark, engine, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = engine.execute(oracles.build()[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    expected = sorted((tuple(row[given.index(c)] for c in columns) for row in result.fetchall()), key=order)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=order) == expected


def test_every_query_is_checked():
    """Queries of optional parts may have no SQL; they are tested with these parts."""
    assert set(QUERIES) == set(oracles.build())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["position", "junction_name", "violations", "cis", "recommendation"]
    assert df.count() == 10


def test_split_counts(spark):
    rows = {r.is_train: r for r in QUERIES["approval_split"](spark, FOLDER).collect()}
    total = sum(r.n for r in rows.values())
    assert 0.7 < rows[True].n / total < 0.9
