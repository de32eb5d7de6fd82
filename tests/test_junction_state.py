"""Junction figures from batches in any order, with replays, failures and merges, against one pass over all tickets."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.catalog.tables import scored
from kerbline.functions import scoring
from kerbline.operators import junctions
from kerbline.operators.junction_state import JunctionState, _covered, _joined
from kerbline.sources import tickets
from kerbline.streaming import scores
from kerbline.streaming.junctions import follow
from tests.test_jobs import raw_csv

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def given(spark):
    return scored(spark, FOLDER).where("id % 3 = 0").cache()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_replays(spark, tmp_path, given, seed):
    rng = random.Random(seed)
    state = JunctionState(spark, str(tmp_path / "state"))
    assert state.folded() is None
    steps = [*range(6), *rng.choices(range(6), k=4)]
    rng.shuffle(steps)
    for i, step in enumerate(steps):
        state.apply(step, given.where(F.col("id") % 6 == step))
        if rng.random() < 0.4:
            state.merge()
    assert rows_of(state.summary()) == rows_of(junctions.junction_summary(given))
    assert rows_of(state.vehicle_mix()) == rows_of(junctions.vehicle_mix(given))
    assert rows_of(state.peak_hours()) == rows_of(junctions.peak_hours(given))
    assert rows_of(state.hourly_trend()) == rows_of(junctions.hourly_trend(given))
    assert rows_of(state.trend_multipliers()) == rows_of(junctions.trend_multipliers(given))
    assert rows_of(state.records()) == rows_of(junctions.junction_records(given))
    assert rows_of(state.metadata()) == rows_of(junctions.junction_metadata(given))


def test_merged_batches_stay_applied(spark, tmp_path, given):
    state = JunctionState(spark, str(tmp_path / "state"))
    assert state.apply(7, given) and state.apply(7, given)
    state.merge()
    state.merge()
    assert not state.apply(7, given) and state.apply(9, given.where("false"))
    state.merge()
    assert state._merged() == (1, [(7, 7), (9, 9)])
    assert rows_of(state.summary()) == rows_of(junctions.junction_summary(given))


def test_unfinished_writes_do_not_count(spark, tmp_path, given):
    """A batch or merge whose write broke off is as if it had not begun."""
    state = JunctionState(spark, str(tmp_path / "state"))
    state.apply(0, given)
    state.merge()
    expected = rows_of(state.summary())
    junctions.fold_junctions(given).write.parquet(str(tmp_path / "state/batches/1"))
    (tmp_path / "state/batches/1/_SUCCESS").unlink()
    junctions.fold_junctions(given).write.parquet(str(tmp_path / "state/merged/1/rows"))
    assert rows_of(state.summary()) == expected
    state.apply(1, given.where("false"))
    state.merge()
    assert rows_of(state.summary()) == expected and state._merged()[1] == [(0, 1)]


def test_ranges():
    assert _joined([(5, 5), (1, 2), (3, 3), (9, 9)]) == [(1, 3), (5, 5), (9, 9)]
    assert _covered([(1, 3)], 2) and not _covered([(1, 3)], 4)


def test_reports_follow_a_stream(spark, tmp_path):
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    raw_csv(tmp_path / "raw.csv")
    head, *lines = (tmp_path / "raw.csv").read_text().splitlines(keepends=True)
    for part in range(3):
        (incoming / f"{part}.csv").write_text(head + "".join(lines[part::3]))
        stream = scores.scored_stream(spark, str(incoming))
        follow(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), merge_every=2).awaitTermination()
    batch = scoring.score(tickets.read_violations(spark, str(tmp_path / "raw.csv")))
    state = JunctionState(spark, str(tmp_path / "state"))
    assert state._merged() == (0, [(0, 1)])
    assert rows_of(state.records()) == rows_of(junctions.junction_records(batch))


def test_reports_read_no_tickets(spark, tmp_path, given):
    state = JunctionState(spark, str(tmp_path / "state"))
    state.apply(0, given)
    assert all("batches/0" in path for path in state.records().inputFiles())
