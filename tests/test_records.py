"""CSV with line breaks inside quotes, read in splits, against the unsplit reader."""

import csv
import random

import pytest

from kerbline.schema import VIOLATIONS_RAW
from kerbline.sources import records, tickets

NAMES = VIOLATIONS_RAW.fieldNames()


def write(path, seed, n, terminator="\n", tail=""):
    rng = random.Random(seed)
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=terminator)
        out.writerow(NAMES)
        for i in range(n):
            text = rng.choice(["plain", "two\nlines", 'a "quoted" word', '"', '""\n"', "\n", "", "x" * rng.randint(0, 400) + "\n" * rng.randint(0, 3) + "y", "comma, é漢"])
            out.writerow([f"{seed}-{i}", "2024-01-11 10:00:00", rng.choice(["CAR", "VAN\nTWO", ""]), '["NO PARKING"]', text, "BTP1 - A", text[::-1], "approved", "12.9", "77.5"])
        f.write(tail)


def unsplit(spark, path):
    return tickets.known_texts(tickets.text_reader(spark.read).option("multiLine", True).csv(path))


@pytest.mark.parametrize("split", ["300", "64", "5000", "134217728"])
def test_same_rows_as_the_unsplit_reader(spark, tmp_path, split):
    for seed in range(3):
        write(tmp_path / f"{seed}.csv", seed, 40)
    (tmp_path / "only_header.csv").write_text(",".join(NAMES) + "\n")
    expected = sorted(map(str, unsplit(spark, str(tmp_path)).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3" if split == "5000" else "10000")
        read = tickets.read_violations_text(spark, str(tmp_path), multi_line=True)
        if split == "300":
            assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(map(str, read.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 120 and got == expected


def test_carriage_returns_blank_lines_and_an_open_end(spark, tmp_path):
    write(tmp_path / "a.csv", 7, 20, "\r\n", "\r\n  \r\n")
    got = tickets.read_violations_text(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [r.id for r in sorted(got, key=lambda r: int(r.id.split("-")[1]))] == [f"7-{i}" for i in range(20)]
    assert all(r.longitude == "77.5" for r in got)
    (tmp_path / "b.csv").write_text(",".join(NAMES) + '\n1,,CAR,"open\nuntil the end')
    assert [tuple(r)[:4] for r in tickets.read_violations_text(spark, str(tmp_path / "b.csv"), multi_line=True).collect()] == [("1", None, "CAR", "open\nuntil the end")]


def test_header_in_another_order_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(reversed(NAMES)) + "\n" + ",".join("1" * len(NAMES)) + "\n")
    with pytest.raises(Exception, match="header"):
        tickets.read_violations_text(spark, str(tmp_path), multi_line=True).collect()


def test_one_record_over_many_splits(spark, tmp_path):
    long = "line\n" * 500
    (tmp_path / "a.csv").write_text(",".join(NAMES) + f'\n1,,CAR,,"{long}",,,,1,2\n2,,CAR,,short,,,,1,2\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        got = {r.id: r.location for r in tickets.read_violations_text(spark, str(tmp_path), multi_line=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"1": long, "2": "short"}
