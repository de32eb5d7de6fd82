"""CSV files whose quoted fields hold line breaks, read in splits.

Whether a line begins inside quotes depends on the number of quotes before it in
the file, and of that only whether it is odd. A first pass over the splits takes
one bit from each; a running sum over the splits of a file gives every split the
bit it begins with. In the second pass each split puts its lines together to
records on its own, and only the few records that cross splits meet in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that come from one split; lines come in file order."""
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for first, last in zip([0, *edges], [*edges, batch.num_rows]):
        if first < last:
            yield files.dictionary[int(codes[first])].as_py(), int(blocks[first]), batch.slice(first, last - first)


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines -> (file, block, odd, opens): whether a split has an odd number of quotes, and a line that begins after one."""
    for batch in batches:
        # A split that spans batches gives several rows, numbered; they are put together afterwards.
        for file, block, part in _splits(batch):
            before = np.concatenate([[0], np.cumsum(_quotes(part.column(2)))])
            yield pa.record_batch({"file": pa.array([file]), "block": pa.array([block], pa.int64()), "quotes": pa.array([int(before[-1])], pa.int64()),
                                   "after_even": pa.array([bool((before[:-1] % 2 == 0).any())]), "after_odd": pa.array([bool((before[:-1] % 2 == 1).any())])})


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside, owner) of the splits that begin inside quotes: the split in which that record begins."""
    marks = lines.mapInArrow(_marks, "file string, block long, quotes long, after_even boolean, after_odd boolean")
    marks = marks.withColumn("at", F.monotonically_increasing_id())
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(within), F.lit(0)) % 2 == 1
    marks = marks.withColumn("flip", odd)
    splits = marks.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.max(F.when(F.col("flip"), F.col("after_odd")).otherwise(F.col("after_even"))).alias("after_even"),
        F.max(F.when(F.col("flip"), F.col("after_even")).otherwise(F.col("after_odd"))).alias("after_odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    begins = F.when(F.col("inside"), F.col("after_odd")).otherwise(F.col("after_even"))
    owner = F.last(F.when(begins, F.col("block")), True).over(before)
    return splits.select("file", "block", "inside", owner.alias("owner")).where("inside")


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, value, inside, owner) -> (file, owner, block, first, whole, text): records, and parts of those that cross splits.

    ``first`` marks the first record of a file. A record is whole if it begins and ends in its split.
    """
    held: list[str] = []
    split, begun_here, first = None, True, False

    def rows(file, owner, block, first, whole, texts) -> pa.RecordBatch:
        n = len(texts)
        return pa.record_batch({"file": pa.array([file] * n, pa.string()), "owner": pa.array([owner] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()),
                                "first": pa.array(first, pa.bool_()), "whole": pa.array(whole, pa.bool_()), "text": texts.cast(pa.string())})

    def rest() -> Iterator[pa.RecordBatch]:
        """What a split leaves open."""
        if held:
            yield rows(split[0], split[1] if begun_here else owner, split[1], [first], [False], pa.array(["\n".join(held)]))

    owner = None
    for batch in batches:
        for file, block, part in _splits(batch):
            if (file, block) != split:
                yield from rest()
                inside, owner = bool(part.column(3)[0].as_py()), part.column(4)[0].as_py()
                held, split, begun_here, first = [], (file, block), not inside, block == 0
            values = part.column(2)
            open_ = bool(held) or not begun_here  # the lines held have left quotes open, or the split began so
            odd = (np.cumsum(_quotes(values)) + open_) % 2 == 1
            ends = np.flatnonzero(~odd)
            if not len(ends):
                held += values.to_pylist()
                continue
            # Lines up to each end are one record; nearly all records are one line.
            offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.slice(0, int(ends[-1]) + 1)), "\n")
            whole, firsts = np.ones(len(ends), bool), np.zeros(len(ends), bool)
            firsts[0] = first and begun_here
            if held or not begun_here:
                head = "\n".join([*held, texts[0].as_py()])
                texts = pa.concat_arrays([pa.array([head]), texts.slice(1)])
            whole[0] = begun_here
            if begun_here:
                yield rows(file, block, block, firsts, whole, texts)
            else:
                yield rows(file, owner, block, firsts[:1], whole[:1], texts.slice(0, 1))
                yield rows(file, block, block, firsts[1:], whole[1:], texts.slice(1))
            held, begun_here, first = values.slice(int(ends[-1]) + 1).to_pylist(), True, False
    yield from rest()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of CSV files, line breaks inside quotes kept; ``first`` marks a file's first one.

    Lines end in a line feed, with or without a carriage return. Quotes inside a
    field are doubled, so they come in pairs within a record; a stray quote in
    an unquoted field is taken as an opening one. A record that the end of its
    file leaves open ends there. Blank lines are no records.
    """
    lines = _lines(spark, path)
    # At most one row a split, so a millionth of the input; a map-side join also leaves the lines in their order.
    placed = lines.join(F.broadcast(_starts(lines)), ["file", "block"], "left")
    placed = placed.select("file", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside"), "owner")
    parts = placed.mapInArrow(_put_together, "file string, owner long, block long, first boolean, whole boolean, text string")
    whole = parts.where("whole").select("file", "first", "text")
    crossing = parts.where("NOT whole").groupBy("file", "owner").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    rows = whole.unionByName(crossing.select("file", "first", joined.alias("text")))
    return rows.withColumn("text", F.regexp_replace("text", "\r\\z", "")).where(F.trim("text") != "")


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The text columns of CSV files with a header, as the unsplit reader gives them; a header in another order is an error."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = F.from_csv("text", text.simpleString()[7:-1].replace(":", " "), {"escape": QUOTE, "multiLine": "true"})
    rows = read_records(spark, path).select("first", parsed.alias("row"))
    named = F.lit(True)
    for f in schema:
        named = named & F.coalesce(F.col(f"row.{f.name}") == f.name, F.lit(False))
    header = F.when(F.col("first"), F.when(named, F.lit(True)).otherwise(F.raise_error(F.lit("the CSV header does not conform to the schema")).cast("boolean")))
    return rows.where(~F.coalesce(header, F.lit(False))).select("row.*")
