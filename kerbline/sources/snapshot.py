"""Tables handed from job to job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline import constants as C
from kerbline.schema import TOP_HOTSPOTS
from kerbline.session import use_utc

BLANKS = " \t\n\r\x0b\x0c"


def write_scored(df: DataFrame, path: str, by_month: bool = False) -> None:
    """The 23-column snapshot; ``by_month`` lets month filters skip files."""
    writer = df.select(*C.SCORED_COLUMNS).write.mode("overwrite")
    (writer.partitionBy("month") if by_month else writer).parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(path).select(*C.SCORED_COLUMNS)


BUCKETS = 256  # a few times the cores a report should use; the same for writing and reading a folder


def write_bucketed(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The 23-column snapshot laid out by junction: every file holds one bucket, sorted by junction.

    Reports per junction read it with ``read_bucketed`` and need no shuffle of
    tickets. ``No Junction`` is one name like others; it fills its bucket's file.
    """
    name = f"snapshot_{uuid.uuid4().hex}"
    rows = df.select(*C.SCORED_COLUMNS).repartition(buckets, "junction_name")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "junction_name").sortBy("junction_name").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external


def read_bucketed(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """A snapshot written by ``write_bucketed``, known to Spark as bucketed by junction."""
    use_utc(spark)
    name = f"snapshot_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (junction_name) SORTED BY (junction_name) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name).select(*C.SCORED_COLUMNS)


def write_top(df: DataFrame, path: str) -> None:
    """The top list as CSV, with the position that later numbers the feed."""
    df.select("position", "junction_name", "violations", "cis", "recommendation").write.mode("overwrite").option(
        "header", True).csv(path)


def read_top(spark: SparkSession, path: str, positioned: bool = True) -> DataFrame:
    """A top list from CSV: trimmed texts, whole violations, double score.

    A list without a position column takes positions from the order of its
    lines; such a list is a hand-kept file of a few rows, read as one split.
    """
    wanted = TOP_HOTSPOTS.fieldNames() if positioned else TOP_HOTSPOTS.fieldNames()[1:]
    text = ", ".join(f"{name} STRING" for name in wanted)
    raw = spark.read.schema(text).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    if not positioned:
        raw = raw.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)
    return raw.select(
        F.col("position").cast("int").alias("position"),
        F.btrim("junction_name", F.lit(BLANKS)).alias("junction_name"),
        F.coalesce(F.col("violations").cast("long"), F.lit(0)).alias("violations"),
        F.coalesce(F.col("cis").cast("double"), F.lit(0.0)).alias("cis"),
        F.btrim("recommendation", F.lit(BLANKS)).alias("recommendation"),
    )


def write_hotspots(df: DataFrame, path: str) -> None:
    """Nested hotspot records as JSON lines in rank order."""
    df.orderBy("id").write.mode("overwrite").json(path)


def read_hotspots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records written by ``write_hotspots``, with the nested columns of ``schema``; nothing is inferred."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def to_json_rows(df: DataFrame, order: str = "id") -> DataFrame:
    """One JSON text per record, the body of the hotspot feed."""
    return df.orderBy(order).select(F.to_json(F.struct("*")).alias("value"))
