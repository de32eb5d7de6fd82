"""Small literal tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline import constants as C
from kerbline.schema import CORRIDOR, PATROL_UNIT


def corridors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.CORRIDORS), CORRIDOR)


def patrol_units(spark: SparkSession) -> DataFrame:
    """Officers, then tow units."""
    officers = spark.createDataFrame([u for u in C.PATROL_UNITS if u[3] == "officer"], PATROL_UNIT)
    tows = spark.createDataFrame([u for u in C.PATROL_UNITS if u[3] == "tow"], PATROL_UNIT)
    return officers.unionByName(tows)


def vehicle_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.VEHICLE_WEIGHTS.items()), "vehicle_type string, weight double")


def violation_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.VIOLATION_WEIGHTS.items()), "violation string, weight double")
