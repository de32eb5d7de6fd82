"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

VIOLATIONS_RAW = T.StructType([
    T.StructField("id", T.StringType(), False),  # opaque: never parsed
    T.StructField("created_datetime", T.TimestampType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("violation_type", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("junction_name", T.StringType()),
    T.StructField("police_station", T.StringType()),
    T.StructField("validation_status", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

TOP_HOTSPOTS = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("junction_name", T.StringType()),
    T.StructField("violations", T.LongType()),
    T.StructField("cis", T.DoubleType()),
    T.StructField("recommendation", T.StringType()),
])

CORRIDOR = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.ArrayType(T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
    ]))),
    T.StructField("speed", T.IntegerType()),
    T.StructField("free_flow_speed", T.IntegerType()),
    T.StructField("congestion", T.StringType()),
    T.StructField("affected_vehicles", T.IntegerType()),
    T.StructField("estimated_delay", T.DoubleType()),
    T.StructField("parking_suspected", T.BooleanType()),
])

PATROL_UNIT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
])
