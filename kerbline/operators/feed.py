"""The hotspot feed: a top list joined with junction metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import bands


def _default(name: str) -> Column:
    if name == "vehicle_mix_data":
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("percentage")) for n, p in C.FEED_DEFAULTS[name]])
    return F.lit(C.FEED_DEFAULTS[name])


def listed_only(df: DataFrame, top: DataFrame) -> DataFrame:
    """The tickets of the junctions on a top list: nothing else needs to be folded for its feed."""
    return df.join(top.select("junction_name").where(F.col("junction_name") != "").distinct(), "junction_name", "left_semi")


def hotspot_feed(top: DataFrame, metadata: DataFrame, days: int = C.REPORT_DAYS) -> DataFrame:
    """One record per named line of ``top``, with stand-in values for unknown junctions.

    ``id`` is the position in the list, so a line without a name leaves a gap.
    Score and count come from the list; daily costs of the junction are rescaled
    by the ratio of the listed score to its own mean.
    """
    listed = top.where(F.col("junction_name") != "").withColumnRenamed("junction_name", "name")
    known = metadata.withColumn("_known", F.lit(True))
    joined = listed.join(known, "name", "left")

    def meta(name: str) -> Column:
        return F.when(F.col("_known"), F.col(name)).otherwise(_default(name))

    raw, count = F.col("cis"), F.col("violations")
    base = F.when(F.col("_known"), F.coalesce("raw_cis_base", F.lit(0.0))).otherwise(_default("raw_cis_base"))
    ratio = raw / F.when(base == 0, F.lit(1.0)).otherwise(base)
    norm = F.col("norm")
    cost, carbon = meta("economic_cost_base"), meta("co2_impact_base")
    plain = count * raw * C.DELAY_PER_CIS
    hours = F.array(*[
        F.struct(
            F.lit(f"{h:02d}:00").alias("name"),
            bands.normalized_cis(
                raw * F.coalesce(F.col("trend_multipliers")[h], _default("trend_multiplier"))).alias("CIS"),
        )
        for h in C.TREND_HOURS
    ])
    return joined.withColumn("norm", bands.normalized_cis(raw)).select(
        F.col("position").alias("id"), "name", meta("jurisdiction").alias("jurisdiction"), "violations",
        raw.alias("raw_cis"), norm.alias("cis"),
        bands.status(norm).alias("status"),
        bands.action(norm).alias("action"),
        F.coalesce(F.nullif("recommendation", F.lit("")), bands.action(norm)).alias("recommendation"),
        bands.expected_improvement(norm).alias("expected_improvement"),
        *[meta(n).alias(n) for n in
          ("vehicle_mix", "vehicle_mix_data", "peak_hour", "peak_hour_val", "peak_hour_violations")],
        bands.affected_vehicles(count, days).alias("affected_vehicles"),
        bands.average_delay(raw).alias("avg_delay"),
        bands.capacity_loss(norm, exact=True).alias("capacity_loss"),
        F.when(cost != 0, cost * ratio).otherwise(plain * C.VALUE_OF_TIME / F.lit(days)).cast("long").alias("economic_cost"),
        F.when(carbon != 0, carbon * ratio).otherwise(
            plain * C.FUEL_PER_HOUR * C.IDLE_SHARE * C.CO2_PER_LITRE / F.lit(days)).cast("long").alias("co2_impact"),
        meta("lat").alias("lat"), meta("lng").alias("lng"),
        hours.alias("trend_data"),
    )
