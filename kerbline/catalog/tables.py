"""Violation tickets and corridors derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions import scoring
from kerbline.session import use_utc
from kerbline.sources import dimensions

VEHICLES = (*C.VEHICLE_WEIGHTS, "SCHOOL VEHICLE")
VIOLATIONS = (*C.VIOLATION_WEIGHTS, "FANCY NUMBER PLATE")
PLACES = ("Indiranagar Metro Station", "KR Market", "100ft Main Road", "5th Cross", "HSR Layout", "MG Street")


def _entry(index: Column, names: tuple[str, ...]) -> Column:
    """names[index], null beyond the end."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def tickets(spark: SparkSession, sf_dir: str, per_user: bool = False) -> DataFrame:
    """Raw tickets: integer arithmetic on the whole ``events`` table.

    ``per_user`` adds the user to the junction name, which gives many more
    junctions with widely spread scores.
    """
    use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    j = u % 13
    first = _entry(e % 11, VIOLATIONS)
    second = _entry((e + 3) % 11, VIOLATIONS)
    kind = k % 8
    text = (
        F.when(e % 97 == 0, F.lit(None))
        .when(kind <= 3, F.concat(F.lit('["'), first, F.lit('"]')))
        .when(kind <= 5, F.concat(F.lit('["'), first, F.lit('","'), second, F.lit('"]')))
        .when(kind == 6, first)
        .otherwise("[]")
    )
    junction = (
        F.when(j == 0, F.lit(None)).when(j == 1, C.NO_JUNCTION)
        .when(j <= 9, F.concat(F.lit("BTP00"), j.cast("string"), F.lit(" - Junction")))
        .otherwise(F.concat(F.lit("Circle "), j.cast("string")))
    )
    if per_user:
        junction = F.when(j >= 2, F.concat(junction, F.lit(" #"), u.cast("string"))).otherwise(junction)
    status = F.when(k % 4 <= 1, "approved").when(k % 4 == 2, "rejected")
    outlier = F.when(e % 53 == 0, 5000 + (37 * e) % 1000 * 100).otherwise(0)
    return events.select(
        e.alias("id"),
        F.col("ts").cast("timestamp").alias("created_datetime"),
        _entry((e + u) % 15, VEHICLES).alias("vehicle_type"),
        text.alias("violation_type"),
        F.when(e % 101 != 0, _entry(u % 6, PLACES)).alias("location"),
        junction.alias("junction_name"),
        F.when(u % 9 != 0, F.concat(F.lit("Station "), (u % 9).cast("string"))).alias("police_station"),
        status.alias("validation_status"),
        ((129000 + j * 100 + (e % 7 - 3) * 2 + outlier) / 10000).alias("latitude"),
        ((775000 + j * 100 + (F.floor(e / 7) % 7 - 3) * 2) / 10000).alias("longitude"),
    )


def scored(spark: SparkSession, sf_dir: str, per_user: bool = False) -> DataFrame:
    """Scored tickets with the default approval probability."""
    rows = scoring.score(tickets(spark, sf_dir, per_user))
    return rows.withColumn("approval_probability", F.lit(C.DEFAULT_APPROVAL))


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets as a file would hold them: times in six spellings, odd violation texts, some coordinates unreadable."""
    rows = tickets(spark, sf_dir)
    e, ts = F.col("id"), F.col("created_datetime")
    first, second = _entry(e % 11, VIOLATIONS), _entry((e + 3) % 11, VIOLATIONS)
    times = (
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")),
        F.date_format(ts, "M/d/yyyy H:mm"), F.date_format(ts, "yyyy-MM-dd hh:mm:ss a"),
        F.date_format(ts, "MMM d, yyyy HH:mm:ss"), F.concat(F.lit("on "), F.date_format(ts, "yyyy-MM-dd")))
    lists = (
        F.concat(F.lit('["'), first, F.lit('", "'), second, F.lit('"]')), F.concat(F.lit('{"type": "'), first, F.lit('"}')),
        F.concat(F.lit('["'), first, F.lit('"] extra')), F.concat(F.lit('["'), first, F.lit(' \\"x\\""]')),
        F.concat(F.lit('  ["'), first, F.lit('"]  ')), F.concat(first, F.lit(", "), second))

    def chosen(values):
        return F.get(F.array(*values), (e % 6).cast("int"))

    return rows.select(
        F.concat(F.lit("T"), e.cast("string")).alias("id"), chosen(times).alias("created_datetime"), "vehicle_type",
        chosen(lists).alias("violation_type"), "location", "junction_name", "police_station", "validation_status",
        F.when(e % 11 == 0, "12,9").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.when(e % 13 == 0, "east").otherwise(F.col("longitude").cast("string")).alias("longitude"))


def with_probability(df: DataFrame) -> DataFrame:
    """Approval probabilities from the id: one tenth each unknown, 0.5, 0.6999 and 0.7."""
    e = F.col("id") % 10
    return df.withColumn("approval_probability", F.when(e == 0, F.lit(None)).when(e == 1, 0.5).when(e == 2, 0.6999).when(
        e == 3, 0.7).otherwise((75 + e) / 100))


def odd_coordinates(df: DataFrame) -> DataFrame:
    """Some coordinates NaN, missing or infinite."""
    e = F.col("id") % 20
    return df.withColumns({
        "latitude": F.when(e == 0, F.lit(float("nan"))).when(e == 1, F.lit(None)).when(e == 2, F.lit(float("inf"))).otherwise(F.col("latitude")),
        "longitude": F.when(e == 3, F.lit(float("nan"))).when(e == 4, F.lit(float("-inf"))).otherwise(F.col("longitude")),
    })


def street_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored tickets on 40 streets, at one crowded place, near street ends and scattered; sites grow with the rows."""
    rows = scored(spark, sf_dir)
    e = F.col("id")
    street = e % 40
    along, side = (e * 7919) % 2000 * 10, (e % 5) * 20
    kind = e % 9
    lat = F.when(kind <= 4, 12_800_000 + street * 10_000 + side).when(kind <= 6, 12_950_000 + e % 13 * 10).when(
        kind == 7, 12_801_400 + street * 10_000 + e % 3 * 50).otherwise(12_700_000 + (e * 104_729) % 500_000)
    lng = F.when(kind <= 4, 77_400_000 + along).when(kind <= 6, 77_600_000 + F.floor(e / 13) % 13 * 10).when(
        kind == 7, 77_400_000 + (e * 31) % 2000 * 10).otherwise(77_300_000 + (e * 15_485_863) % 500_000)
    return rows.withColumns({"latitude": lat / 1_000_000, "longitude": lng / 1_000_000})


def published(top: DataFrame) -> DataFrame:
    """A top list as people edit it: every seventh name blank, others unknown, some recommendations empty."""
    p = F.col("position")
    return top.withColumns({
        "junction_name": F.when(p % 7 == 3, "").when(p % 7 == 5, F.concat("junction_name", F.lit(" (old)"))).otherwise(F.col("junction_name")),
        "recommendation": F.when(p % 5 == 0, "").when(p % 5 == 1, F.lit(None)).otherwise(F.col("recommendation")),
    })


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped corridors and one corridor per row of ``supplier``."""
    s = F.col("s_suppkey")
    lat = (12900 + s * 37 % 500) / 1000
    lng = (77500 + s * 13 % 130) / 1000
    path = F.array(*[
        F.struct((lat + 0.003 * i).alias("lat"), (lng + 0.002 * i).alias("lng")) for i in range(3)])
    derived = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("S"), s.cast("string")).alias("id"),
        F.concat(F.lit("Road "), s.cast("string")).alias("name"),
        path.alias("path"),
        (s * 7 % 60 + 3).cast("int").alias("speed"),
        (s * 11 % 40 + 45).cast("int").alias("free_flow_speed"),
        _entry(s % 5, ("dark-red", "red", "orange", "yellow", "green")).alias("congestion"),
        (s * 10 % 1500).cast("int").alias("affected_vehicles"),
        (s * 3 % 90 / 10).alias("estimated_delay"),
        (s % 3 != 0).alias("parking_suspected"),
    )
    return dimensions.corridors(spark).unionByName(derived)
