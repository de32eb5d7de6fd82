"""Row scoring: time parts, weights, congestion score and its costs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline import constants as C


def clean(df: DataFrame) -> DataFrame:
    """Defaults for the four category columns."""
    return df.na.fill(C.NULL_DEFAULTS)


def with_time_parts(df: DataFrame) -> DataFrame:
    """UTC hour, day of week (Monday = 0) and month."""
    at = F.col("created_datetime")
    return df.withColumns({"hour": F.hour(at), "day_of_week": F.weekday(at), "month": F.month(at)})


def tenths(weight: float) -> int:
    return round(weight * 10)


def weight_tenths(key: Column, weights: Mapping[str, float]) -> Column:
    """Exact, case-sensitive lookup in whole tenths; unmapped and null give 1.0."""
    pairs = [F.lit(x) for name, w in weights.items() for x in (name, tenths(w))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(tenths(C.DEFAULT_WEIGHT)))


# A list of plain quoted texts without escapes, split without a JSON parser.
_SIMPLE_LIST = r'^\["[^"\\\x00-\x1f]*"(?:,"[^"\\\x00-\x1f]*")*\]\z'


def violation_list(text: Column) -> Column:
    """Violations of one ticket: null -> [], a JSON list -> its items, other text -> [text].

    Most texts are plain words or simple lists and need no parser. For the rest:
    the JSON parser ignores anything after the first complete value. When the
    only ``]`` is the last visible character nothing can follow the list;
    otherwise the text must also parse inside a list and inside an object,
    which no trailing text survives.
    """
    nothing = F.array().cast("array<string>")
    simple = F.split(F.substr(text, F.lit(3), F.length(text) - 4), '","')
    alone = F.locate("]", text) == F.length(F.regexp_replace(text, r"[ \t\r\n]+\z", ""))
    in_list = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<string>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    complete = alone | ((F.size(in_list) == 1) & in_object.isNotNull())
    parsed = F.when(complete, F.try_variant_get(F.try_parse_json(text), "$", "array<string>"))
    return (
        F.when(text.isNull() | (text == "[]"), nothing)
        .when(~text.rlike(r"^[ \t\r\n]*\["), F.array(text))
        .when(text.rlike(_SIMPLE_LIST), simple)
        .otherwise(F.coalesce(parsed, F.array(text)))
    )


def primary_violation(violations: Column) -> Column:
    """First listed violation, UNKNOWN for an empty list."""
    return F.coalesce(F.get(violations, F.lit(0)), F.lit(C.UNKNOWN))


def severity_tenths(violations: Column) -> Column:
    """Largest violation weight of the list, 1.0 when it is empty.

    Weights are tried from the largest down; an unmapped item counts as 1.0, so
    the smaller weights are left for lists made of such items alone.
    """
    names: dict[int, list[str]] = {}
    for name, weight in C.VIOLATION_WEIGHTS.items():
        names.setdefault(tenths(weight), []).append(name)
    default = tenths(C.DEFAULT_WEIGHT)
    light = [name for weight, group in names.items() if weight < default for name in group]
    others = F.size(F.array_except(violations, F.array(*[F.lit(n) for n in light]))) > 0

    def holds(group: list[str]) -> Column:
        found = F.array_contains(violations, group[0])
        for name in group[1:]:
            found = found | F.array_contains(violations, name)
        return found

    levels = sorted(names, reverse=True)
    rule = None
    for weight in [w for w in levels if w > default]:
        rule = F.when(holds(names[weight]), weight) if rule is None else rule.when(holds(names[weight]), weight)
    rule = rule.when((F.size(violations) == 0) | others, default)
    for weight in [w for w in levels if w < default]:
        rule = rule.when(holds(names[weight]), weight)
    return rule.otherwise(default)


def road_tenths(location: Column, junction: Column) -> Column:
    """Road class weight from the junction name, then the address text."""
    place = F.lower(location)
    rule = F.when(F.contains(F.lower(junction), F.lit(C.JUNCTION_MARK)), tenths(C.JUNCTION_WEIGHT))
    for words, weight in C.ROAD_CLASSES:
        found = F.contains(place, F.lit(words[0]))
        for word in words[1:]:
            found = found | F.contains(place, F.lit(word))
        rule = rule.when(found, tenths(weight))
    return rule.otherwise(tenths(C.OTHER_ROAD_WEIGHT))


def with_weights(df: DataFrame) -> DataFrame:
    """The three weights, the exact score in thousandths and the primary violation.

    The list goes through a one-row explode: a later filter on the score is then
    evaluated on the parsed list instead of repeating the parse per use.
    """
    listed = df.withColumn("violations", F.explode(F.array(violation_list(F.col("violation_type")))))
    weighed = listed.withColumns({
        "_size": weight_tenths(F.col("vehicle_type"), C.VEHICLE_WEIGHTS),
        "_type": severity_tenths(F.col("violations")),
        "_road": road_tenths(F.col("location"), F.col("junction_name")),
    })
    return weighed.withColumns({
        "w_size": F.col("_size") / 10.0,
        "w_type": F.col("_type") / 10.0,
        "w_road": F.col("_road") / 10.0,
        "cis_milli": F.col("_size").cast("long") * F.col("_type") * F.col("_road"),
        "primary_violation": primary_violation(F.col("violations")),
    }).drop("_size", "_type", "_road")


def with_costs(df: DataFrame) -> DataFrame:
    """Score and the four costs that are fixed multiples of it."""
    scored = df.withColumn("cis", F.col("cis_milli") / 1000.0)
    delayed = scored.withColumn("delay_hours", F.col("cis") * C.DELAY_PER_CIS)
    fuelled = delayed.withColumns({
        "economic_loss_inr": F.col("delay_hours") * C.VALUE_OF_TIME,
        "fuel_wasted_liters": F.col("delay_hours") * C.FUEL_PER_HOUR * C.IDLE_SHARE,
    })
    return fuelled.withColumn("co2_wasted_kg", F.col("fuel_wasted_liters") * C.CO2_PER_LITRE)


def score(df: DataFrame) -> DataFrame:
    """Raw tickets to scored tickets; one projection, batch or streaming."""
    return with_costs(with_weights(with_time_parts(clean(df))))


def cis_milli() -> Column:
    """Exact thousandths of a stored score."""
    return F.rint(F.col("cis") * 1000).cast("long")


def with_milli(df: DataFrame) -> DataFrame:
    """``df`` with ``cis_milli``; a snapshot does not carry it."""
    return df if "cis_milli" in df.columns else df.withColumn("cis_milli", cis_milli())


# Totals of the costs from a summed score in thousandths: one scaling each.
def delay_total(milli: Column) -> Column:
    return milli * F.lit(25) / F.lit(1e5)


def loss_total(milli: Column) -> Column:
    return milli * F.lit(375) / F.lit(1e4)


def co2_total(milli: Column) -> Column:
    return milli * F.lit(345) / F.lit(1e6)


def daily_loss(milli: Column, days: int) -> Column:
    """Whole currency units per day, cut towards zero in exact arithmetic."""
    return _whole_div(milli * F.lit(375), 10_000 * days)


def daily_co2(milli: Column, days: int) -> Column:
    return _whole_div(milli * F.lit(345), 1_000_000 * days)


def _whole_div(value: Column, divisor: int) -> Column:
    return F.call_function("div", value, F.lit(divisor))
