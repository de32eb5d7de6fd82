"""Bands, labels, texts and simple metrics derived from a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import constants as C
from kerbline.functions.rounding import round_js, round_np, round_one


def normalized_cis(raw: Column) -> Column:
    """Mean score on a 0 to 10 scale, one decimal."""
    return F.least(F.lit(10.0), round_np(raw * C.CIS_SCALE, 1))


def _pick(value: Column, cuts: tuple[tuple[float, str], ...], otherwise: str) -> Column:
    rule = F.when(value >= cuts[0][0], cuts[0][1])
    for cut, text in cuts[1:]:
        rule = rule.when(value >= cut, text)
    return rule.otherwise(otherwise)


def action(normalized: Column) -> Column:
    return _pick(normalized, ((8.0, "Tow Immediately"), (5.0, "Deploy Officers")), "Routine Patrol")


def action_from_raw(mean: Column) -> Column:
    """Action of the top list: cuts on the unrounded mean score."""
    return _pick(mean, ((3.0, "Tow Immediately"), (2.0, "Deploy Officers")), "Routine Patrol")


def status(normalized: Column) -> Column:
    return _pick(normalized, ((8.0, "critical"), (5.0, "active")), "neutral")


def priority_tier(mean: Column) -> Column:
    return _pick(mean, ((4.0, "CRITICAL"), (2.5, "HIGH")), "MEDIUM")


def map_severity(mean: Column) -> Column:
    return F.when(mean < 2.0, "low").when(mean < 4.0, "mid").otherwise("high")


def map_size(count: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(6), (count / F.lit(50)).cast("int")))


def capacity_band(loss: Column) -> Column:
    return _pick(loss, ((40.0, "critical"), (30.0, "high"), (20.0, "moderate")), "healthy")


def capacity_size(loss: Column) -> Column:
    return loss / 3.0 + 12.0


def urgency_band(normalized: Column) -> Column:
    """Legend band; its cuts differ from ``status``."""
    return _pick(normalized, ((9.0, "critical"), (7.0, "active")), "low")


def reason(normalized: Column) -> Column:
    return _pick(normalized, C.REASONS, C.OTHER_REASON)


def speed_band(speed: Column) -> Column:
    """Legend band of a speed in km/h."""
    return (
        F.when(speed < 12, "Critical").when(speed < 20, "Severe").when(speed < 30, "Heavy")
        .when(speed <= 40, "Moderate").otherwise("Free Flow")
    )


def congestion_level(colour: Column) -> Column:
    return (
        F.when(colour == "dark-red", "Critical").when(colour == "red", "Severe")
        .when(colour == "orange", "Heavy").when(colour == "yellow", "Moderate").otherwise("Free Flow")
    )


def expected_improvement(normalized: Column) -> Column:
    return F.least(F.lit(50.0), round_np(normalized * 5.0, 1))


def affected_vehicles(count: Column, days: int = C.REPORT_DAYS) -> Column:
    return (count / F.lit(days) * C.VEHICLES_PER_TICKET).cast("long")


def average_delay(raw: Column) -> Column:
    return round_np(raw * 2.0, 1)


def capacity_loss(normalized: Column, exact: bool = False) -> Column:
    """Percent of capacity lost. ``exact`` rounds like the feed, else like the batch export."""
    rounded = round_one(normalized * 4.5) if exact else round_np(normalized * 4.5, 1)
    return F.least(F.lit(95.0), rounded)


def compliance_factor(rate: float) -> float:
    """Share of the cost left at a compliance rate in percent."""
    return (100 - rate) / 100.0


def realized_recovery(improvement: Column, rate: float) -> Column:
    return round_js(improvement * (rate / 100.0))


def lakhs(amount: Column) -> Column:
    return amount / 1e5


def tonnes(kilograms: Column) -> Column:
    return kilograms / 1e3


def clean_vehicle(name: Column) -> Column:
    """Display name of a vehicle type; applied after counting."""
    short = F.replace(name, F.lit("MOTOR CYCLE"), F.lit("MOTORCYCLE"))
    return F.replace(short, F.lit("PRIVATE BUS"), F.lit("BUS"))


def share_percent(part: Column, whole: Column) -> Column:
    return part / whole * 100.0


def share_text(name: Column, percent: Column, digits: int = 0) -> Column:
    """``NAME (45%)`` or ``NAME (45.1%)``; rounded first, halves to even."""
    rounded = F.rint(percent) if digits == 0 else round_one(percent)
    return F.format_string(f"%s (%.{digits}f%%)", name, rounded)


def hour_text(hour: Column) -> Column:
    return F.format_string("%02d:00", hour)


def peak_text(hour: Column, count: Column) -> Column:
    return F.format_string("%02d:00 (%d violations)", hour, count)


def two_vehicle_text(mix: Column) -> Column:
    """First two vehicles of a mix with whole percents, JavaScript rounding."""
    return F.array_join(
        F.transform(F.slice(mix, 1, 2), lambda v: F.format_string("%s (%d%%)", v["name"], round_js(v["percentage"]))),
        ", ",
    )


def audit_sentence(tier: Column, violation: Column, percent: Column, vehicle: Column) -> Column:
    return F.format_string(C.AUDIT_SENTENCE, tier, violation, round_one(percent), vehicle)
