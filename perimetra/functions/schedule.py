"""When and within what limits an authored rule applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perimetra.functions.text import num, words


def in_window(hours: Column, days: Column, hour: Column, weekday: Column) -> Column:
    """``hours`` STRUCT<start,end> may wrap midnight; ``days`` counts Monday as 0."""
    start, end = hours["start"], hours["end"]
    day_ok = F.coalesce(F.array_contains(days, weekday), F.lit(True))
    plain = (hour >= start) & (hour < end)
    wrapped = (hour >= start) | (hour < end)
    hour_ok = F.coalesce(F.when(start <= end, plain).otherwise(wrapped), F.lit(True))
    return day_ok & F.when(hours.isNull(), F.lit(True)).otherwise(hour_ok)


def local_hour(ts: Column, zone: Column) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) + F.minute(local) / 60.0


def local_weekday(ts: Column, zone: Column) -> Column:
    return F.weekday(F.from_utc_timestamp(ts, zone))


def within_limits(max_dwell: Column, min_speed: Column, dwell_s: Column, speed: Column) -> Column:
    return ~F.coalesce(dwell_s > max_dwell, F.lit(False)) & ~F.coalesce(speed < min_speed, F.lit(False))


def out_of_scope(
    label: Column,
    where: Column,
    covered: Column,
    hours: Column,
    max_dwell: Column,
    min_speed: Column,
    dwell_s: Column,
    speed: Column,
) -> Column:
    """Why a permission or restriction does not hold right now."""
    clock = words(
        F.format_string("%02.0f", F.bround(hours["start"], 0)), ":00-", F.format_string("%02.0f", F.bround(hours["end"], 0)), ":00"
    )
    return (
        F.when(~covered & hours.isNotNull(), words(label, where, " outside permitted hours ", clock))
        .when(~covered, words(label, where, " outside permitted schedule"))
        .when(
            dwell_s > max_dwell,
            words(label, where, " stationary ", num(dwell_s), " s, over the ", num(max_dwell), " s limit"),
        )
        .when(speed < min_speed, words(label, where, " not moving as expected"))
        .otherwise(words(label, where, " outside what is permitted"))
    )
