"""Arithmetic on the 24-hour clock, in minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440


def to_minutes(value: Column) -> Column:
    """Minutes of an ``HH:MM`` text."""
    return F.split_part(value, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(value, F.lit(":"), F.lit(2)).try_cast("int")


def to_clock(minutes: Column) -> Column:
    """``HH:MM`` of any number of minutes, modulo a day."""
    m = F.pmod(minutes, F.lit(DAY))
    return F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def clock_distance(a: Column, b: Column) -> Column:
    """The shorter way between two times."""
    gap = F.abs(a - b)
    return F.least(gap, DAY - gap)


def onward(start: Column, point: Column) -> Column:
    """Minutes from ``start`` forward to ``point``."""
    return F.pmod(point - start, F.lit(DAY))


def covers(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether the first range, which may pass midnight, contains the second."""
    length, other = onward(a_start, a_end), onward(b_start, b_end)
    inside = (onward(a_start, b_start) <= length) & ((other == 0) | (onward(a_start, b_end) <= length))
    return (length >= other) & inside


def nearest_turn(value: Column, anchor: Column) -> Column:
    """``value`` a day earlier, as it is, or a day later: the nearest to ``anchor``, the smaller of equals."""
    turns = F.array(value - DAY, value, value + DAY)
    return F.array_min(F.transform(turns, lambda v: F.struct(F.abs(v - anchor).alias("d"), v.alias("v"))))["v"]
