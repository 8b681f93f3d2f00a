"""Times of day in free notation, as minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optional "kl", an hour, then minutes behind a separator (seconds may follow) or glued to the hour.
TIME_PATTERN = r"^(?:kl(?:ockan)?\.?\s*)?(?:(\d{1,2})\s*[:.,h ]\s*(\d{2})(?:\s*[:.]\s*\d{2})?|(\d{1,2})(\d{2}))(?:\s*(?:h|hrs|uhr))?$"


def squeeze(value: Column) -> Column:
    """Runs of any Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)[\s​﻿]+", " "))


def minutes_of_day(value: Column) -> Column:
    """Minutes since midnight (0 to 1440), or null if ``value`` is no time of day.

    Understood: ``09:05 9.05 09 05 0905 09:05:00 kl 9.05``, with any white space around. An hour
    without minutes, words and out-of-range values give null; ``24:00`` is 1440.
    """
    text = F.lower(squeeze(F.translate(value, "０１２３４５６７８９：．", "0123456789:.")))
    marked = F.regexp_replace(text, TIME_PATTERN, "@$1$3$2$4")  # hour and minutes as one number; unmatched text has no mark
    number = F.try_element_at(F.split(marked, "@"), F.lit(2)).try_cast("int")
    # a lambda, so that the number is computed once
    return F.transform(F.array(number), lambda v: F.when((v % 100 < 60) & (v <= 2400), (v - 40 * F.floor(v / 100)).cast("int")))[0]
