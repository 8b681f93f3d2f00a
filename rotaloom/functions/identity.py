"""Stable keys of places, customers and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotaloom.functions.text import strip_accents
from rotaloom.functions.timeofday import squeeze

#: Words left out of customer keys.
KEY_NOISE = ["ab", "hb", "stadservice", "stadtjanst", "stadning"]
#: The twelve fields of a shift, in the order of its struct.
SHIFT_FIELDS = ["start", "end", "customer_name", "customer_fingerprint", "street", "street_number", "postal_code", "postal_area", "city", "location_fingerprint", "shift_type", "raw_type_label"]


def readable(value: Column) -> Column:
    """ASCII letters, digits, hyphens and apostrophes of ``value``, spaces for all else; null is blank."""
    return squeeze(F.regexp_replace(strip_accents(squeeze(F.coalesce(value, F.lit("")))), r"[^A-Za-z0-9\s'-]", " "))


def key_part(value: Column) -> Column:
    """A part of a place key: letters and digits that are read for one another made equal."""
    return F.regexp_replace(F.translate(F.lower(readable(value)), "01i|", "olll"), "[^a-z0-9]", "")


def location_key(street: Column, number: Column, area: Column, city: Column) -> Column:
    """SHA-256 of the key parts of street, number, and area or else city."""
    place = F.when(F.coalesce(area, F.lit("")) != "", area).otherwise(city)
    return F.sha2(F.concat_ws("|", key_part(street), key_part(number), key_part(place)), 256)


def customer_key(name: Column) -> Column:
    """SHA-256 of the longest word (the first of those) and the sorted initials of the others.

    Company words don't count unless there is nothing else; a blank name has the key of the empty text.
    """
    words = F.filter(F.split(F.lower(readable(name)), " "), lambda w: w != "")
    own = F.filter(words, lambda w: ~w.isin(KEY_NOISE))

    def source(used: Column) -> Column:
        longest = F.array_max(F.transform(used, lambda w: F.length(w)))
        surname = F.get(F.filter(used, lambda w: F.length(w) == longest), F.lit(0))
        initials = F.array_sort(F.transform(F.filter(used, lambda w: w != surname), lambda w: F.substring(w, 1, 1)))
        return F.coalesce(F.concat(surname, F.lit("|"), F.array_join(initials, "")), F.lit(""))

    chosen = F.transform(F.array(F.when(F.size(own) > 0, own).otherwise(words)), source)[0]
    return F.sha2(chosen, 256)


def canonical_json(value: Column, fields: list[str] = SHIFT_FIELDS) -> Column:
    """JSON of a struct with sorted keys, nulls kept, and no spaces; the text ``null`` for null."""
    ordered = F.struct(*(value[f].alias(f) for f in sorted(fields)))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.to_json(ordered, {"ignoreNullFields": "false"}))


def value_hash(value: Column, fields: list[str] = SHIFT_FIELDS) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(value, fields), 256)


def lock_key(*parts: Column) -> Column:
    """A signed 64-bit number for a group: the first eight bytes of the SHA-256 of its parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16), 16, -10).cast("bigint")
