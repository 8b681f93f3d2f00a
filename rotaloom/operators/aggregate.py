"""Overlapping observations of one session merged into one list of shifts."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.functions.identity import KEY_NOISE, SHIFT_FIELDS, customer_key, location_key
from rotaloom.functions.timeofday import squeeze

#: Ranks of kinds of shift, and screen words that don't belong to an address.
KIND_RANK = {"UNKNOWN": 0, "BREAK": 1, "TRAVEL": 2, "MEETING": 3, "ADMIN": 4, "LEAVE": 5, "TRAINING": 6, "UNAVAILABLE": 7, "WORK": 8}
SCREEN_WORDS = ["schedule", "helphub", "account", "collaborators", "profile"]
ADDRESS = ["street", "street_number", "postal_code", "postal_area", "city"]
DAY = 1440


def address_quality(x: Column) -> Column:
    """How complete and clean an address is: points for each part, less for screen words and stray signs."""
    part = lambda f: F.trim(F.coalesce(x[f], F.lit("")))
    given = lambda f, points: F.when(part(f) != "", points).otherwise(0)
    text = F.lower(F.regexp_replace(F.concat_ws(" ", *(F.nullif(x[f], F.lit("")) for f in ADDRESS)), r"\s+", " "))
    points = given("street", 40 + F.least(F.length(part("street")), F.lit(40))) + given("street_number", 12) + given("postal_code", 10) + given("postal_area", 8) + given("city", 12 + F.least(F.length(part("city")), F.lit(20)))
    for word in SCREEN_WORDS:
        points = points - F.when(text.rlike(rf"\b{word}\b"), 80).otherwise(0)
    return points - F.when(text.rlike(r"[?+]"), 15).otherwise(0)


def merge_equal_times(shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Shifts of equal time, customer, kind and label (whatever its case) merged across places.

    ``shifts``: the keys, ``shift``, ``source_count``, ``seq`` (order of input). As times and kind are
    part of the group, merging is the best value of each attribute: the longest name and label, the best
    address (quality, then length, then the first), and the sum of counts; keys are then made anew.
    """
    x = F.col("shift")
    by = {"_s": x["start"], "_e": x["end"], "_c": x["customer_fingerprint"], "_k": x["shift_type"], "_l": F.lower(x["raw_type_label"])}
    rows = shifts.select(*keys, "shift", "source_count", "seq", *(c.alias(n) for n, c in by.items()))
    first = -F.col("seq")
    text = lambda f: F.struct(F.length(F.trim(x[f])), F.lower(x[f]), first)
    length = F.length(F.concat_ws(" ", *(F.nullif(x[f], F.lit("")) for f in ADDRESS)))
    merged = rows.groupBy(*keys, *by).agg(
        F.max_by(x["customer_name"], text("customer_name")).alias("_name"), F.max_by(x["raw_type_label"], text("raw_type_label")).alias("_label"),
        F.max_by(F.struct(*(x[f].alias(f) for f in ADDRESS)), F.struct(address_quality(x), length, first)).alias("_at"),
        F.sum("source_count").cast("int").alias("source_count"), F.count("*").alias("_n"), F.min_by("shift", "seq").alias("_own"),
    )
    at = F.col("_at")
    anchor = F.coalesce(F.nullif(F.trim("_name"), F.lit("")), F.nullif(F.trim("_label"), F.lit("")), F.col("_k"))
    values = {"start": F.col("_s"), "end": F.col("_e"), "customer_name": F.col("_name"), "customer_fingerprint": customer_key(anchor), **{f: at[f] for f in ADDRESS}, "location_fingerprint": location_key(at["street"], at["street_number"], at["postal_area"], at["city"]), "shift_type": F.col("_k"), "raw_type_label": F.col("_label")}
    return merged.select(*keys, F.when(F.col("_n") == 1, F.col("_own")).otherwise(F.struct(*(values[f].alias(f) for f in SHIFT_FIELDS))).alias("shift"), "source_count")


def leading_kind(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The kind of shift that stands for all of a key: any but UNKNOWN, by rank, then by code point; nulls last."""
    kind = F.col("shift_type")
    table = F.create_map(*(F.lit(x) for pair in KIND_RANK.items() for x in pair))
    order = F.struct(kind.isNull(), F.coalesce(kind, F.lit("")) == "UNKNOWN", -F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit(0)), kind)
    return rows.groupBy(*keys).agg(F.min_by("shift_type", order).alias("shift_type"))


def collected_notes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct notes of each key, with single spaces, in order of code points; blank and null ones are left out."""
    notes = F.filter(F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: squeeze(n)), lambda n: n.isNotNull() & (n != ""))
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(notes)))).alias("notes"))


# The clusters of one place depend on each other in order, so they are formed in Python, one place at a time.


def _plain(text: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", " ".join((text or "").split())) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^A-Za-z0-9\s'-]", " ", flat).split()).lower()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _customer(text: str) -> str:
    every = _plain(text).split()
    words = [w for w in every if w not in KEY_NOISE] or every
    if not words:
        return _sha("")
    head = max(words, key=len)
    return _sha(head + "|" + "".join(sorted(w[0] for w in words if w != head)))


def _location(x: dict) -> str:
    fold = lambda t: re.sub("[^a-z0-9]", "", _plain(t).translate(str.maketrans("01i|", "olll")))
    return _sha("|".join(fold(t) for t in (x["street"], x["street_number"], x["postal_area"] or x["city"])))


def _quality(x: dict) -> tuple[int, int]:
    part = {f: (x[f] or "").strip() for f in ADDRESS}
    text = " ".join(x[f] for f in ADDRESS if x[f])
    low = " ".join(text.lower().split())
    points = (40 + min(len(part["street"]), 40)) * bool(part["street"]) + 12 * bool(part["street_number"]) + 10 * bool(part["postal_code"]) + 8 * bool(part["postal_area"]) + (12 + min(len(part["city"]), 20)) * bool(part["city"])
    points -= 80 * sum(bool(re.search(rf"\b{w}\b", low)) for w in SCREEN_WORDS) + 15 * bool(re.search(r"[?+]", low))
    return points, len(text)


class _Group:
    """A shift in the making: its merged fields, its start and length in minutes, and its observations."""

    def __init__(self, x: dict):
        self.x, self.count = x, 1
        self.start = _minutes(x["start"])
        self.length = (_minutes(x["end"]) - self.start) % DAY

    @property
    def end(self) -> int:
        return (self.start + self.length) % DAY

    def apart(self, other: _Group) -> int:
        return sum(min(d, DAY - d) for d in (abs(self.start - other.start), abs(self.end - other.end)))

    def holds(self, other: _Group) -> bool:
        if self.length < other.length or (other.start - self.start) % DAY > self.length:
            return False
        return other.length == 0 or (other.end - self.start) % DAY <= self.length

    def add(self, other: _Group) -> None:
        a, b = self.x, other.x
        shift = min((-DAY, 0, DAY), key=lambda t: (abs(other.start + t - self.start), t))
        lo = min(self.start, other.start + shift)
        hi = max(self.start + self.length, other.start + shift + other.length)
        self.start, self.length = lo % DAY, (hi - lo) % DAY
        best = b if _quality(b) > _quality(a) else a
        longer = lambda f: max(a, b, key=lambda x: (len((x[f] or "").strip()), (x[f] or "").casefold()))[f]
        kinds = sorted({a["shift_type"], b["shift_type"]}, key=lambda k: (k == "UNKNOWN", -KIND_RANK.get(k, 0), k))
        merged = {"start": _clock(lo), "end": _clock(hi), "customer_name": longer("customer_name"), "shift_type": kinds[0], "raw_type_label": longer("raw_type_label"), **{f: best[f] for f in ADDRESS}}
        merged["customer_fingerprint"] = _customer(merged["customer_name"].strip() or merged["raw_type_label"].strip() or merged["shift_type"])
        merged["location_fingerprint"] = _location(merged)
        self.x, self.count = merged, self.count + other.count


def _minutes(text: str) -> int:
    return int(text[:2]) * 60 + int(text[3:])


def _clock(minutes: int) -> str:
    return f"{minutes % DAY // 60:02}:{minutes % 60:02}"


def cluster_place(rows: list[dict], tolerance: int) -> list[_Group]:
    """Observations of one place, in order of time, each joined to the nearest group that fits it: times
    within the tolerance, or the same customer with one range inside the other."""
    ordered = sorted((_Group(r) for r in rows), key=lambda g: (g.start, g.end, g.x["customer_fingerprint"], g.x["image_index"], g.x["shift_index"]))
    groups: list[_Group] = []
    for g in ordered:
        fit = []
        for i, have in enumerate(groups):
            d = have.apart(g)
            if d <= tolerance or (have.x["customer_fingerprint"] == g.x["customer_fingerprint"] and (have.holds(g) or g.holds(have))):
                fit.append((d, d > tolerance, have.start, have.end, have.x["customer_fingerprint"], i))
        if fit:
            groups[min(fit)[-1]].add(g)
        else:
            groups.append(g)
    return groups


def aggregate_sessions(observations: DataFrame, tolerance: int = 5) -> DataFrame:
    """The shifts of each session, merged from all its images: session_id, shift, source_count.

    ``observations``: session_id, image_index, shift_index, shift (struct of twelve strings, times as
    HH:MM). Rows without two times are left out; null fields are blank. First observations of one
    session and place are clustered, then equal ones merged across places. A place's observations are
    handled by one task, spread by session and place; a session is bounded by its screenshots.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    flat = observations.select("session_id", "image_index", "shift_index", *(F.coalesce(F.col(f"shift.{f}"), F.lit("")).alias(f) for f in SHIFT_FIELDS))
    flat = flat.where(F.col("start").rlike(r"^\d\d:\d\d$") & F.col("end").rlike(r"^\d\d:\d\d$"))
    strings = [T.StructField(f, T.StringType()) for f in SHIFT_FIELDS]
    schema = T.StructType([T.StructField("session_id", flat.schema["session_id"].dataType), *strings, T.StructField("source_count", T.IntegerType()), T.StructField("place", T.StringType()), T.StructField("at", T.IntegerType())])
    places = flat.groupBy("session_id", F.col("location_fingerprint").alias("place")).agg(F.collect_list(F.struct("image_index", "shift_index", *SHIFT_FIELDS)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # many places at once: one frame for each place would cost more than its clustering
            made = [(s, *(g.x[f] for f in SHIFT_FIELDS), g.count, p, i) for s, p, rows in zip(batch.session_id, batch.place, batch.rows) for i, g in enumerate(cluster_place(list(rows), tolerance))]
            yield pd.DataFrame(made, columns=schema.names)

    merged = places.mapInPandas(run, schema)
    # input order of the second step: by place, then by first appearance
    listed = merged.select("session_id", F.struct(*SHIFT_FIELDS).alias("shift"), "source_count", F.col("place"), F.col("at"))
    seq = F.row_number().over(_by_session())
    return merge_equal_times(listed.withColumn("seq", seq).drop("place", "at"), ["session_id"])


def _by_session():
    from pyspark.sql import Window

    return Window.partitionBy("session_id").orderBy("place", "at")
