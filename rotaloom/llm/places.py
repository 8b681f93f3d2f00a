"""Addresses of one place written in different ways: expansion, hashing, equi-join, number check."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.llm.components import components
from rotaloom.llm.setsim import best_match
from rotaloom.llm.spelling import osa, typos, unaccented, unread
from rotaloom.session import cut_lineage

#: Kinds of street, and how each is shortened.
STREET_KINDS = {
    "gatan": ["g", "gat", "gata"], "vagen": ["v", "vag"], "stigen": ["st", "stig"], "torget": ["t", "torg", "tg"],
    "liden": ["l", "lid"], "leden": ["l", "led"], "backen": ["b", "back"], "kroken": ["k", "kr", "krok"],
    "grand": ["gr"], "allen": ["a", "all", "alle"], "platsen": ["pl", "plats"],
    "street": ["str"], "road": ["rd"], "avenue": ["ave", "av"], "lane": ["ln"], "drive": ["dr"], "square": ["sq"], "terrace": ["ter"], "crescent": ["cres"],
    "strasse": ["str", "stra\u00dfe"], "weg": [], "platz": ["pl"],
}

_ASIDE = re.compile(r"^\s*(?:c/o\b|lgh\b|lägenhet\b|vån(?:ing)?\b|port\b|uppgång\b|\d+\s*tr\b|gårdshus|box\b).*$", re.I)
_ASIDE_IN = re.compile(r"\bc/o\s+[^\W\d_]+|\b(?:lgh|våning|vån|port|uppgång)\.?\s*\w+|\b\d+\s*tr\b\.?|\bgårdshuset\b", re.I)
_POST = re.compile(r"\b(?:s(?:e)?[- ]*)?(\d{3})\s?(\d{2})\b", re.I)
_NUMBER = re.compile(r"\b(?:nr\.?\s*)?(\d{1,4})\s?([a-zA-Z])?\b(?!\s*tr\b)", re.I)


def letters(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", unaccented(unread(text)).lower())


@lru_cache(200_000)
def street_forms(text: str) -> frozenset[str]:
    """All plausible plain forms ``stem|kind`` of a street name, with short kinds written out."""
    flat = letters(text)
    if len(re.sub(r"\d", "", flat)) < 3:
        return frozenset()
    out = {f"{flat[: -len(k)]}|{k}" for k in STREET_KINDS if flat.endswith(k) and len(flat) > len(k) + 1}
    if not out:
        out = {f"{flat[: -len(s)]}|{k}" for k, shorts in STREET_KINDS.items() for s in shorts if flat.endswith(s) and len(flat) > len(s) + 3}
        # a kind with a typo
        near = {f"{flat[:-n]}|{k}" for k in STREET_KINDS for n in (len(k) - 1, len(k), len(k) + 1) if len(flat) > n + 3 and osa(flat[-n:], k, 1) <= 1}
        out = near or out
    return frozenset(out or {f"{flat}|"})


def house_number(text: str | None) -> str:
    m = _NUMBER.search(text or "")
    return (m[1].lstrip("0") + (m[2] or "")).upper() if m and m[1].strip("0") else ""


@lru_cache(100_000)
def parse_address(text: str) -> tuple[str, str, str, str]:
    """Street, house number, postal code and town of an address in one line, blank where missing."""
    street = number = post = town = ""
    loose = []
    for part in " ".join(text.split()).split(","):
        part = _ASIDE_IN.sub(" ", part).strip()
        if not part or _ASIDE.match(part) or not re.search(r"\w", part):
            continue
        if m := _POST.search(part):
            post = post or m[1] + m[2]
            before, after = part[: m.start()].strip(), part[m.end() :].strip()
            town = town or after
            part = before
            if not part:
                continue
        fixed = re.sub(r"(?<=[^\W\d_])[01](?=[^\W\d_]|\b)|(?<!\w)[01](?=[^\W\d_]{2})", "l", part)  # read errors aren't numbers
        if m := _NUMBER.search(fixed):
            number = number or house_number(m[0])
            before, after = part[: m.start()].strip(), part[m.end() :].strip()
            if before:
                street, town = street or before, town or after
            else:
                street = street or after
        else:
            loose.append(part)
    for part in loose:
        if not street and number == "" or not street:
            words = part.split(" ")
            if len(words) > 1 and any(letters(words[0]).endswith(k) for k in STREET_KINDS):
                street, town = words[0], town or " ".join(words[1:])
            else:
                street = part
        else:
            town = town or part
    return street, number, post, town


def place(address, location, street, number, post, area, city) -> tuple[list[str], str, list[str]]:
    """Street forms, house number and localities (towns and postal codes) of one entry."""
    clean = lambda v: v if isinstance(v, str) and re.search(r"\w", v) else ""
    address, location, street, number, post, area, city = map(clean, (address, location, street, number, post, area, city))
    a_street, a_number, a_post, a_town = parse_address(address) if address else ("", "", "", "")
    streets = set()
    for s in (street, a_street):
        if s:
            streets |= street_forms(s)
    code = _POST.search(post)
    at = {f"z{c}" for c in ((code[1] + code[2]) if code else "", a_post) if c}
    towns = {letters(t) for t in (city, area, a_town) if len(letters(t)) > 1}
    at |= {f"t{t}" for t in towns}
    said = letters(location)
    if not at and said or len(said) > 4 and any(len(t) > 4 and typos(said, t, 2) <= 2 for t in towns):
        at.add(f"t{said}")  # the town itself, spelled a second time
    return sorted(streets), house_number(number) or a_number, sorted(at)


@F.pandas_udf(T.StructType([T.StructField("streets", T.ArrayType(T.StringType())), T.StructField("number", T.StringType()), T.StructField("at", T.ArrayType(T.StringType()))]))
def _place(address: pd.Series, location: pd.Series, street: pd.Series, number: pd.Series, post: pd.Series, area: pd.Series, city: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([place(*r) for r in zip(address, location, street, number, post, area, city)], columns=["streets", "number", "at"])


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([typos(x[1:], y[1:], 1) <= 1 for x, y in zip(a, b)], dtype=bool)


def _cuts(text: Column) -> Column:
    """``text`` whole and with any one letter left out."""
    return F.array_union(F.array(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))))


def _right_towns(parsed: DataFrame) -> DataFrame:
    """The most frequent spelling (``_near``) one edit from a town (``_t``), if it is as frequent as the town itself.

    Towns of fewer than five letters have none, nor has a town with two postal codes or more of which
    the other town has none: these are two towns.
    """
    each = parsed.select(F.explode("at").alias("_t"), F.filter("at", lambda t: t.startswith("z")).alias("_z")).where("_t like 't_____%'")
    towns = each.select("_t", F.explode_outer("_z").alias("_z")).groupBy("_t", "_z").agg(F.count("*").alias("_n")).groupBy("_t").agg(F.sum("_n").alias("_n"), F.collect_set("_z").alias("_z"))
    towns = cut_lineage(towns)
    cut = towns.select("_t", "_n", "_z", F.explode(_cuts(F.col("_t"))).alias("_c"))
    pairs = cut.join(cut.select(F.col("_t").alias("_near"), F.col("_n").alias("_m"), F.col("_z").alias("_y"), "_c"), "_c")
    pairs = pairs.where((F.col("_t") != F.col("_near")) & (F.col("_n") <= F.col("_m")) & ((F.size("_z") < 2) | F.arrays_overlap("_z", "_y")))
    return best_match(pairs.select("_t", "_near", "_m").distinct().where(_one_edit("_t", "_near")), ["_t"], "_m", "_near").select("_t", "_near")


def place_classes(entries: DataFrame) -> DataFrame:
    """The place of each entry: entries at the same street, house number and town.

    ``entries``: ``entry_id`` (number), ``address``, ``location`` and, from a second reading of the same
    place, ``street``, ``street_number``, ``postal_code``, ``postal_area``, ``city``; any may be null.
    Result: ``entry_id``, ``place`` (a number, the same for entries at one place). Repeated rows count
    once; entries without a street, a house number, or both town and postal code, have no row, nor have
    null ids.

    Both readings are expanded into all plausible street forms (short kinds of street written out,
    accents, letter case, spaces and read errors removed) and localities (towns, postal codes; the
    location, which may name the municipality, only where there is nothing else or where it is one of
    the towns but for two edits). A town with a typo also counts as the most frequent spelling one edit
    away, found by joining the distinct towns with any one letter left out. Flats, floors,
    entrances and c/o are taken out. Entries with equal expansions form one variant. Hashes of street
    stem (whole and with any one letter left out, so that a typo on either side still meets), kind of
    street, house number and locality are equi-joined: as the house number is part of every hash,
    conflicting numbers never meet. Variants that share a hash are one place (components).
    """
    fields = ["address", "location", "street", "street_number", "postal_code", "postal_area", "city"]
    rows = entries.where(F.col("entry_id").isNotNull()).select("entry_id", *fields).dropDuplicates(["entry_id"])
    parsed = rows.select("entry_id", _place(*fields).alias("_p")).select("entry_id", "_p.*").where((F.col("number") != "") & (F.size("streets") > 0) & (F.size("at") > 0))
    parsed = cut_lineage(parsed.withColumn("variant", F.xxhash64("streets", "number", "at")))
    variants = parsed.dropDuplicates(["variant"]).select("variant", "number", "streets", F.explode("at").alias("_t")).join(_right_towns(parsed), "_t", "left")
    variants = variants.select("variant", "number", F.explode("streets").alias("_s"), F.array_compact(F.array("_t", "_near")).alias("at"))
    stem, kind = F.split_part("_s", F.lit("|"), F.lit(1)), F.split_part("_s", F.lit("|"), F.lit(2))
    forms = variants.select("variant", "number", "at", stem.alias("_stem"), kind.alias("_kind")).withColumn("_f", F.explode(_cuts(F.col("_stem"))))
    keys = forms.select("variant", F.explode(F.transform("at", lambda t: F.xxhash64(F.col("_f"), F.col("_kind"), F.col("number"), t))).alias("_k")).distinct()
    least = keys.groupBy("_k").agg(F.min("variant").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    links = keys.join(least, "_k").where("variant != _least").select(F.col("variant").alias("a"), F.col("_least").alias("b")).distinct()
    roots = components(links).withColumnRenamed("node", "variant")
    return parsed.select("entry_id", "variant").join(roots, "variant", "left").select("entry_id", F.coalesce("root", "variant").alias("place"))


def place_links(entries: DataFrame, hot: int = 1000) -> DataFrame:
    """Pairs of entries at the same street, house number and town: ``entry_id_a`` < ``entry_id_b``, distinct.

    ``entries`` and what has no pairs: as for ``place_classes``, which finds the places. Pairs are only
    written out here; places of more than ``hot`` entries are spread over several tasks.
    """
    placed = place_classes(entries).withColumnRenamed("place", "_at")
    sizes = placed.groupBy("_at").agg(F.ceil(F.count("*") / hot).cast("int").alias("_parts"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    placed = placed.join(sizes, "_at")
    left = placed.select("_at", F.col("entry_id").alias("entry_id_a"), F.pmod(F.xxhash64("entry_id"), F.col("_parts")).cast("int").alias("_part"))
    right = placed.select("_at", F.col("entry_id").alias("entry_id_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, ["_at", "_part"]).where("entry_id_a < entry_id_b").select("entry_id_a", "entry_id_b")
