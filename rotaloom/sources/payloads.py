"""Readers of schedule payloads, stored objects and recognised pages, and the normal form of a payload."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.functions.identity import SHIFT_FIELDS
from rotaloom.functions.text import loose_time, title_letters
from rotaloom.functions.timeofday import squeeze
from rotaloom.operators.layout import polygon_box

ENTRY_FIELDS = ["start", "end", "title", "location", "address"]
PAYLOAD = "struct<schedule_date:string,entries:array<struct<" + ",".join(f"`{f}`:string" for f in ENTRY_FIELDS) + ">>>"
SNAPSHOT = "array<struct<" + ",".join(f"`{f}`:string" for f in SHIFT_FIELDS) + ">>"
BOX = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("box_seq", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("confidence", "x", "y", "w", "h"))])


def parsed_payload(text: Column) -> Column:
    """Struct of ``payload`` and ``error`` of a JSON text: an error says that it is missing, invalid or no object."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    error = F.when(text.isNull(), "missing").when(F.try_parse_json(text).isNull(), "invalid JSON").when(~bare.startswith("{"), "not an object")
    return F.struct(F.when(error.isNull(), F.from_json(text, PAYLOAD)).alias("payload"), error.alias("error"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Schedule payloads of JSON files, one a file: ``path``, ``payload``, ``error``; a path without files raises."""
    rows = spark.read.option("wholetext", True).text(path).select("_metadata.file_path", "value")
    return rows.select(F.col("file_path").alias("path"), F.inline(F.array(parsed_payload(F.col("value")))))


def payload_entries(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of ``payload`` with their place: the keys, ``entry_seq`` and five texts, blank where missing."""
    each = payloads.select(*keys, F.posexplode("payload.entries").alias("entry_seq", "_e"))
    return each.select(*keys, "entry_seq", *(F.coalesce(F.col(f"_e.{f}"), F.lit("")).alias(f) for f in ENTRY_FIELDS))


def normalized_entry(e: Column) -> Column:
    """An entry in its normal form: times as HH:MM, single spaces, the place in title case; ``error`` names the
    first part that is missing or no time."""
    start, end, title, place = loose_time(e["start"]), loose_time(e["end"]), squeeze(e["title"]), squeeze(e["location"])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    error = F.when(start.isNull(), "start").when(end.isNull(), "end").when(blank(title), "title").when(blank(place), "location")
    return F.struct(start.alias("start"), end.alias("end"), title.alias("title"), title_letters(place).alias("location"), error.alias("error"))


def normalized_payload(entries: Column) -> Column:
    """Struct of ``entries`` (an array in normal form and order: start, end, title, place, letter case aside)
    and ``error``, that of the first entry in the order given that has one; null entries are an error."""
    made = F.transform(entries, normalized_entry)
    keyed = F.transform(made, lambda x, i: F.struct(x["start"].alias("s"), x["end"].alias("e"), F.lower(x["title"]).alias("t"), F.lower(x["location"]).alias("l"), i.alias("i"), x.alias("x")))
    error = F.when(entries.isNull(), "entries").otherwise(F.get(F.filter(F.transform(made, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0)))
    plain = F.transform(F.array_sort(keyed), lambda k: F.struct(*(k["x"][f].alias(f) for f in ENTRY_FIELDS[:4])))
    return F.struct(F.when(error.isNull(), plain).alias("entries"), error.alias("error"))


def snapshot_fault(payload: Column) -> Column:
    """What is wrong with a stored snapshot (an array of shift structs): the first field, in order, that a shift
    lacks (the raw label may be missing), or null."""
    needed = [f for f in SHIFT_FIELDS if f != "raw_type_label"]
    lacking = lambda f: F.exists(payload, lambda x: x[f].isNull())
    lacks = F.coalesce(*(F.when(lacking(f), f) for f in needed))
    return F.when(payload.isNull(), "no array").when(F.exists(payload, lambda x: x.isNull()), "no object").otherwise(lacks)


def read_snapshot(text: Column) -> Column:
    """Struct of ``shifts`` and ``error`` of a snapshot's JSON text."""
    shifts = F.from_json(text, SNAPSHOT)
    error = F.when(F.try_parse_json(text).isNull(), "invalid JSON").when(~F.trim(text).startswith("["), "no array").otherwise(snapshot_fault(shifts))
    return F.struct(F.when(error.isNull(), shifts).alias("shifts"), error.alias("error"))


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stored objects such as images: ``object_key`` (the path), ``content``, ``length``; a path without files raises."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("object_key"), "content", "length")


def extract_boxes(images: DataFrame, make: Callable[[], Callable[[bytes], Iterable[tuple]]]) -> DataFrame:
    """Text boxes of images by a recogniser of the caller's: image_id, box_seq, text, confidence, x, y, w, h.

    ``images``: image_id, content. ``make`` is called once in each task and gives a function of an image's
    bytes that yields (text, confidence, x, y, w, h). Null contents give no boxes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for batch in batches:
            yield pd.DataFrame([(i, n, *box) for i, c in zip(batch.image_id, batch.content) if c is not None for n, box in enumerate(read(bytes(c)))], columns=BOX.names)

    return images.select(F.col("image_id").cast("string").alias("image_id"), "content").mapInPandas(run, BOX)


def legacy_boxes(pages: DataFrame) -> DataFrame:
    """Boxes of pages in the older form: image_id, box_seq, text, confidence, x, y, w, h.

    ``pages``: image_id, records (array of struct: ``poly``, ``rec`` (struct: ``text``, ``score``)). Records
    that are null or without a polygon of four points are skipped; their numbers are left out.
    """
    each = pages.select("image_id", F.posexplode("records").alias("box_seq", "_r")).where("_r is not null and _r.rec is not null")
    return each.select("image_id", "box_seq", F.col("_r.rec.text").alias("text"), F.col("_r.rec.score").alias("confidence"), polygon_box(F.col("_r.poly")).alias("_b")).where("_b is not null").select("image_id", "box_seq", "text", "confidence", "_b.*")


def noisy_entry(e: Column, seed: Column) -> Column:
    """An entry as a careless hand writes it: other notation of times, spaces, letter case. Its normal form is the same."""
    pick = lambda n, *forms: F.get(F.array(*forms), F.pmod(F.xxhash64(seed, F.lit(n)), F.lit(len(forms))).cast("int"))

    def time(t: Column, n: int) -> Column:
        h, m = F.split_part(t, F.lit(":"), F.lit(1)), F.split_part(t, F.lit(":"), F.lit(2))
        return pick(n, t, F.concat_ws(".", h, m), F.concat(h, F.lit(" : "), m), F.concat(F.lit(" "), h, F.lit(" "), m), F.concat(h.try_cast("int").cast("string"), F.lit(":"), m))

    spaced = lambda t, n: pick(n, t, F.concat(F.lit("  "), t), F.concat(t, F.lit(" ")), F.regexp_replace(t, " ", "   "))
    place = pick(5, e["location"], F.upper(e["location"]), F.lower(e["location"]))
    return F.struct(time(e["start"], 1).alias("start"), time(e["end"], 2).alias("end"), spaced(e["title"], 3).alias("title"), spaced(place, 4).alias("location"), F.lit(None).cast("string").alias("address"))
