"""The date a screenshot speaks of, from its texts."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.functions.text import strip_accents
from rotaloom.functions.timeofday import squeeze
from rotaloom.operators.layout import running_lines

#: Names of days and months in English and Swedish, without accents.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mandag", "tisdag", "onsdag", "torsdag", "fredag", "lordag", "sondag"]
MONTHS = {
    1: ["jan", "january", "januari"], 2: ["feb", "february", "februari"], 3: ["mar", "march", "mars"], 4: ["apr", "april"], 5: ["may", "maj"], 6: ["jun", "june", "juni"],
    7: ["jul", "july", "juli"], 8: ["aug", "august", "augusti"], 9: ["sep", "sept", "september"], 10: ["oct", "october", "okt", "oktober"], 11: ["nov", "november"], 12: ["dec", "december"],
}
_WORD = "[A-Za-zÅÄÖåäö]+"


def dates_in_text(texts: DataFrame, default_year: int | None = None) -> DataFrame:
    """All dates in ``text``: its columns, ``date``, ``has_weekday``, ``has_year``, ``date_seq``.

    Read are "weekday day month [year]" and "day month [year]". Words that are no day or month, and days
    that don't exist, give nothing; without a year and a ``default_year`` the date is null.
    """
    month = F.create_map(*(x for n, names in MONTHS.items() for name in names for x in (F.lit(name), F.lit(n))))
    fold = lambda c: F.lower(strip_accents(c))
    forms = [(rf"\b({_WORD})\s+(\d{{1,2}})\s+({_WORD})(?:\s+(\d{{4}}))?\b", 1), (rf"\b()(\d{{1,2}})\s+({_WORD})(?:\s+(\d{{4}}))?\b", 0)]
    parts = []
    for pattern, weekday in forms:
        groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in zip((1, 2, 3, 4), "wdmy")]
        kinds = F.transform(groups[0], _constant(weekday)).alias("k")
        parts.append(F.arrays_zip(kinds, *groups))
    each = texts.select(*texts.columns, F.posexplode(F.concat(*parts)).alias("date_seq", "_z"))
    number = F.try_element_at(month, fold(F.col("_z.m")))
    year = F.coalesce(F.nullif(F.col("_z.y"), F.lit("")), F.lit(default_year).cast("string"))
    found = each.where(number.isNotNull() & ((F.col("_z.k") == 0) | fold(F.col("_z.w")).isin(WEEKDAYS)))
    day = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.col("_z.d"), 2, "0")), "yyyy-MM-dd")
    out = found.select(*texts.columns, "date_seq", F.when(year.isNotNull(), day).alias("date"), (F.col("_z.k") == 1).alias("has_weekday"), (F.col("_z.y") != "").alias("has_year"), year.isNull().alias("no_year"))
    return out.where("no_year or date is not null")


def _constant(value: int):
    return lambda _: F.lit(value)


def date_texts(boxes: DataFrame) -> DataFrame:
    """Texts near the top of each image that may hold its date: single boxes and joined lines.

    ``boxes``: image_id, text, x, y, h. Result: image_id, text, y, h, from_line (1 for a line).
    """
    rows = boxes.select("image_id", squeeze(F.col("text")).alias("text"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xyh")).where("text != ''").withColumn("h", F.greatest("h", F.lit(1.0)))
    schema = T.StructType([T.StructField("image_id", rows.schema["image_id"].dataType), T.StructField("text", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("h", T.DoubleType()), T.StructField("from_line", T.IntegerType())])

    images = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text", "h"))).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, *t) for i, boxes in zip(batch.image_id, batch.boxes) for t in _top_texts(list(boxes))], columns=schema.names)

    return images.mapInPandas(run, schema)


def _top_texts(items: list[dict]) -> list[tuple[str, float, float, int]]:
    top = min(b["y"] for b in items)
    limit = top + max(400.0, 0.45 * max(1.0, max(b["y"] + b["h"] for b in items) - top))
    out = [(" ".join(b["text"] for b in sorted(g, key=lambda b: b["x"])), min(b["y"] for b in g), median(b["h"] for b in g), 1) for g in running_lines(items)]
    out += [(b["text"], b["y"], b["h"], 0) for b in items]
    return [t for t in out if t[1] <= limit]


def image_dates(boxes: DataFrame, default_year: int | None = None) -> DataFrame:
    """The best date of each image: image_id, date (null if a date has no year), error.

    Best is a date with weekday, then with year, from a line, of great height, long text, near the top.
    """
    found = dates_in_text(date_texts(boxes), default_year)
    rank = F.struct("has_weekday", "has_year", "from_line", "h", F.length("text"), -F.col("y"), -F.col("date_seq"), "text")
    best = found.groupBy("image_id").agg(F.max_by("date", rank).alias("date"), F.bool_or("no_year").alias("_n"))
    return best.select("image_id", F.when(~F.col("_n"), F.col("date")).alias("date"), F.when(F.col("_n"), "a date has no year").alias("error"))


def session_dates(images: DataFrame) -> DataFrame:
    """One date for all images of a session: ``images`` (session_id, image_id, date) with ``resolved``, ``inherited``, ``error``.

    Images without a date inherit that of the others; a session with none, or with several, has an error.
    """
    w = Window.partitionBy("session_id")
    lo, hi = F.min("date").over(w), F.max("date").over(w)
    error = F.when(lo.isNull(), "no date").when(lo != hi, "several dates")
    return images.withColumns({"_lo": lo, "error": error}).withColumns({"resolved": F.when(F.col("error").isNull(), F.col("_lo")), "inherited": F.col("date").isNull() & F.col("error").isNull()}).drop("_lo")
