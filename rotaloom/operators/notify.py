"""Events grouped into notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.identity import SHIFT_FIELDS
from rotaloom.functions.text import title_letters


#: How a kind of shift is told to its user.
KIND_TEXTS = {
    "WORK": "Work shift", "TRAVEL": "Travel", "TRAINING": "Training", "BREAK": "Break", "MEETING": "Meeting", "ADMIN": "Administrative task",
    "LEAVE": "Leave", "UNAVAILABLE": "Unavailable", "SCHOOL": "Work shift", "OFFICE": "Work shift", "HOME_VISIT": "Work shift", "UNKNOWN": "Unknown job type",
}


def kind_text(kind: Column) -> Column:
    """A kind of shift as told to its user; kinds outside the table in title case."""
    table = F.create_map(*(F.lit(x) for pair in KIND_TEXTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), title_letters(kind))


def value_key(value: Column) -> Column:
    """``field:value`` parts of a shift in order of field names; ``null`` for null, ``None`` for a null field."""
    parts = [F.concat(F.lit(f"{f}:"), F.coalesce(value[f], F.lit("None"))) for f in sorted(SHIFT_FIELDS)]
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat_ws("|", *parts))


def event_key() -> Column:
    """A key of what an event says, for events without an id."""
    parts = ["user_id", "schedule_date", "source_session_id", "event_type", "location_fingerprint", "customer_fingerprint"]
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts), value_key(F.col("old_value")), value_key(F.col("new_value"))), 256)


def day_label(day: Column, today: Column | None) -> Column:
    on = F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"))
    return on if today is None else F.when(day == today, "today").when(day == F.date_add(today, 1), "tomorrow").otherwise(on)


def message(today: Column | None = None) -> Column:
    """What one event tells its user; missing values read as dashes or a general word."""
    o, n = F.col("old_value"), F.col("new_value")
    get = lambda v, f, other: F.coalesce(v[f], F.lit(other))
    low = day_label(F.col("schedule_date"), today)
    high = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 99))
    span = lambda v: F.concat(get(v, "start", "--:--"), F.lit("–"), get(v, "end", "--:--"))
    a, b, c, d = get(o, "start", "--:--"), get(o, "end", "--:--"), get(n, "start", "--:--"), get(n, "end", "--:--")
    change = F.when((a != c) & (b == d), F.concat_ws(" → ", a, c)).when((b != d) & (a == c), F.concat(F.lit("ends "), b, F.lit(" → "), d)).otherwise(F.concat(span(o), F.lit(" → "), span(n)))
    kind = F.col("event_type")
    kinds = kind_text(F.coalesce(n["shift_type"], F.lit("UNKNOWN")))
    return (
        F.when(kind == "shift_added", F.concat(F.lit("New shift added "), low, F.lit(" "), span(n), F.lit(" in "), get(n, "city", "unknown location")))
        .when(kind == "shift_removed", F.concat(F.lit("Shift removed "), low, F.lit(" "), span(o), F.lit(" in "), get(o, "city", "unknown location")))
        .when(kind == "shift_time_changed", F.concat(high, F.lit(" "), F.coalesce(n["city"], o["city"], F.lit("shift")), F.lit(" shift moved "), change))
        .when(kind == "shift_relocated", F.concat(high, F.lit(" "), F.coalesce(n["start"], o["start"], F.lit("--:--")), F.lit(" shift moved to "), get(n, "city", "unknown location")))
        .when(kind == "shift_reclassified", F.concat(high, F.lit(" job updated to "), F.coalesce(F.nullif(n["raw_type_label"], F.lit("")), kinds)))
        .when(kind == "shift_retitled", F.concat(high, F.lit(" shift updated for "), F.coalesce(n["customer_name"], o["customer_name"], F.lit("customer"))))
        .otherwise(F.concat(high, F.lit(" schedule updated")))
    )


def build_notifications(events: DataFrame, threshold: int = 3, today: Column | None = None, seen: DataFrame | None = None) -> DataFrame:
    """One notification for each event, or one summary for a session's day of at least ``threshold`` events.

    ``events``: event_id (blank or null: a key of what the event says), user_id, schedule_date,
    event_type, fingerprints, old_value, new_value, source_session_id, detected_at; ``seen``: event_id of
    events told before. Result: notification_id, user_id, schedule_date, source_session_id,
    notification_type, message, event_ids. Equal ids count once, the first in order of start, place,
    type, session and time of detection.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    start = F.coalesce(F.coalesce("new_value", "old_value")["start"], F.lit("99:99"))
    named = events.withColumn("_id", F.coalesce("event_id", F.lit(""))).withColumn("_key", F.when(F.col("_id") == "", event_key()).otherwise(F.col("_id")))
    named = named.withColumn("_order", F.struct(F.col("user_id"), F.date_format("schedule_date", "yyyy-MM-dd").alias("d"), start.alias("s"), F.coalesce("location_fingerprint", F.lit("")).alias("l"), F.col("event_type"), F.coalesce("source_session_id", F.lit("")).alias("o"), F.coalesce(F.col("detected_at").cast("string"), F.lit("")).alias("t"), F.col("_id")))
    if seen is not None:
        named = named.join(seen.select(F.col("event_id").alias("_key")).distinct(), "_key", "left_anti")
    fresh = named.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where("_rn = 1")
    group = ["user_id", "schedule_date", "source_session_id"]
    counted = fresh.withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    text = lambda *parts: F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("schedule_date", "yyyy-MM-dd"), "source_session_id", *parts), 256)
    single = counted.where(F.col("_n") < threshold).select(text(F.col("_id")).alias("notification_id"), *group, F.lit("event").alias("notification_type"), message(today).alias("message"), F.array("_id").alias("event_ids"))
    many = counted.where(F.col("_n") >= threshold).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list("_order")), lambda x: x["_id"]).alias("event_ids"))
    told = F.concat(F.size("event_ids").cast("string"), F.lit(" shifts updated for "), day_label(F.col("schedule_date"), today))
    summary = many.select(text(F.lit("summary"), F.array_join("event_ids", "|")).alias("notification_id"), *group, F.lit("summary").alias("notification_type"), told.alias("message"), "event_ids")
    return single.unionByName(summary)


def with_image_names(notifications: DataFrame, names: DataFrame) -> DataFrame:
    """Messages with their session's image names behind them, once; ``names``: session_id, names."""
    label = F.when(F.size("names") == 1, "image").otherwise("images")
    suffix = F.concat(F.lit(" ("), label, F.lit(": "), F.array_join("names", ", "), F.lit(")"))
    joined = notifications.join(names.withColumnRenamed("session_id", "source_session_id"), "source_session_id", "left")
    shown = F.when(F.coalesce(F.size("names"), F.lit(0)) < 1, F.col("message")).when(F.col("message").endswith(suffix), F.col("message")).otherwise(F.concat("message", suffix))
    return joined.withColumn("message", shown).select(*notifications.columns)
