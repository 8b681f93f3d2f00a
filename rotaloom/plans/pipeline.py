"""From text boxes to pending messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaloom.functions.identity import SHIFT_FIELDS
from rotaloom.operators import aggregate, dates, diff, entries, layout, notify, store
from rotaloom.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]
STATE_ORDER = ["updated_at", "snapshot_id"]


def observed_states(boxes: DataFrame, images: DataFrame, default_year: int | None = None, merge: bool = True, parse: Step = layout.parse_layout, normalize: Step = entries.normalize_entries) -> DataFrame:
    """The state of a user's day that each session shows: snapshot_id, user_id, schedule_date, source_session_id,
    updated_at, snapshot_payload, error.

    ``boxes``: image_id, text, x, y, w, h; ``images``: image_id, session_id, sequence, user_id, created_at.
    ``parse`` and ``normalize`` may be replaced. Entries become shifts, shifts of one session are merged
    across its images (unless ``merge`` is off), in order of place, customer, times, city and name. A session
    whose images name no date, or several, has an error and no state; so has one with an entry whose time
    can't be read.
    """
    of = images.select(F.col("image_id"), "session_id", "sequence", "user_id", "created_at")
    dated = of.join(dates.image_dates(boxes, default_year), "image_id", "left").select("session_id", "image_id", "date")
    day = dates.session_dates(dated).groupBy("session_id").agg(F.max("resolved").alias("schedule_date"), F.max("error").alias("_date_error"))
    about = of.groupBy("session_id").agg(F.min("user_id").alias("user_id"), F.max("created_at").alias("updated_at")).join(day, "session_id")
    shifts = normalize(parse(boxes)).join(of.select("image_id", "session_id", "sequence"), "image_id").select("session_id", F.col("sequence").alias("image_index"), F.col("entry_seq").alias("shift_index"), "shift", "error")
    shifts = cut_lineage(shifts)  # read for states and for errors
    faults = shifts.groupBy("session_id").agg(F.min("error").alias("_entry_error"))
    good = shifts.where("error is null")
    merged = aggregate.aggregate_sessions(good).select("session_id", "shift") if merge else good.select("session_id", "shift")
    x = F.col("shift")
    order = F.struct(*(F.coalesce(x[f], F.lit("")).alias(f) for f in ("location_fingerprint", "customer_fingerprint", "start", "end", "city", "customer_name")))
    states = merged.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), F.struct(*(x[f].alias(f) for f in SHIFT_FIELDS)).alias("x")))), lambda s: s["x"]).alias("_shifts"))
    rows = about.join(states, "session_id", "left").join(faults, "session_id", "left")
    error = F.coalesce("_date_error", "_entry_error")
    empty = F.array().cast(states.schema["_shifts"].dataType)
    return rows.select(
        F.col("session_id").alias("snapshot_id"), "user_id", "schedule_date", F.col("session_id").alias("source_session_id"), "updated_at",
        F.when(error.isNull(), F.coalesce("_shifts", empty)).alias("snapshot_payload"), error.alias("error"),
    )


def pending_messages(states: DataFrame, threshold: int = 3, today: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """The messages that a history of states leads to, with ``status`` pending; ``names``: images' names by session."""
    log = cut_lineage(diff.event_log(diff.diff_history(states)))  # read for single messages and for summaries
    told = notify.build_notifications(log, threshold, today)
    told = told if names is None else notify.with_image_names(told, names)
    return told.withColumn("status", F.lit("pending"))


def store_run(root: str, states: DataFrame, threshold: int = 3) -> dict[str, int]:
    """Writes events, states and messages of ``states`` (a history) under ``root`` and returns how many rows of
    each are new. A rerun adds nothing, as events and messages have keys and states an order."""
    states = cut_lineage(states)
    events = cut_lineage(diff.event_log(diff.diff_history(states)))
    out = {"events": store.append_log(f"{root}/schedule_event", events.select(*_EVENT), diff.DEDUPE, ["detected_at", "event_id"])}
    good = states.where("snapshot_payload is not null").select("snapshot_id", "user_id", "schedule_date", "snapshot_payload", "source_session_id", "updated_at")
    out["states"] = store.write_state(f"{root}/day_snapshot", good, ["user_id", "schedule_date"], STATE_ORDER)
    log = store.read_log(states.sparkSession, f"{root}/schedule_event", events.select(*_EVENT).schema)
    messages = notify.build_notifications(log, threshold).withColumn("status", F.lit("pending"))
    out["messages"] = store.append_log(f"{root}/schedule_notification", messages, ["notification_id"], ["notification_id"])
    return out


_EVENT = ["event_id", "user_id", "schedule_date", "event_type", "location_fingerprint", "customer_fingerprint", "old_value_hash", "new_value_hash", "old_value", "new_value", "detected_at", "source_session_id"]
