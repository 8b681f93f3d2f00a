"""Differences between two states of days, with the pairs of shifts behind each event, and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.clock import to_minutes
from rotaloom.functions.identity import value_hash
from rotaloom.functions.text import once
from rotaloom.operators.versions import first_of

#: What makes two events of the log the same.
DEDUPE = ["user_id", "schedule_date", "location_fingerprint", "event_type", "old_value_hash", "new_value_hash"]


def _refs(shifts: str) -> Column:
    """The shifts of an array that aren't null, in their order of comparison (``k``), which ends with their place."""
    def ref(x: Column, i: Column) -> Column:
        k = F.struct(
            x["location_fingerprint"].alias("loc"), x["customer_fingerprint"].alias("cust"), x["start"].alias("s"), x["end"].alias("e"),
            F.lower(x["customer_name"]).alias("name"), F.lower(x["street"]).alias("street"), F.lower(x["street_number"]).alias("number"), F.lower(x["city"]).alias("city"), i.alias("seq"),
        )
        return F.struct(k.alias("k"), x.alias("x"))

    return F.array_sort(F.filter(F.transform(shifts, ref), lambda r: r["x"].isNotNull()))


def _nearest(old: Column, new: Column) -> Column:
    """One-to-one pairs (``o``, ``n``) of equal identity, the nearest times first: one fold over the sorted offers."""
    def offers(o: Column) -> Column:
        gap = lambda n: F.abs(to_minutes(o["k"]["s"]) - to_minutes(n["k"]["s"])) + F.abs(to_minutes(o["k"]["e"]) - to_minutes(n["k"]["e"]))
        same = F.filter(new, lambda n: (n["k"]["loc"] == o["k"]["loc"]) & (n["k"]["cust"] == o["k"]["cust"]))
        return F.transform(same, lambda n: F.struct(F.coalesce(gap(n), F.lit(1 << 30)).alias("gap"), o["k"].alias("ok"), n["k"].alias("nk"), o["x"].alias("o"), n["x"].alias("n")))

    every = F.array_sort(F.flatten(F.transform(old, offers)))
    taken = lambda acc, p: F.exists(acc, lambda t: (t["ok"]["seq"] == p["ok"]["seq"]) | (t["nk"]["seq"] == p["nk"]["seq"]))
    return F.aggregate(every, F.slice(every, 1, 0), lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.array_append(acc, p)))


def _without(refs: str, pairs: str, side: str) -> Column:
    return F.filter(refs, lambda r: ~F.exists(pairs, lambda p: p[side]["seq"] == r["k"]["seq"]))


def _indexed(old: str, new: str, *fields: str) -> Column:
    """Pairs of equal ``fields``, first with first, second with second."""
    same = lambda a, b: F.forall(F.array(*(a["k"][f] == b["k"][f] for f in fields)), lambda t: F.coalesce(t, F.lit(False)))
    place = lambda refs, r, i: F.size(F.filter(F.slice(refs, 1, i), lambda y: same(y, r)))

    def mates(o: Column, i: Column) -> Column:
        fit = F.filter(new, lambda n: same(n, o))
        return F.transform(F.slice(fit, place(F.col(old), o, i) + 1, 1), lambda n: F.struct(*(o["k"][f].alias(f) for f in fields), o["k"].alias("ok"), n["k"].alias("nk"), o["x"].alias("o"), n["x"].alias("n")))

    return F.array_sort(F.flatten(F.transform(old, mates)))


def diff_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """Events between ``old_shifts`` and ``new_shifts`` (arrays of shift structs) of each row of ``days``.

    ``keys`` are kept with each event. Result: the keys, event_type, old_value, new_value,
    location_fingerprint, customer_fingerprint (of the new value, else the old), event_seq (1, 2, ...: by
    stage, then key, then pair). Null arrays and elements count as nothing. Stage 1 pairs equal location
    and customer by nearest times: differing times, else name, else type make the event. Stage 2 pairs
    what is left by customer and times (relocated), stage 3 by location and times (retitled); the rest is
    removed or added. Each row is compared by itself, so there is no exchange.
    """
    given = lambda side: F.coalesce(side, F.array().cast(days.schema[side].dataType)).alias(side)
    base = once(days.select(*keys, given("old_shifts"), given("new_shifts")), _o=_refs("old_shifts"), _n=_refs("new_shifts")).drop("old_shifts", "new_shifts")
    base = once(base, _p1=_nearest(F.col("_o"), F.col("_n")))
    base = once(base, _o2=_without("_o", "_p1", "ok"), _n2=_without("_n", "_p1", "nk"))
    base = once(base, _p2=_indexed("_o2", "_n2", "cust", "s", "e"))
    base = once(base, _o3=_without("_o2", "_p2", "ok"), _n3=_without("_n2", "_p2", "nk"))
    base = once(base, _p3=_indexed("_o3", "_n3", "loc", "s", "e"))
    base = once(base, _o4=_without("_o3", "_p3", "ok"), _n4=_without("_n3", "_p3", "nk"))

    def changed(p: Column) -> Column:
        o, n = p["o"], p["n"]
        return (
            F.when((o["start"] != n["start"]) | (o["end"] != n["end"]), "shift_time_changed")
            .when(~o["customer_name"].eqNullSafe(n["customer_name"]), "shift_retitled")
            .when(~o["shift_type"].eqNullSafe(n["shift_type"]), "shift_reclassified")
        )

    event = lambda kind, o, n: F.struct(kind.alias("event_type"), o.alias("old_value"), n.alias("new_value"))
    by_key = F.array_sort(F.transform("_p1", lambda p, i: F.struct(p["ok"]["loc"].alias("loc"), p["ok"]["cust"].alias("cust"), i.alias("i"), p.alias("p"))))
    first = F.filter(F.transform(by_key, lambda q: event(changed(q["p"]), q["p"]["o"], q["p"]["n"])), lambda e: e["event_type"].isNotNull())
    paired = lambda pairs, kind: F.transform(pairs, lambda p: event(F.lit(kind), p["o"], p["n"]))
    none = F.get(F.col("_o.x"), F.lit(-1))  # a null shift
    gone = F.transform("_o4", lambda r: event(F.lit("shift_removed"), r["x"], none))
    come = F.transform("_n4", lambda r: event(F.lit("shift_added"), none, r["x"]))
    events = F.concat(first, paired("_p2", "shift_relocated"), paired("_p3", "shift_retitled"), gone, come)
    value = F.coalesce("_e.new_value", "_e.old_value")
    found = base.select(*keys, F.posexplode(events).alias("_at", "_e"))
    return found.select(*keys, "_e.*", value["location_fingerprint"].alias("location_fingerprint"), value["customer_fingerprint"].alias("customer_fingerprint"), (F.col("_at") + 1).alias("event_seq"))


def diff_history(snapshots: DataFrame) -> DataFrame:
    """Events between consecutive snapshots of each user's day, from the empty state on.

    A snapshot replaces the one before, so the state before it is simply the neighbour: a lag, no loop.
    """
    rows = snapshots.where("snapshot_payload is not null").dropDuplicates(["snapshot_id"])
    w = Window.partitionBy("user_id", "schedule_date").orderBy("updated_at", "snapshot_id")
    about = ["snapshot_id", "user_id", "schedule_date", "source_session_id", "detected_at"]
    days = rows.withColumn("detected_at", F.col("updated_at")).select(*about, F.col("snapshot_payload").alias("new_shifts"), F.lag("snapshot_payload").over(w).alias("old_shifts"))
    days = days.where(~F.col("new_shifts").eqNullSafe(F.col("old_shifts")))
    events = diff_days(days, about)
    return events.withColumns({"old_value_hash": value_hash(F.col("old_value")), "new_value_hash": value_hash(F.col("new_value"))})


def event_log(events: DataFrame) -> DataFrame:
    """The log that keeps the first of equal events (session and time don't count), with ids from the key."""
    kept = first_of(events, DEDUPE, ["detected_at", "event_seq", "source_session_id"])
    return kept.withColumn("event_id", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in DEDUPE)), 256))


def replay(events: DataFrame, order: list[str]) -> DataFrame:
    """The state that events lead to: for each shift of a day the last event on it, if that left a value.

    ``events``: user_id, schedule_date, old_value, new_value and ``order``. Result: user_id, schedule_date,
    shift. Every event writes its new value and clears its old one; the last write decides.
    """
    shift = lambda v: F.struct(v["location_fingerprint"].alias("l"), v["customer_fingerprint"].alias("c"), v["start"].alias("s"), v["end"].alias("e"))
    o, n = F.col("old_value"), F.col("new_value")
    writes = F.array(F.struct(F.when(o.isNotNull(), shift(o)).alias("k"), F.lit(0).alias("step"), F.lit(None).cast(events.schema["new_value"].dataType).alias("v")), F.struct(F.when(n.isNotNull(), shift(n)).alias("k"), F.lit(1).alias("step"), n.alias("v")))
    each = events.select("user_id", "schedule_date", *order, F.inline(writes)).where("k is not null")
    last = each.groupBy("user_id", "schedule_date", "k").agg(F.max_by("v", F.struct(*order, "step")).alias("shift"))
    return last.where("shift is not null").select("user_id", "schedule_date", "shift")
