"""Differences between consecutive full snapshots, by ordinals, sparse bitmaps and aligned vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.functions.timeofday import minutes_of_day, squeeze

WORD = 63  # bits used of a signed 64-bit word


def _plain(value: Column) -> Column:
    return F.coalesce(F.lower(squeeze(value)), F.lit(""))


def _time(value: Column) -> Column:
    """A time without its spelling: minutes where it is a time of day, else its plain text."""
    return F.coalesce(minutes_of_day(value).cast("string"), _plain(value))


def _element(x: Column) -> Column:
    return F.struct(
        _plain(x["location_fingerprint"]).alias("loc"), _plain(x["customer_fingerprint"]).alias("cust"),
        _time(x["start"]).alias("s"), _time(x["end"]).alias("e"), _plain(x["shift_type"]).alias("ty"),
    )


def _bit(words: Column, ordinal: Column) -> Column:
    word = F.coalesce(F.try_element_at(words, F.floor(ordinal / WORD)), F.lit(0).cast("bigint"))
    return F.call_function("shiftright", word, (ordinal % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def _ranked(xs: Column, *fields: str) -> Column:
    """Elements of ``xs`` in sorted order with ``r``, their number among those with equal ``fields``."""
    xs = F.array_sort(xs)
    return F.transform(xs, lambda x, i: F.struct(x["loc"].alias("loc"), x["cust"].alias("cust"), x["s"].alias("s"), x["e"].alias("e"), x["ty"].alias("ty"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: F.array(*(y[f] for f in fields)) == F.array(*(x[f] for f in fields)))).alias("r")))


def _paired(xs: Column, ys: Column, *fields: str) -> Column:
    return F.filter(xs, lambda x: F.exists(ys, lambda y: F.array(*(x[f].cast("string") for f in (*fields, "r"))) == F.array(*(y[f].cast("string") for f in (*fields, "r")))))


def _unpaired(xs: Column, ys: Column, *fields: str) -> Column:
    return F.filter(xs, lambda x: ~F.exists(ys, lambda y: F.array(*(x[f].cast("string") for f in (*fields, "r"))) == F.array(*(y[f].cast("string") for f in (*fields, "r")))))


def _events(xs: Column, kind: str) -> Column:
    return F.transform(xs, lambda x: F.struct(F.lit(kind).alias("event_type"), x["loc"].alias("location_fingerprint"), x["cust"].alias("customer_fingerprint")))


def _distance(x: Column, others: Column) -> Column:
    """Minutes to the nearest of ``others``; times that are no times are farthest."""
    gap = lambda y: F.abs(x["s"].try_cast("int") - y["s"].try_cast("int")) + F.abs(x["e"].try_cast("int") - y["e"].try_cast("int"))
    return F.coalesce(F.array_min(F.transform(others, gap)), F.lit(1 << 20))


def _surplus(xs: Column, ys: Column) -> Column:
    """What is left of ``xs`` when each of ``ys`` takes the nearest: the farthest |xs| - |ys|."""
    far = F.reverse(F.array_sort(F.transform(xs, lambda x: F.struct(_distance(x, ys).alias("d"), x.alias("x")))))
    return F.when(F.size(ys) == 0, xs).otherwise(F.transform(F.slice(far, 1, F.greatest(F.size(xs) - F.size(ys), F.lit(0))), lambda p: p["x"]))


def _dressed(common: Column, field: str) -> Column:
    return F.flatten(F.transform(common, lambda c: F.transform(c[field], lambda v: F.struct(c["loc"].alias("loc"), c["cust"].alias("cust"), v["s"].alias("s"), v["e"].alias("e"), v["ty"].alias("ty")))))


def _elements(snapshots: DataFrame) -> DataFrame:
    """The comparable elements of each snapshot that was delivered, once each: ``_xs``; one exchange by day."""
    snap = ["user_id", "schedule_date", "updated_at", "snapshot_id"]
    rows = snapshots.where(F.col("snapshot_payload").isNotNull()).select(*snap, F.array_distinct(F.transform(F.filter("snapshot_payload", lambda x: x.isNotNull()), _element)).alias("_xs"))
    return rows.repartition("user_id", "schedule_date").groupBy(*snap).agg(F.first("_xs").alias("_xs"))


def _numbered(each: DataFrame) -> DataFrame:
    """``each`` with ``_o``: keys numbered in order of first appearance in their day, so that later snapshots
    change no number."""
    day = ["user_id", "schedule_date"]
    seen = each.withColumn("_seen", F.min(F.struct("updated_at", "snapshot_id")).over(Window.partitionBy(*day, "loc", "cust")))
    return seen.withColumn("_o", (F.dense_rank().over(Window.partitionBy(*day).orderBy(F.col("_is").desc(), "_seen", "loc", "cust")) - 1).cast("bigint"))


def _each(rows: DataFrame) -> DataFrame:
    snap = ["user_id", "schedule_date", "updated_at", "snapshot_id"]
    return rows.select(*snap, F.explode_outer("_xs").alias("_x")).select(*snap, "_x.*", F.col("_x").isNotNull().alias("_is"))


def key_ordinals(snapshots: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The persistent number of each key of a user's day: user_id, schedule_date, loc, cust, ordinal.

    ``known`` is such a table from before: its numbers stay, and keys it lacks are numbered on from its
    greatest in order of first appearance. Write the result and give it to ``snapshot_changes``.
    """
    day, key = ["user_id", "schedule_date"], ["user_id", "schedule_date", "loc", "cust"]
    found = _numbered(_each(_elements(snapshots)).where("_is")).groupBy(*key).agg(F.min("_o").alias("ordinal"))
    if known is None:
        return found
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    fresh = found.alias("n").join(known.alias("k"), same, "left_anti")
    most = known.groupBy(*day).agg((F.max("ordinal") + 1).alias("_from"))
    joined = fresh.alias("n").join(most.alias("m"), [F.col(f"n.{k}").eqNullSafe(F.col(f"m.{k}")) for k in day], "left")
    rank = F.row_number().over(Window.partitionBy(*(F.col(f"n.{k}") for k in day)).orderBy("ordinal")) - 1
    return known.select(*key, "ordinal").unionByName(joined.select("n.user_id", "n.schedule_date", "loc", "cust", (F.coalesce("_from", F.lit(0)) + rank).cast("bigint").alias("ordinal")))


def snapshot_changes(snapshots: DataFrame, ordinals: DataFrame | None = None) -> DataFrame:
    """Every difference between a day's snapshot and the one before it.

    ``snapshots``: snapshot_id, user_id, schedule_date, snapshot_payload (array of shift structs),
    updated_at; further columns are ignored. ``ordinals``: a table of ``key_ordinals`` that holds all
    keys; without it the same numbers are found from the snapshots. Result: user_id, schedule_date,
    snapshot_id, event_type, location_fingerprint, customer_fingerprint; distinct rows.

    The elements' keys (location and customer fingerprint) have ordinals that hold for all snapshots of
    the user's day. A snapshot is a sparse bitmap of ordinals (63-bit words, zero words aren't stored)
    beside one vector of times and types for each ordinal. Word by word, new AND NOT old gives the keys
    added, old AND NOT new those removed and AND those in both, whose vectors are compared in place.
    Elements left over are paired by customer and times (relocated), then by location and times
    (retitled). Snapshots that equal the one before go no further than the comparison of states.

    Null payloads are skipped, as are null elements; an empty array is a state without shifts. Repeated
    rows and elements count once. Snapshots with equal updated_at follow in order of snapshot_id. The
    first snapshot of a day has no differences. Null fields count as blank; a null user or date is a
    group of its own. One exchange, by user and date, serves all steps; a day's elements stay bounded by
    the payload, so that no step gathers more than one day's snapshot in a row.
    """
    day, snap = ["user_id", "schedule_date"], ["user_id", "schedule_date", "updated_at", "snapshot_id"]
    each = _each(_elements(snapshots))
    if ordinals is None:
        each = _numbered(each)
    else:
        same = [F.col(f"e.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (*day, "loc", "cust")]
        each = each.alias("e").join(ordinals.alias("k"), same, "left").select("e.*", F.coalesce("ordinal", F.lit(0)).alias("_o"))
    keyed = each.groupBy(*snap, "_o", "loc", "cust", "_is").agg(F.array_sort(F.collect_set(F.struct("s", "e", "ty"))).alias("_v"))
    words = keyed.groupBy(*snap, F.floor(F.col("_o") / WORD).alias("_w")).agg(
        F.bit_or(F.when(F.col("_is"), F.expr(f"shiftleft(1L, cast(_o % {WORD} as int))"))).alias("_bits"),
        F.collect_list(F.when(F.col("_is"), F.struct(F.col("_o").alias("o"), "loc", "cust", F.col("_v").alias("v")))).alias("_cs"),
    )
    states = words.groupBy(*snap).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_bits").isNotNull(), F.struct("_w", "_bits"))))).alias("_bits"), F.array_sort(F.flatten(F.collect_list("_cs"))).alias("_cs"))
    order = Window.partitionBy(*day).orderBy("updated_at", "snapshot_id")
    pairs = states.select(*snap, F.struct("_bits", "_cs").alias("_new"), F.lag(F.struct("_bits", "_cs")).over(order).alias("_old"))
    pairs = pairs.where(F.col("_old").isNotNull() & (F.col("_new._cs") != F.col("_old._cs")))

    word = lambda use: F.map_zip_with("_new._bits", "_old._bits", lambda _, n, o: use(F.coalesce(n, F.lit(0).cast("bigint")), F.coalesce(o, F.lit(0).cast("bigint"))))
    step = pairs.select(
        *snap, F.col("_new._cs").alias("_nc"), F.col("_old._cs").alias("_oc"),
        word(lambda n, o: n.bitwiseAND(F.bitwise_not(o))).alias("_added"), word(lambda n, o: o.bitwiseAND(F.bitwise_not(n))).alias("_gone"), word(lambda n, o: n.bitwiseAND(o)).alias("_common"),
    )
    old_vectors = F.map_from_entries(F.transform(F.filter("_oc", lambda c: _bit(F.col("_common"), c["o"])), lambda c: F.struct(c["o"], c["v"])))
    step = step.select(
        *snap, old_vectors.alias("_ov"), F.filter("_nc", lambda c: _bit(F.col("_common"), c["o"])).alias("_both"),
        F.filter("_nc", lambda c: _bit(F.col("_added"), c["o"])).alias("_plus"), F.filter("_oc", lambda c: _bit(F.col("_gone"), c["o"])).alias("_minus"),
    )
    changed = F.filter(
        F.transform("_both", lambda c: F.struct(c["loc"].alias("loc"), c["cust"].alias("cust"), F.array_except(c["v"], F.col("_ov")[c["o"]]).alias("n"), F.array_except(F.col("_ov")[c["o"]], c["v"]).alias("o"))),
        lambda c: (F.size(c["n"]) > 0) | (F.size(c["o"]) > 0),
    )
    step = step.select(*snap, "_plus", "_minus", changed.alias("_changed"))
    timed = lambda xs, ys: F.filter(xs, lambda x: ~F.exists(ys, lambda y: (x["s"] == y["s"]) & (x["e"] == y["e"])))
    step = step.withColumn("_changed", F.transform("_changed", lambda c: F.struct(c["loc"].alias("loc"), c["cust"].alias("cust"), timed(c["n"], c["o"]).alias("n"), timed(c["o"], c["n"]).alias("o"), (F.size(timed(c["n"], c["o"])) < F.size(c["n"])).alias("typed"))))
    step = step.select(
        *snap, "_plus", "_minus",
        _events(F.filter("_changed", lambda c: (F.size(c["n"]) > 0) & (F.size(c["o"]) > 0)), "shift_time_changed").alias("_e1"),
        _events(F.filter("_changed", lambda c: c["typed"]), "shift_reclassified").alias("_e2"),
        F.transform("_changed", lambda c: F.struct(c["loc"].alias("loc"), c["cust"].alias("cust"), _surplus(c["n"], c["o"]).alias("n"), _surplus(c["o"], c["n"]).alias("o"))).alias("_left"),
    )
    step = step.select(*snap, "_e1", "_e2", F.concat(_dressed(F.col("_plus"), "v"), _dressed(F.col("_left"), "n")).alias("_n"), F.concat(_dressed(F.col("_minus"), "v"), _dressed(F.col("_left"), "o")).alias("_o"))
    for kind, fields in (("shift_relocated", ("cust", "s", "e")), ("shift_retitled", ("loc", "s", "e"))):
        step = step.withColumns({"_n": _ranked(F.col("_n"), *fields), "_o": _ranked(F.col("_o"), *fields)})
        n, o = F.col("_n"), F.col("_o")
        kept = [c for c in step.columns if c not in ("_n", "_o")]
        step = step.select(*kept, _events(_paired(n, o, *fields), kind).alias(f"_{kind}"), _unpaired(n, o, *fields).alias("_n2"), _unpaired(o, n, *fields).alias("_o2"))
        step = step.withColumnsRenamed({"_n2": "_n", "_o2": "_o"})
    found = F.concat("_e1", "_e2", "_shift_relocated", "_shift_retitled", _events(F.col("_n"), "shift_added"), _events(F.col("_o"), "shift_removed"))
    return step.select(*day, "snapshot_id", F.inline(F.array_distinct(found)))
