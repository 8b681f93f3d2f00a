"""Queries of payloads, written tables, orders and the way from boxes to messages, with DuckDB SQL from literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.functions import text
from rotaloom.operators import aggregate, entries, notify, sessions, store, versions
from rotaloom.plans.catalogue import _CLEAN, _FIELDS, _PAYLOAD, _PLAIN, _SPACE, NOW, _digest, _entry_boxes
from rotaloom.plans.pipeline import observed_states, pending_messages
from rotaloom.sources import payloads
from rotaloom.sources.tables import table
from rotaloom.streaming import idle

_C = F.col


def _day() -> Column:
    return F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date")


def _session_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entry").dropDuplicates(["entry_id"])
    one = F.struct("entry_id", F.struct(_C("shift_start").alias("start"), _C("shift_end").alias("end"), "title", "location", "address").alias("x"))
    return rows.groupBy("session_id", "schedule_date").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]).alias("entries"))


def normalized_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = _session_payloads(spark, d).select("session_id", _day(), F.inline(F.array(payloads.normalized_payload(_C("entries")))))
    return rows.select("session_id", "schedule_date", "error", F.posexplode_outer("entries").alias("seq", "_e")).select("session_id", "schedule_date", "error", "seq", "_e.*")


def noisy_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of payloads written carelessly; equal to those of the clean ones."""
    rows = _session_payloads(spark, d).select("session_id", _day(), F.inline(F.array(payloads.normalized_payload(_C("entries"))))).where("error is null")
    noisy = rows.withColumn("entries", F.shuffle(F.transform("entries", lambda e, i: payloads.noisy_entry(e, F.concat_ws("|", "session_id", i.cast("string"))))))
    again = noisy.select("session_id", "schedule_date", F.inline(F.array(payloads.normalized_payload(_C("entries")))))
    return again.select("session_id", "schedule_date", F.posexplode_outer("entries").alias("seq", "_e")).select("session_id", "schedule_date", "seq", "_e.*")


def payload_parts(spark: SparkSession, d: str) -> DataFrame:
    told = _session_payloads(spark, d).select("session_id", _day(), F.to_json(F.struct(_day(), "entries")).alias("json"))
    read = told.select("session_id", "schedule_date", F.inline(F.array(payloads.parsed_payload(_C("json")))))
    return payloads.payload_entries(read, ["session_id", "schedule_date"]).select("session_id", "schedule_date", "entry_seq", "start", "title", "address")


def snapshot_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "day_snapshot").dropDuplicates(["snapshot_id"])
    return rows.select("snapshot_id", payloads.snapshot_fault(_C("snapshot_payload")).alias("fault"))


def stored_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots through their JSON text and back."""
    rows = table(spark, d, "day_snapshot").dropDuplicates(["snapshot_id"]).where("snapshot_payload is not null")
    read = rows.select("snapshot_id", F.inline(F.array(payloads.read_snapshot(F.to_json("snapshot_payload")))))
    return read.select("snapshot_id", F.coalesce(F.size("shifts"), F.lit(-1)).alias("shifts"), F.col("error"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "schedule_event").dropDuplicates(["event_id"])
    return versions.in_order(rows, ["source_session_id"], ["detected_at", "event_id"]).select("source_session_id", "place", "event_id")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "schedule_event").select(_C("source_session_id").alias("session_id"))
    found = sessions.looked_up(keys, table(spark, d, "capture_session").select("session_id", "user_id", "state"), ["session_id"])
    return found.select("session_id", "user_id", "state", "error")


def failed_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "capture_session").select("session_id", "state", "error", "closed_at").distinct()
    late = (_C("state") == "open") & (_C("session_id") < "8")
    return store.guarded_update(rows, late, state=F.lit("failed"), error=text.shorten(F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.concat(F.lit("no image in "), F.repeat(_C("session_id"), 3))), 60), closed_at=F.lit(NOW).cast("timestamp")).select("session_id", "state", "error", "closed_at", "matched")


def owned_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.version_progression(_digest(spark, d), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"], _C("digest")).withColumn("session_id", _C("source_session_id"))
    first = versions.first_of(rows, ["user_id", "schedule_date", "version"], ["updated_at", "snapshot_id"])
    there = first.where(_C("updated_at") < NOW)
    return store.insert_owned(first, table(spark, d, "capture_session"), ["session_id"], _C("state") == "processed", there, ["user_id", "schedule_date", "version"]).select("snapshot_id", "version")


def versions_by_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.version_progression(_digest(spark, d), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"], _C("digest"))
    last = versions.latest(rows.select("user_id", "schedule_date", "digest", "version", "snapshot_id", "updated_at"), ["user_id", "schedule_date", "digest"], ["version", "updated_at", "snapshot_id"])
    return last.select("user_id", _day(), "version", "snapshot_id")


def version_faults(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries numbered by day, failed ones missing: the numbers that don't follow their predecessor."""
    rows = versions.in_order(table(spark, d, "day_snapshot").dropDuplicates(["snapshot_id"]), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"])
    kept = rows.where("snapshot_payload is not null").withColumnRenamed("place", "version")
    return versions.version_gaps(kept, ["user_id", "schedule_date"]).select("user_id", _day(), "version", "expected")


def upserted_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "day_snapshot").select("user_id", "schedule_date", "snapshot_id", "updated_at", F.size("snapshot_payload").alias("shifts"))
    now = store.upserted(rows.where(_C("updated_at") < NOW), rows.where(_C("updated_at") >= NOW), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"])
    return now.select("user_id", _day(), "snapshot_id")


def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "day_snapshot").dropDuplicates(["snapshot_id"])
    key = lambda x: F.struct(*(F.coalesce(x[f], F.lit("")).alias(f) for f in ("location_fingerprint", "customer_fingerprint", "start", "end", "city", "customer_name")))
    ordered = rows.select("snapshot_id", F.posexplode(F.array_sort(F.transform("snapshot_payload", key))).alias("place", "k"))
    return ordered.select("snapshot_id", "place", _C("k.start").alias("s"), _C("k.city").alias("city"), _C("k.customer_name").alias("name"))


def aggregate_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aggregated_shift").dropDuplicates(["agg_id"])
    blank = lambda c: F.coalesce(c, F.lit(""))
    keyed = rows.withColumns({f"_{i}": blank(c) for i, c in enumerate((_C("shift_start"), _C("shift_end"), _C("location_fingerprint"), _C("customer_fingerprint"), F.lower("customer_name")))})
    return versions.in_order(keyed, ["session_id"], ["_0", "_1", "_2", "_3", "_4", "agg_id"]).select("session_id", "place", "agg_id")


def collected_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aggregated_shift").select("dup_group", "notes")
    return aggregate.collected_notes(rows, ["dup_group"]).select("dup_group", F.array_join("notes", "|").alias("notes"))


def finalizable_order(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "entry").select("session_id", _C("captured_at").alias("created_at"))
    due = sessions.finalizable(table(spark, d, "capture_session"), images, F.lit(NOW).cast("timestamp"), state="processed")
    return versions.in_order(due, ["user_id"], ["last_image_at", "session_id"]).select("user_id", "place", "session_id")


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.when(_C("image_index") > 0, F.lit("//store/")).otherwise(F.lit("/")), _C("session_id"), F.lit("/"), _C("image_index"), F.lit(".png"))
    return table(spark, d, "canonical_shift").select("session_id", "image_index", sessions.object_key(raw, "/store/").alias("object_key")).distinct()


def legacy_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Entries as records of the older recogniser: polygons as wide as their text, one without enough points."""
    rows = table(spark, d, "entry").dropDuplicates(["entry_id"])
    x, y, w = (_C("entry_id") % 500).cast("double"), F.dayofyear("schedule_date").cast("double"), F.length("title").cast("double")
    record = lambda points, t: F.struct(F.array(*(F.array(a, b) for a, b in points)).alias("poly"), F.struct(t.alias("text"), F.lit(0.5).alias("score")).alias("rec"))
    pages = rows.select(_C("entry_id").alias("image_id"), F.array(record([(x, y), (x + 1, y)], _C("address")), record([(x, y), (x + w * 9, y + 1), (x + w * 9, y + 21), (x - 1, y + 20)], _C("title"))).alias("records"))
    return payloads.legacy_boxes(pages).select("image_id", "box_seq", "text", "x", "y", "w", "h")


def event_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "schedule_event").select("event_id", notify.value_key(_C("old_value")).alias("old_key"), notify.event_key().alias("event_key")).distinct()


def named_messages(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "schedule_event").select("event_id", "source_session_id", _C("event_type").alias("message")).distinct()
    key = F.concat(F.lit("/shots/"), _C("session_id"), F.lit("/"), _C("image_index"), F.lit(".png"))
    images = table(spark, d, "canonical_shift").select("session_id", _C("image_index").alias("sequence"), key.alias("object_key")).distinct()
    return notify.with_image_names(told, sessions.image_names(images)).select("event_id", "message")


def boxes_to_messages(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: boxes, entries, shifts, states, events, messages."""
    owners = table(spark, d, "capture_session").select("session_id", "user_id", "created_at").distinct()
    images = owners.select(_C("session_id").alias("image_id"), "session_id", F.lit(1).alias("sequence"), "user_id", "created_at")
    states = observed_states(_entry_boxes(spark, d), images.join(table(spark, d, "entry").where("schedule_date is not null").select(_C("session_id").alias("image_id")).distinct(), "image_id", "left_semi"), 2025)
    return pending_messages(states).select("notification_id", "user_id", _day(), "notification_type", "message", "status")


def title_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry").where("title is not null").select("entry_id", F.inline(F.array(text.split_title(_C("title"))))).distinct()


def address_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry").select("entry_id", F.inline(F.array(text.address_parts(_C("address"), _C("location"))))).distinct()


def customer_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_shift").where("customer_name is not null").select("customer_name").distinct()
    return rows.select("customer_name", text.strip_duration(_C("customer_name")).alias("bare"), text.customer_name(_C("customer_name")).alias("shown"))


def label_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_shift").where("raw_type_label is not null").select("raw_type_label").distinct()
    return rows.select("raw_type_label", entries.ruled_label(text.match_text(_C("raw_type_label"))).alias("label"))


def shift_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "aggregated_shift").select("session_id", "shift_type").distinct()
    return aggregate.leading_kind(rows, ["session_id"]).select("session_id", "shift_type")


def idle_stream(spark: SparkSession, d: str) -> DataFrame:
    """The sessions that a stream of images closes by event time, after all of the table was read."""
    images = spark.readStream.schema("session_id string, captured_at timestamp").option("pathGlobFilter", "entry.parquet").option("recursiveFileLookup", "true").parquet(d)
    return idle.run_to_end(idle.idle_sessions(images.withColumnRenamed("captured_at", "created_at")))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_payloads, noisy_payloads, payload_parts, snapshot_faults, stored_snapshots, session_events, event_sessions, failed_sessions, owned_versions, versions_by_hash, version_faults,
        upserted_snapshots, canonical_order, aggregate_order, collected_notes, finalizable_order, object_keys, legacy_boxes, event_keys, named_messages, boxes_to_messages,
        title_parts, address_fields, customer_names, label_rules, shift_kinds, idle_stream,
    )
}

_LOOSE = r"""(SELECT CASE WHEN h <> '' AND h::INT < 24 AND m::INT < 60 THEN lpad(h, 2, '0') || ':' || lpad(m, 2, '0') END FROM (SELECT regexp_extract(u, '^(\d{{1,2}})(?:\s*[:.]\s*|\s+)(\d{{1,2}})$', 1) AS h, regexp_extract(u, '^(\d{{1,2}})(?:\s*[:.]\s*|\s+)(\d{{1,2}})$', 2) AS m FROM (SELECT trim(regexp_replace({0}, '\s+', ' ', 'g')) AS u)))"""
_NORMAL = f"""
    WITH e AS (SELECT DISTINCT ON (entry_id) * FROM entry),
    n AS (SELECT session_id, schedule_date, entry_id, {_LOOSE.format('shift_start')} AS s, {_LOOSE.format('shift_end')} AS e, {_SPACE.format('title')} AS t, {_SPACE.format('location')} AS l FROM e),
    f AS (SELECT *, CASE WHEN s IS NULL THEN 'start' WHEN e IS NULL THEN 'end' WHEN coalesce(t, '') = '' THEN 'title' WHEN coalesce(l, '') = '' THEN 'location' END AS fault,
        array_to_string(list_transform(regexp_extract_all(lower(l), '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '') AS place FROM n),
    g AS (SELECT session_id, schedule_date, arg_min(fault, entry_id) FILTER (WHERE fault IS NOT NULL) AS error FROM f GROUP BY ALL),
    x AS (SELECT g.session_id, strftime(g.schedule_date, '%Y-%m-%d') AS schedule_date, g.error, row_number() OVER (PARTITION BY g.session_id, g.schedule_date ORDER BY s, e, lower(t), lower(place), entry_id) - 1 AS r, s, e, t, place
        FROM g JOIN f ON g.session_id = f.session_id AND g.schedule_date IS NOT DISTINCT FROM f.schedule_date)"""
_VERSIONED = f"""
    WITH a AS (SELECT DISTINCT snapshot_id, user_id, schedule_date, updated_at, source_session_id, {_PAYLOAD} AS h FROM day_snapshot WHERE snapshot_payload IS NOT NULL),
    b AS (SELECT *, lag(h) OVER w AS p, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id)),
    c AS (SELECT *, (sum(CASE WHEN n = 1 OR h IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id))::INT AS version FROM b)"""
_KEY = lambda v: f"CASE WHEN {v} IS NULL THEN 'null' ELSE " + " || '|' || ".join(f"'{f}:' || coalesce({v}.\"{f}\", 'None')" for f in sorted(_FIELDS)) + " END"
_NEEDED = [f for f in _FIELDS if f != "raw_type_label"]

_TITLE = lambda v: f"array_to_string(list_transform(string_split({v}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_SHORT = lambda v: f"trim(regexp_replace(regexp_replace({_SPACE.format(v)}, '(?i)(?:\\s*(?:\\b\\d+\\s*h(?:\\s*\\d+\\s*m)?\\b|\\b\\d+\\s*m(?:in)?\\b))+\\s*$', ''), '\\s+', ' ', 'g'))"
_TOWN = lambda v: f"(SELECT CASE plain WHEN 'kallered' THEN 'Kållered' WHEN 'molndal' THEN 'Mölndal' WHEN 'goteborg' THEN 'Göteborg' ELSE shown END FROM (SELECT shown, {_PLAIN.format('shown')} AS plain FROM (SELECT {_TITLE(_CLEAN.format(_SPACE.format(v)))} AS shown)))"
_JOBS = "lunch restid personalmote utbildning stadservice stadning storstadning inledande reklamation omstadning extra fonsterputs kylskapsrengoring ugnsrengoring hemstadning kontor skola nyckelhantering forberedelser disponibel avbokade avokade vard barn tjanstledig sjukdom clickandgo".split()
_WHOLE = {
    "thank you for today": "Thank You For Today", "inter tid": "Inter Tid", "personalmote": "Personalmöte", "vard av barn": "Vård Av Barn", "tjanstledig del av dag": "Tjänstledig Del Av Dag", "sjukdom dag 1-14": "Sjukdom Dag 1-14",
    "sjukdom dag 1 14": "Sjukdom Dag 1-14", "nyckelhantering": "Nyckelhantering", "forberedelser till iss": "Förberedelser Till Iss", "ej disponibel": "Ej Disponibel", "avbokade uppdrag": "Avbokade Uppdrag", "avokade uppdrag": "Avbokade Uppdrag",
}
_INSIDE = [
    ("utbildning handledarhus", "Utbildning Handledarhus"), ("forberedelser till iss", "Förberedelser Till Iss"), ("avbokade uppdrag", "Avbokade Uppdrag"), ("avokade uppdrag", "Avbokade Uppdrag"), ("tjanstledig del av dag", "Tjänstledig Del Av Dag"),
    ("sjukdom dag 1-14", "Sjukdom Dag 1-14"), ("sjukdom dag 1 14", "Sjukdom Dag 1-14"), ("ej disponibel", "Ej Disponibel"), ("extra stadtillfalle", "Extra Städtillfälle"), ("inledande storstadning", "Inledande Storstädning"), ("reklamation omstadning", "Reklamation Omstädning"),
    ("kylskapsrengoring", "Kylskåpsrengöring"), ("ugnsrengoring", "Ugnsrengöring"), ("nyckelhantering", "Nyckelhantering"), ("personalmote", "Personalmöte"), ("thank you for today", "Thank You For Today"), ("inter tid", "Inter Tid"), ("vard av barn", "Vård Av Barn"),
    ("clickandgo", "ClickAndGo"), ("storstadning", "Storstädning"), ("stadservice", "Städservice"), ("reklamation", "Reklamation"), ("fonsterputs", "Fönsterputs"), ("utbildning", "Utbildning"), ("restid", "Restid"), ("lunch", "Lunch"),
]

ORACLE = {
    "idle_stream": "SELECT session_id, count(*) AS images, date_trunc('millisecond', max(captured_at)) AS last_image_at FROM entry WHERE session_id IS NOT NULL AND captured_at IS NOT NULL GROUP BY 1 HAVING epoch_ms(max(captured_at)) + 25000 <= (SELECT epoch_ms(max(captured_at)) - 10000 FROM entry WHERE session_id IS NOT NULL)",
    "title_parts": f"""
        WITH a AS (SELECT DISTINCT entry_id, {_SPACE.format('title')} AS t FROM entry WHERE title IS NOT NULL), b AS (SELECT entry_id, t, string_split({_SHORT('t')}, ' ') AS w FROM a),
        c AS (SELECT *, coalesce(list_filter(range(2, len(w) + 1), lambda i: list_contains({_JOBS!r}, {_PLAIN.format('w[i]')}))[1], len(w) + 1) AS i FROM b)
        SELECT DISTINCT entry_id, CASE WHEN regexp_matches(t, '[•·]') THEN trim(regexp_extract(t, '^([^•·]*)[•·]', 1)) ELSE array_to_string(w[1:i - 1], ' ') END AS customer,
            CASE WHEN regexp_matches(t, '[•·]') THEN {_SHORT("regexp_extract(t, '^[^•·]*[•·](.*)$', 1)")} ELSE array_to_string(w[i:], ' ') END AS job FROM c""",
    "address_fields": f"""
        WITH a AS (SELECT DISTINCT entry_id, {_CLEAN.format(_SPACE.format("coalesce(address, '')"))} AS t, {_TOWN("coalesce(location, '')")} AS town FROM entry),
        b AS (SELECT *, regexp_matches(t, '\\b\\d{{3}}\\s?\\d{{2}}\\b') AS has FROM a),
        c AS (SELECT *, CASE WHEN has THEN regexp_extract(t, '^(.*?)\\b\\d{{3}}\\s?\\d{{2}}\\b', 1) ELSE t END AS head, CASE WHEN has THEN {_TOWN("regexp_extract(t, '^.*?\\b\\d{3}\\s?\\d{2}\\b(.*)$', 1)")} ELSE '' END AS area,
            CASE WHEN has THEN regexp_extract(t, '\\b(\\d{{3}})\\s?\\d{{2}}\\b', 1) || ' ' || regexp_extract(t, '\\b\\d{{3}}\\s?(\\d{{2}})\\b', 1) ELSE '' END AS postal_code FROM b),
        e AS (SELECT *, list_filter(string_split(trim(head), ' '), lambda w: w <> '') AS w FROM c), f AS (SELECT *, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '\\p{{Nd}}'))), 0) AS i FROM e),
        g AS (SELECT *, CASE WHEN i > 0 THEN w[i + 1:] ELSE [] END AS tail FROM f),
        h AS (SELECT *, CASE WHEN area <> '' THEN area WHEN town <> '' THEN town WHEN len(tail) >= 2 AND length(tail[-2]) > 2 THEN {_TOWN("tail[-2]")} || ' ' || {_TOWN("tail[-1]")} ELSE coalesce({_TOWN("coalesce(tail[-1], '')")}, '') END AS city FROM g)
        SELECT DISTINCT entry_id, {_TITLE("array_to_string(CASE WHEN i > 0 THEN w[1:i - 1] ELSE w END, ' ')")} AS street, CASE WHEN i > 0 THEN upper(w[i]) ELSE '' END AS street_number, postal_code, CASE WHEN postal_code <> '' AND area = '' THEN city ELSE area END AS postal_area, city FROM h""",
    "customer_names": f"""
        WITH a AS (SELECT DISTINCT customer_name, {_SHORT('customer_name')} AS bare FROM canonical_shift WHERE customer_name IS NOT NULL), b AS (SELECT *, list_filter(string_split(lower({_CLEAN.format('bare')}), ' '), lambda w: w <> '') AS w FROM a),
        c AS (SELECT *, list_filter(w, lambda x, i: NOT (len(w) >= 3 AND i > 1 AND regexp_full_match(x, '\\d{{1,2}}') AND regexp_matches(coalesce(w[i - 1], ''), '\\p{{L}}') AND regexp_matches(coalesce(w[i + 1], ''), '\\p{{L}}'))) AS k FROM b),
        e AS (SELECT *, list_filter(k, lambda x: x NOT IN ('ab', 'hb', 'stadservice', 'städservice', 'stadtjanst', 'städtjanst', 'stadning', 'städning')) AS o FROM c)
        SELECT customer_name, bare, {_TITLE("array_to_string(CASE WHEN len(o) > 0 THEN o ELSE k END, ' ')")} AS shown FROM e""",
    "label_rules": f"WITH a AS (SELECT DISTINCT raw_type_label, {_PLAIN.format(_SPACE.format('raw_type_label'))} AS m FROM canonical_shift WHERE raw_type_label IS NOT NULL) SELECT raw_type_label, CASE " + " ".join(f"WHEN m = '{k}' THEN '{v}'" for k, v in _WHOLE.items()) + " " + " ".join(f"WHEN regexp_matches(m, '\\b{k}\\b') THEN '{v}'" for k, v in _INSIDE) + " END AS label FROM a",
    "shift_kinds": """SELECT session_id, shift_type FROM (SELECT DISTINCT session_id, shift_type FROM aggregated_shift) a QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN shift_type IS NULL THEN 2 WHEN shift_type = 'UNKNOWN' THEN 1 ELSE 0 END,
        CASE shift_type WHEN 'WORK' THEN 0 WHEN 'UNAVAILABLE' THEN 1 WHEN 'TRAINING' THEN 2 WHEN 'LEAVE' THEN 3 WHEN 'ADMIN' THEN 4 WHEN 'MEETING' THEN 5 WHEN 'TRAVEL' THEN 6 WHEN 'BREAK' THEN 7 ELSE 8 END, shift_type) = 1""",
    "normalized_payloads": _NORMAL + " SELECT DISTINCT session_id, schedule_date, error, CASE WHEN error IS NULL THEN r::INT END AS seq, CASE WHEN error IS NULL THEN s END AS \"start\", CASE WHEN error IS NULL THEN e END AS \"end\", CASE WHEN error IS NULL THEN t END AS title, CASE WHEN error IS NULL THEN place END AS location FROM x",
    "noisy_payloads": _NORMAL + ' SELECT session_id, schedule_date, r::INT AS seq, s AS "start", e AS "end", t AS title, place AS location FROM x WHERE error IS NULL',
    "payload_parts": """SELECT session_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, (row_number() OVER (PARTITION BY session_id, entry.schedule_date ORDER BY entry_id) - 1)::INT AS entry_seq,
        coalesce(shift_start, '') AS "start", coalesce(title, '') AS title, coalesce(address, '') AS address FROM (SELECT DISTINCT ON (entry_id) * FROM entry) entry""",
    "snapshot_faults": "SELECT DISTINCT snapshot_id, CASE WHEN snapshot_payload IS NULL THEN 'no array' WHEN len(list_filter(snapshot_payload, lambda x: x IS NULL)) > 0 THEN 'no object' " + " ".join(f"WHEN len(list_filter(snapshot_payload, lambda x: x.\"{f}\" IS NULL)) > 0 THEN '{f}'" for f in _NEEDED) + " END AS fault FROM day_snapshot",
    "stored_snapshots": "SELECT DISTINCT snapshot_id, CASE WHEN f IS NULL THEN n ELSE -1 END AS shifts, f AS error FROM (SELECT snapshot_id, len(snapshot_payload)::INT AS n, CASE " + " ".join(f"WHEN len(list_filter(snapshot_payload, lambda x: x.\"{f}\" IS NULL)) > 0 THEN '{f}'" for f in _NEEDED) + " END AS f FROM day_snapshot WHERE snapshot_payload IS NOT NULL)",
    "session_events": "SELECT source_session_id, row_number() OVER (PARTITION BY source_session_id ORDER BY detected_at, event_id)::INT AS place, event_id FROM (SELECT DISTINCT ON (event_id) * FROM schedule_event)",
    "event_sessions": "SELECT e.session_id, s.user_id, s.state, CASE WHEN s.session_id IS NULL THEN 'not found' END AS error FROM (SELECT DISTINCT source_session_id AS session_id FROM schedule_event) e LEFT JOIN (SELECT DISTINCT session_id, user_id, state FROM capture_session) s USING (session_id)",
    "failed_sessions": f"""
        WITH a AS (SELECT DISTINCT session_id, state, error, closed_at, state = 'open' AND session_id < '8' AS m, coalesce(nullif(trim(error), ''), 'no image in ' || repeat(session_id, 3)) AS t FROM capture_session)
        SELECT session_id, CASE WHEN m THEN 'failed' ELSE state END AS state, CASE WHEN NOT m THEN error WHEN length(t) <= 60 THEN t ELSE t[:57] || '...' END AS error, CASE WHEN m THEN TIMESTAMP '{NOW}' ELSE closed_at END AS closed_at, m AS matched FROM a""",
    "owned_versions": _VERSIONED + f", d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, schedule_date, version ORDER BY updated_at, snapshot_id) = 1) SELECT snapshot_id, version FROM d WHERE updated_at >= TIMESTAMP '{NOW}' AND source_session_id IN (SELECT session_id FROM capture_session WHERE state = 'processed')",
    "versions_by_hash": _VERSIONED + " SELECT user_id, strftime(c.schedule_date, '%Y-%m-%d') AS schedule_date, version, snapshot_id FROM c QUALIFY row_number() OVER (PARTITION BY user_id, c.schedule_date, h ORDER BY version DESC, updated_at DESC, snapshot_id DESC) = 1",
    "version_faults": """
        WITH a AS (SELECT DISTINCT snapshot_id, user_id, schedule_date, updated_at, snapshot_payload IS NOT NULL AS ok FROM day_snapshot), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id)::INT AS version FROM a),
        c AS (SELECT *, (coalesce(lag(version) OVER (PARTITION BY user_id, schedule_date ORDER BY version), 0) + 1)::INT AS expected FROM b WHERE ok) SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, version, expected FROM c WHERE version <> expected""",
    "upserted_snapshots": "SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, snapshot_id FROM day_snapshot QUALIFY row_number() OVER (PARTITION BY user_id, day_snapshot.schedule_date ORDER BY updated_at DESC, snapshot_id DESC) = 1",
    "canonical_order": """
        WITH a AS (SELECT DISTINCT ON (snapshot_id) snapshot_id, snapshot_payload FROM day_snapshot), b AS (SELECT snapshot_id, unnest(snapshot_payload) AS x FROM a),
        c AS (SELECT snapshot_id, coalesce(x.location_fingerprint, '') AS l, coalesce(x.customer_fingerprint, '') AS u, coalesce(x."start", '') AS s, coalesce(x."end", '') AS e, coalesce(x.city, '') AS city, coalesce(x.customer_name, '') AS name FROM b)
        SELECT snapshot_id, (row_number() OVER (PARTITION BY snapshot_id ORDER BY l, u, s, e, city, name) - 1)::INT AS place, s, city, name FROM c""",
    "aggregate_order": """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(shift_start, ''), coalesce(shift_end, ''), coalesce(location_fingerprint, ''), coalesce(customer_fingerprint, ''), coalesce(lower(customer_name), ''), agg_id)::INT AS place, agg_id
        FROM (SELECT DISTINCT ON (agg_id) * FROM aggregated_shift)""",
    "collected_notes": r"WITH a AS (SELECT DISTINCT dup_group, regexp_replace(unnest(notes), '[\s\x{00A0}]+', ' ', 'g') AS n FROM aggregated_shift) SELECT g.dup_group, coalesce(string_agg(DISTINCT trim(n), '|' ORDER BY trim(n)) FILTER (WHERE trim(n) <> ''), '') AS notes FROM (SELECT DISTINCT dup_group FROM aggregated_shift) g LEFT JOIN a ON a.dup_group IS NOT DISTINCT FROM g.dup_group GROUP BY 1",
    "finalizable_order": f"""
        WITH a AS (SELECT DISTINCT s.user_id, s.session_id, m.t FROM capture_session s JOIN (SELECT session_id, max(captured_at) AS t FROM entry GROUP BY 1) m USING (session_id) WHERE s.state = 'processed' AND m.t <= TIMESTAMP '{NOW}' - INTERVAL 25 SECOND)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, session_id)::INT AS place, session_id FROM a""",
    "object_keys": "SELECT DISTINCT session_id, image_index, 'store/' || session_id || '/' || image_index || '.png' AS object_key FROM canonical_shift",
    "legacy_boxes": "SELECT DISTINCT entry_id AS image_id, 1 AS box_seq, title AS text, (entry_id % 500 - 1)::DOUBLE AS x, dayofyear(schedule_date)::DOUBLE AS y, (length(title) * 9 + 1)::DOUBLE AS w, 21.0::DOUBLE AS h FROM entry WHERE schedule_date IS NOT NULL AND title IS NOT NULL",
    "event_keys": f"""SELECT DISTINCT event_id, {_KEY('old_value')} AS old_key, sha256(concat_ws('|', coalesce(user_id::VARCHAR, ''), coalesce(strftime(schedule_date, '%Y-%m-%d'), ''), coalesce(source_session_id, ''), coalesce(event_type, ''), coalesce(location_fingerprint, ''), coalesce(customer_fingerprint, ''),
        {_KEY('old_value')}, {_KEY('new_value')})) AS event_key FROM schedule_event""",
    "named_messages": """
        WITH i AS (SELECT session_id, string_agg(DISTINCT image_index || '.png', ', ' ORDER BY image_index || '.png') AS names, count(DISTINCT image_index) AS n FROM canonical_shift GROUP BY 1)
        SELECT DISTINCT event_id, event_type || coalesce(CASE WHEN n = 1 THEN ' (image: ' ELSE ' (images: ' END || names || ')', '') AS message FROM schedule_event e LEFT JOIN i ON e.source_session_id = i.session_id""",
}
