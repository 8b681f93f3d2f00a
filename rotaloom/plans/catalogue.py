"""Queries of the engine's own operators over the test tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaloom.functions import clock, identity, text
from rotaloom.functions.identity import SHIFT_FIELDS
from rotaloom.functions.similar_words import closest_label
from rotaloom.operators import aggregate, dates, diff, entries, layout, notify, sessions, versions
from rotaloom.sources.tables import table

NOW = "2025-06-30 12:00:00"
_C = F.col


def location_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    key = identity.location_key(_C("street"), _C("street_number"), _C("postal_area"), _C("city"))
    return table(spark, d, "canonical_shift").select("shift_id", key.alias("location_key")).distinct()


def customer_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_shift").select("shift_id", identity.customer_key(_C("customer_name")).alias("customer_key")).distinct()


def value_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "schedule_event").select("event_id", identity.value_hash(_C("old_value")).alias("old_hash"), identity.value_hash(_C("new_value")).alias("new_hash"))
    return rows.distinct()


def lock_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "day_snapshot").select("user_id", F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date")).distinct().withColumn("lock_key", identity.lock_key(_C("user_id"), _C("schedule_date")))


def clean_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry").where("title is not null").select("entry_id", text.clean_text(_C("title")).alias("clean"), text.match_text(_C("title")).alias("plain"), text.title_words(text.clean_text(_C("title"))).alias("shown")).distinct()


def shift_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_shift").select("shift_id", text.strict_time(_C("shift_start")).alias("strict"), text.loose_time(_C("shift_start")).alias("loose")).distinct()


def label_kinds(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "canonical_shift").where("raw_type_label is not null").select("raw_type_label").distinct()
    return labels.withColumn("kind", entries.kind_of(text.match_text(_C("raw_type_label"))))


def known_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "canonical_shift").where("raw_type_label is not null").select(text.match_text(_C("raw_type_label")).alias("label"))
    return closest_label(labels, "label", [p for p, _ in entries.LABELS_WITHIN]).select("label", "pattern", F.round("ratio", 6).alias("ratio"))


def clock_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_shift").select("shift_id", text.strict_time(_C("shift_start")).alias("s"), text.strict_time(_C("shift_end")).alias("e")).where("s is not null and e is not null").distinct()
    rows = rows.select("shift_id", clock.to_minutes(_C("s")).alias("s"), clock.to_minutes(_C("e")).alias("e"))
    noon, one = F.lit(720), F.lit(780)
    return rows.select("shift_id", clock.clock_distance(_C("s"), _C("e")).alias("apart"), clock.onward(_C("s"), _C("e")).alias("length"), clock.covers(_C("s"), _C("e"), noon, one).alias("over_noon"), clock.to_clock(_C("s") - 725).alias("earlier"), clock.nearest_turn(_C("e"), _C("s")).alias("turn"))


def finalizable_sessions(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "entry").select("session_id", _C("captured_at").alias("created_at"))
    return sessions.finalizable(table(spark, d, "capture_session"), images, F.lit(NOW).cast("timestamp"), state="processed")


def waiting_sessions(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "entry").select("session_id", _C("captured_at").alias("created_at"))
    return sessions.waiting(table(spark, d, "capture_session"), images, F.lit(NOW).cast("timestamp"), state="processed")


def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return sessions.claim_order(table(spark, d, "capture_session"), "open", "processing", F.lit(NOW).cast("timestamp"), 10)


def session_image_names(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("/shots/"), _C("session_id"), F.lit("/"), _C("image_index"), F.lit(".png"))
    images = table(spark, d, "canonical_shift").select("session_id", _C("image_index").alias("sequence"), sessions.object_key(key, "store").alias("object_key")).distinct()
    return sessions.image_names(images).select("session_id", F.array_join("names", ",").alias("names"))


def _digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "day_snapshot").where("snapshot_payload is not null").dropDuplicates(["snapshot_id"])
    parts = F.transform("snapshot_payload", lambda x: F.concat_ws("|", *(F.coalesce(x[f], F.lit("")) for f in SHIFT_FIELDS)))
    return rows.withColumn("digest", F.sha2(F.array_join(F.array_sort(parts), ";"), 256))


def version_progression(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.version_progression(_digest(spark, d), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"], _C("digest"))
    return rows.select("snapshot_id", "user_id", "version")


def latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "day_snapshot").select("user_id", "schedule_date", "snapshot_id", "source_session_id", "updated_at", F.size("snapshot_payload").alias("shifts"))
    return versions.latest(rows, ["user_id", "schedule_date"], ["updated_at", "snapshot_id"]).select("user_id", F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date"), "snapshot_id", "source_session_id", F.greatest("shifts", F.lit(-1)).alias("shifts"))


def first_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "schedule_event").select(*diff.DEDUPE, "event_id", "detected_at")
    return versions.first_of(rows, diff.DEDUPE, ["detected_at", "event_id"]).select("event_id")


def appended_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "schedule_event").select(*diff.DEDUPE, "event_id", "detected_at")
    return versions.append(rows.where(_C("detected_at") >= NOW), rows.where(_C("detected_at") < NOW), diff.DEDUPE, ["detected_at", "event_id"]).select("event_id")


def diff_history(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_history(table(spark, d, "day_snapshot")).select("snapshot_id", "event_seq", "event_type", "location_fingerprint", "customer_fingerprint", "old_value_hash", "new_value_hash")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return diff.event_log(diff.diff_history(table(spark, d, "day_snapshot"))).select("event_id", "event_type", "user_id", F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date"))


def replayed_state(spark: SparkSession, d: str) -> DataFrame:
    state = diff.replay(table(spark, d, "schedule_event"), ["detected_at", "event_id"])
    return state.select("user_id", F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date"), _C("shift.location_fingerprint").alias("location"), _C("shift.customer_fingerprint").alias("customer"), _C("shift.start").alias("s"), _C("shift.end").alias("e"))


def notifications(spark: SparkSession, d: str) -> DataFrame:
    told = notify.build_notifications(table(spark, d, "schedule_event"))
    return told.select("notification_id", "user_id", "notification_type", "message", F.array_join("event_ids", ",").alias("event_ids"))


def merged_equal_times(spark: SparkSession, d: str) -> DataFrame:
    named = {"start": "shift_start", "end": "shift_end"}
    shift = F.struct(*(F.coalesce(_C(named.get(f, f)), F.lit("")).alias(f) for f in SHIFT_FIELDS))
    rows = table(spark, d, "aggregated_shift").dropDuplicates(["agg_id"]).select("session_id", shift.alias("shift"), F.coalesce("source_count", F.lit(1)).alias("source_count"), _C("agg_id").alias("seq"))
    x = _C("shift")
    merged = aggregate.merge_equal_times(rows, ["session_id"])
    return merged.select("session_id", x["start"].alias("s"), x["end"].alias("e"), x["customer_name"].alias("customer_name"), x["raw_type_label"].alias("label"), x["shift_type"].alias("kind"), x["street"].alias("street"), x["city"].alias("city"), "source_count")


def session_aggregate(spark: SparkSession, d: str) -> DataFrame:
    named = {"start": text.strict_time(_C("shift_start")), "end": text.strict_time(_C("shift_end"))}
    shift = F.struct(*(named.get(f, F.coalesce(_C(f) if f not in named else F.lit(""), F.lit(""))).alias(f) for f in SHIFT_FIELDS))
    rows = table(spark, d, "canonical_shift").dropDuplicates(["shift_id"]).select("session_id", "image_index", "shift_index", shift.alias("shift"))
    return aggregate.aggregate_sessions(rows).select("session_id", "shift.*", "source_count")


def normalized_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entry").dropDuplicates(["entry_id"]).select("entry_id", _C("shift_start").alias("start"), _C("shift_end").alias("end"), "title", "location", "address")
    return entries.normalize_entries(rows).select("entry_id", "shift.*", "error")


def _entry_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as a screen would show the entries of a session: date on top, one card below another."""
    rows = table(spark, d, "entry").where("schedule_date is not null").dropDuplicates(["entry_id"])
    n = F.row_number().over(layout_window("session_id"))
    card = F.array(
        F.struct(F.concat(text.strict_time(_C("shift_start")), F.lit("-"), text.strict_time(_C("shift_end"))).alias("text"), F.lit(0).alias("line")),
        F.struct(_C("title").alias("text"), F.lit(1).alias("line")), F.struct(_C("address").alias("text"), F.lit(2).alias("line")), F.struct(_C("location").alias("text"), F.lit(3).alias("line")),
    )
    cards = rows.withColumn("n", n).select(_C("session_id").alias("image_id"), "n", F.inline(card)).select("image_id", "text", F.lit(60.0).alias("x"), (_C("n") * 160 + _C("line") * 22).cast("double").alias("y"), F.lit(200.0).alias("w"), F.lit(18.0).alias("h"))
    head = rows.groupBy(_C("session_id").alias("image_id")).agg(F.max("schedule_date").alias("day")).select("image_id", F.concat(F.lit("Måndag "), F.date_format("day", "d MMMM yyyy")).alias("text"), F.lit(60.0).alias("x"), F.lit(20.0).alias("y"), F.lit(200.0).alias("w"), F.lit(24.0).alias("h"))
    return cards.unionByName(head)


def layout_window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("entry_id")


def layout_entries(spark: SparkSession, d: str) -> DataFrame:
    return layout.parse_layout(_entry_boxes(spark, d))


def screenshot_dates(spark: SparkSession, d: str) -> DataFrame:
    found = dates.image_dates(_entry_boxes(spark, d), 2025)
    return found.select("image_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = (_C("entry_id") % 500).cast("double"), (_C("entry_id") % 700).cast("double")
    corner = lambda a, b: F.array(x + a, y + b)
    pages = table(spark, d, "entry").dropDuplicates(["entry_id"]).select(_C("entry_id").alias("image_id"), F.array(F.array(corner(0, 0), corner(30, 2), corner(31, 12), corner(1, 11)), F.array(corner(0, 0))).alias("polygons"), F.array("title", "address").alias("texts"), F.array(F.lit(0.9), F.lit(0.8)).alias("scores"))
    return layout.page_boxes(pages).select("image_id", "box_seq", "text", "x", "y", "w", "h")


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = versions.version_progression(_digest(spark, d), ["user_id", "schedule_date"], ["updated_at", "snapshot_id"], _C("digest"))
    return rows.groupBy("user_id", F.date_format("schedule_date", "yyyy-MM-dd").alias("schedule_date")).agg(F.max("version").alias("current_version"), (F.max("version") + 1).alias("next_version"))


def resolved_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entry").select("session_id", _C("entry_id").alias("image_id"), _C("schedule_date").alias("date")).distinct()
    out = dates.session_dates(rows)
    return out.select("session_id", "image_id", F.date_format("resolved", "yyyy-MM-dd").alias("resolved"), "inherited", "error")


QUERIES = {
    f.__name__: f
    for f in (
        location_fingerprints, customer_fingerprints, value_hashes, lock_keys, clean_titles, shift_times, label_kinds, known_labels, clock_arithmetic, finalizable_sessions,
        waiting_sessions, claim_next, session_image_names, version_progression, latest_versions, latest_snapshots, first_events, appended_events, diff_history, event_log,
        replayed_state, notifications, merged_equal_times, session_aggregate, normalized_entries, layout_entries, screenshot_dates, resolved_dates, page_boxes,
    )
}

_READ = r"trim(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '[^A-Za-z0-9\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"
_PART = rf"regexp_replace(translate(lower({_READ}), '01i|', 'olll'), '[^a-z0-9]', '', 'g')"
_SPACE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FIX = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, '|I', 'li'), '(\p{{L}})0(\p{{L}})', '\1o\2', 'g'), '(\p{{L}})0(\p{{L}})', '\1o\2', 'g'), '(\p{{L}})1(\p{{L}})', '\1i\2', 'g'), '(\p{{L}})1(\p{{L}})', '\1i\2', 'g')"
_CLEAN = rf"trim(regexp_replace(regexp_replace({_FIX}, '[^\p{{{{L}}}}\p{{{{N}}}} ''-]', ' ', 'g'), '\s+', ' ', 'g'))"
_PLAIN = rf"lower(trim(regexp_replace(regexp_replace(strip_accents({_FIX}), '[^\p{{{{L}}}}\p{{{{N}}}} ''-]', ' ', 'g'), '\s+', ' ', 'g')))"
_EVENT_KEY = ["user_id", "schedule_date", "location_fingerprint", "event_type", "old_value_hash", "new_value_hash"]
_FIELDS = ["start", "end", "customer_name", "customer_fingerprint", "street", "street_number", "postal_code", "postal_area", "city", "location_fingerprint", "shift_type", "raw_type_label"]
_DEDUPE = ", ".join(_EVENT_KEY)
_JSON = "'{{' || " + " || ',' || ".join(f"'\"{f}\":' || coalesce(to_json({{0}}.\"{f}\")::VARCHAR, 'null')" for f in sorted(_FIELDS)) + " || '}}'"
_PAYLOAD = "array_to_string(list_sort(list_transform(snapshot_payload, lambda x: " + " || '|' || ".join(f"coalesce(x.\"{f}\", '')" for f in _FIELDS) + ")), ';')"
_WORDS = {
    "TRAVEL": ["restid", "inter tid"], "BREAK": ["lunch", "rast", "thank you for today"], "MEETING": ["personalmote"], "ADMIN": ["nyckelhantering", "forberedelser till iss"],
    "LEAVE": ["vard av barn", "tjanstledig", "sjukdom"], "UNAVAILABLE": ["ej disponibel", "avbokade uppdrag", "avokade uppdrag"], "TRAINING": ["utbildning"],
    "WORK": ["stadservice", "stadning", "reklamation", "extra stadtillfalle", "fonsterputs", "kylskapsrengoring", "ugnsrengoring", "clickandgo", "skola", "kontor"],
}
_CHAIN = " ".join("WHEN " + " OR ".join(f"contains(m, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in _WORDS.items())
_QUALITY = (
    "CASE WHEN street <> '' THEN 40 + least(length(trim(street)), 40) ELSE 0 END + CASE WHEN trim(street_number) <> '' THEN 12 ELSE 0 END + CASE WHEN trim(postal_code) <> '' THEN 10 ELSE 0 END"
    " + CASE WHEN trim(postal_area) <> '' THEN 8 ELSE 0 END + CASE WHEN trim(city) <> '' THEN 12 + least(length(trim(city)), 20) ELSE 0 END"
).replace("WHEN street <> ''", "WHEN trim(street) <> ''")
_AT = lambda v, f, other: f"coalesce({v}.\"{f}\", '{other}')"
_SPAN = lambda v: f"{_AT(v, 'start', '--:--')} || '–' || {_AT(v, 'end', '--:--')}"
_A, _B, _D, _E = _AT("o", "start", "--:--"), _AT("o", "end", "--:--"), _AT("n", "start", "--:--"), _AT("n", "end", "--:--")
_KIND = "CASE coalesce(n.shift_type, 'UNKNOWN') WHEN 'WORK' THEN 'Work shift' WHEN 'TRAVEL' THEN 'Travel' WHEN 'TRAINING' THEN 'Training' WHEN 'BREAK' THEN 'Break' WHEN 'MEETING' THEN 'Meeting' WHEN 'ADMIN' THEN 'Administrative task' WHEN 'LEAVE' THEN 'Leave' WHEN 'UNAVAILABLE' THEN 'Unavailable' WHEN 'UNKNOWN' THEN 'Unknown job type' ELSE upper(n.shift_type[1]) || lower(n.shift_type[2:]) END"
_MESSAGE = f"""CASE event_type WHEN 'shift_added' THEN 'New shift added on ' || d || ' ' || {_SPAN('n')} || ' in ' || {_AT('n', 'city', 'unknown location')}
    WHEN 'shift_removed' THEN 'Shift removed on ' || d || ' ' || {_SPAN('o')} || ' in ' || {_AT('o', 'city', 'unknown location')}
    WHEN 'shift_time_changed' THEN 'On ' || d || ' ' || coalesce(n.city, o.city, 'shift') || ' shift moved ' || CASE WHEN {_A} <> {_D} AND {_B} = {_E} THEN {_A} || ' → ' || {_D} WHEN {_B} <> {_E} AND {_A} = {_D} THEN 'ends ' || {_B} || ' → ' || {_E} ELSE {_SPAN('o')} || ' → ' || {_SPAN('n')} END
    WHEN 'shift_relocated' THEN 'On ' || d || ' ' || coalesce(n."start", o."start", '--:--') || ' shift moved to ' || {_AT('n', 'city', 'unknown location')}
    WHEN 'shift_reclassified' THEN 'On ' || d || ' job updated to ' || coalesce(nullif(n.raw_type_label, ''), {_KIND})
    WHEN 'shift_retitled' THEN 'On ' || d || ' shift updated for ' || coalesce(n.customer_name, o.customer_name, 'customer') ELSE 'On ' || d || ' schedule updated' END"""
_SORTED = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE 'a' || {c} END"
_ORDER = ", ".join(_SORTED(c) for c in ("x.location_fingerprint", "x.customer_fingerprint", 'x."start"', 'x."end"', "lower(x.customer_name)", "lower(x.street)", "lower(x.street_number)", "lower(x.city)"))
_MIN = lambda v: f"(try_cast(split_part({v}, ':', 1) AS INT) * 60 + try_cast(split_part({v}, ':', 2) AS INT))"
_SIDE = "SELECT snapshot_id, seq, x, x.location_fingerprint AS loc, x.customer_fingerprint AS cust, x.\"start\" AS s, x.\"end\" AS e, row_number() OVER (PARTITION BY snapshot_id ORDER BY {0}, seq) AS k FROM (SELECT snapshot_id, unnest({1}) AS x, generate_subscripts({1}, 1) AS seq FROM b) WHERE x IS NOT NULL"
_PAIRS = lambda a, b, keys: f"SELECT o.snapshot_id, o.k AS ok, n.k AS nk, {', '.join(f'o.{k}' for k in keys)}, o.r FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, {', '.join(keys)} ORDER BY k) AS r FROM {a}) o JOIN (SELECT *, row_number() OVER (PARTITION BY snapshot_id, {', '.join(keys)} ORDER BY k) AS r FROM {b}) n USING (snapshot_id, r, {', '.join(keys)})"
_LEFT = lambda a, p, k: f"SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.snapshot_id = {a}.snapshot_id AND {p}.{k} = {a}.k)"
_DIFF = f"""
    WITH a AS (SELECT DISTINCT ON (snapshot_id) snapshot_id, user_id, schedule_date, updated_at, source_session_id, snapshot_payload AS p FROM day_snapshot WHERE snapshot_payload IS NOT NULL),
    b AS (SELECT *, lag(p) OVER (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id) AS q FROM a),
    n AS ({_SIDE.format(_ORDER, 'p')}), o AS ({_SIDE.format(_ORDER, 'q')}),
    f AS (SELECT o.snapshot_id, o.loc, o.cust, o.k AS ok, n.k AS nk, coalesce(abs({_MIN('o.s')} - {_MIN('n.s')}) + abs({_MIN('o.e')} - {_MIN('n.e')}), 1073741824) AS gap FROM o JOIN n USING (snapshot_id, loc, cust)),
    g AS (SELECT snapshot_id, loc, cust, list_reduce(list({{'o': [ok], 'n': [nk]}} ORDER BY gap, ok, nk), lambda a, p: CASE WHEN list_has_any(a.o, p.o) OR list_has_any(a.n, p.n) THEN a ELSE {{'o': list_concat(a.o, p.o), 'n': list_concat(a.n, p.n)}} END) AS t FROM f GROUP BY ALL),
    p1 AS (SELECT snapshot_id, loc, cust, unnest(t.o) AS ok, unnest(t.n) AS nk, generate_subscripts(t.o, 1) AS r FROM g),
    o2 AS ({_LEFT('o', 'p1', 'ok')}), n2 AS ({_LEFT('n', 'p1', 'nk')}), p2 AS ({_PAIRS('o2', 'n2', ['cust', 's', 'e'])}),
    o3 AS ({_LEFT('o2', 'p2', 'ok')}), n3 AS ({_LEFT('n2', 'p2', 'nk')}), p3 AS ({_PAIRS('o3', 'n3', ['loc', 's', 'e'])}),
    o4 AS ({_LEFT('o3', 'p3', 'ok')}), n4 AS ({_LEFT('n3', 'p3', 'nk')}),
    j AS (SELECT snapshot_id, 1 AS stage, loc AS k1, cust AS k2, '' AS k3, r, ok, nk FROM p1 UNION ALL SELECT snapshot_id, 2, cust, s, e, r, ok, nk FROM p2 UNION ALL SELECT snapshot_id, 3, loc, s, e, r, ok, nk FROM p3
        UNION ALL SELECT snapshot_id, 4, '', '', '', k, k, NULL FROM o4 UNION ALL SELECT snapshot_id, 5, '', '', '', k, NULL, k FROM n4),
    v AS (SELECT j.*, o.x AS old_value, n.x AS new_value, CASE stage WHEN 2 THEN 'shift_relocated' WHEN 3 THEN 'shift_retitled' WHEN 4 THEN 'shift_removed' WHEN 5 THEN 'shift_added' ELSE CASE WHEN o.s <> n.s OR o.e <> n.e THEN 'shift_time_changed'
        WHEN o.x.customer_name IS DISTINCT FROM n.x.customer_name THEN 'shift_retitled' WHEN o.x.shift_type IS DISTINCT FROM n.x.shift_type THEN 'shift_reclassified' END END AS event_type
        FROM j LEFT JOIN o ON o.snapshot_id = j.snapshot_id AND o.k = j.ok LEFT JOIN n ON n.snapshot_id = j.snapshot_id AND n.k = j.nk),
    z AS (SELECT v.snapshot_id, row_number() OVER (PARTITION BY v.snapshot_id ORDER BY stage, k1, k2, k3, r)::INT AS event_seq, event_type, coalesce(new_value, old_value).location_fingerprint AS location_fingerprint, coalesce(new_value, old_value).customer_fingerprint AS customer_fingerprint,
        sha256(CASE WHEN old_value IS NULL THEN 'null' ELSE {_JSON.format('old_value')} END) AS old_value_hash, sha256(CASE WHEN new_value IS NULL THEN 'null' ELSE {_JSON.format('new_value')} END) AS new_value_hash, a.user_id, a.schedule_date, a.updated_at, a.source_session_id
        FROM v JOIN a USING (snapshot_id) WHERE event_type IS NOT NULL)"""
_TEXT = "concat_ws(' ', nullif(street, ''), nullif(street_number, ''), nullif(postal_code, ''), nullif(postal_area, ''), nullif(city, ''))"

ORACLE = {
    "location_fingerprints": f"SELECT DISTINCT shift_id, sha256({_PART.format('street')} || '|' || {_PART.format('street_number')} || '|' || {_PART.format('CASE WHEN coalesce(postal_area, chr(0)) NOT IN (chr(0), $$$$) THEN postal_area ELSE city END')}) AS location_key FROM canonical_shift",
    "customer_fingerprints": f"""
        WITH a AS (SELECT DISTINCT shift_id, list_filter(string_split(lower({_READ.format('customer_name')}), ' '), lambda w: w <> '') AS w FROM canonical_shift),
        b AS (SELECT shift_id, w, list_filter(w, lambda x: x NOT IN ('ab', 'hb', 'stadservice', 'stadtjanst', 'stadning')) AS o FROM a),
        c AS (SELECT shift_id, CASE WHEN len(o) > 0 THEN o ELSE w END AS u FROM b),
        d AS (SELECT shift_id, u, list_filter(u, lambda x: length(x) = list_max(list_transform(u, lambda y: length(y))))[1] AS s FROM c)
        SELECT shift_id, sha256(coalesce(s || '|' || array_to_string(list_sort(list_transform(list_filter(u, lambda x: x <> s), lambda x: x[1])), ''), '')) AS customer_key FROM d""",
    "value_hashes": f"SELECT DISTINCT event_id, sha256(CASE WHEN old_value IS NULL THEN 'null' ELSE {_JSON.format('old_value')} END) AS old_hash, sha256(CASE WHEN new_value IS NULL THEN 'null' ELSE {_JSON.format('new_value')} END) AS new_hash FROM schedule_event",
    "clean_titles": f"""SELECT DISTINCT entry_id, {_CLEAN.format(_SPACE.format('title'))} AS clean, {_PLAIN.format(_SPACE.format('title'))} AS plain,
        array_to_string(list_transform(string_split({_CLEAN.format(_SPACE.format('title'))}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM entry WHERE title IS NOT NULL""",
    "shift_times": r"""
        WITH a AS (SELECT DISTINCT shift_id, shift_start AS t, trim(regexp_replace(shift_start, '\s+', ' ', 'g')) AS u FROM canonical_shift),
        b AS (SELECT shift_id, regexp_extract(t, '^\s*(\d{1,2})[:.](\d{2})\s*$', 1) AS h, regexp_extract(t, '^\s*(\d{1,2})[:.](\d{2})\s*$', 2) AS m,
            regexp_extract(u, '^(\d{1,2})(?:\s*[:.]\s*|\s+)(\d{1,2})$', 1) AS lh, regexp_extract(u, '^(\d{1,2})(?:\s*[:.]\s*|\s+)(\d{1,2})$', 2) AS lm FROM a)
        SELECT shift_id, CASE WHEN h <> '' AND h::INT < 24 AND m::INT < 60 THEN lpad(h, 2, '0') || ':' || m END AS strict,
            CASE WHEN lh <> '' AND lh::INT < 24 AND lm::INT < 60 THEN lpad(lh, 2, '0') || ':' || lpad(lm, 2, '0') END AS loose FROM b""",
    "label_kinds": f"WITH a AS (SELECT DISTINCT raw_type_label FROM canonical_shift WHERE raw_type_label IS NOT NULL), b AS (SELECT raw_type_label, {_PLAIN.format(_SPACE.format('raw_type_label'))} AS m FROM a) SELECT raw_type_label, CASE {_CHAIN} ELSE 'UNKNOWN' END AS kind FROM b",
    "clock_arithmetic": r"""
        WITH a AS (SELECT DISTINCT shift_id, regexp_extract(shift_start, '^\s*(\d{1,2})[:.](\d{2})\s*$', 1) AS h, regexp_extract(shift_start, '^\s*(\d{1,2})[:.](\d{2})\s*$', 2) AS m,
            regexp_extract(shift_end, '^\s*(\d{1,2})[:.](\d{2})\s*$', 1) AS h2, regexp_extract(shift_end, '^\s*(\d{1,2})[:.](\d{2})\s*$', 2) AS m2 FROM canonical_shift),
        b AS (SELECT shift_id, h::INT * 60 + m::INT AS s, h2::INT * 60 + m2::INT AS e FROM a WHERE h <> '' AND h2 <> '' AND try_cast(h AS INT) < 24 AND try_cast(h2 AS INT) < 24 AND try_cast(m AS INT) < 60 AND try_cast(m2 AS INT) < 60),
        c AS (SELECT *, (e - s + 1440) % 1440 AS l, (720 - s + 1440) % 1440 AS n, (780 - s + 1440) % 1440 AS o, (s - 725 + 1440) % 1440 AS x FROM b)
        SELECT shift_id, least(abs(s - e), 1440 - abs(s - e)) AS apart, l AS "length", l >= 60 AND n <= l AND o <= l AS over_noon, lpad((x // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0') AS earlier,
            CASE WHEN abs(e - 1440 - s) <= abs(e - s) AND abs(e - 1440 - s) <= abs(e + 1440 - s) THEN e - 1440 WHEN abs(e - s) <= abs(e + 1440 - s) THEN e ELSE e + 1440 END AS turn FROM c""",
    "finalizable_sessions": f"""SELECT DISTINCT s.session_id, s.user_id, m.last_image_at FROM capture_session s JOIN (SELECT session_id, max(captured_at) AS last_image_at FROM entry GROUP BY 1) m USING (session_id)
        WHERE s.state = 'processed' AND m.last_image_at <= TIMESTAMP '{NOW}' - INTERVAL 25 SECOND""",
    "waiting_sessions": f"""SELECT count(*)::BIGINT AS waiting FROM (SELECT DISTINCT s.session_id FROM capture_session s WHERE s.state = 'processed'
        AND NOT EXISTS (SELECT 1 FROM entry e WHERE e.session_id = s.session_id GROUP BY e.session_id HAVING max(e.captured_at) <= TIMESTAMP '{NOW}' - INTERVAL 25 SECOND))""",
    "claim_next": f"""SELECT DISTINCT ON (k, created_at, session_id) session_id, user_id, state, created_at FROM (SELECT *, CASE WHEN state = 'open' THEN 0 ELSE 1 END AS k FROM capture_session
        WHERE state = 'open' OR (state = 'processing' AND created_at < TIMESTAMP '{NOW}')) ORDER BY k, created_at, session_id LIMIT 10""",
    "session_image_names": "SELECT session_id, string_agg(DISTINCT image_index || '.png', ',' ORDER BY image_index || '.png') AS names FROM (SELECT DISTINCT session_id, image_index FROM canonical_shift) GROUP BY 1",
    "version_progression": f"""
        WITH a AS (SELECT DISTINCT snapshot_id, user_id, schedule_date, updated_at, {_PAYLOAD} AS h FROM day_snapshot WHERE snapshot_payload IS NOT NULL),
        b AS (SELECT *, lag(h) OVER w AS p, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id))
        SELECT snapshot_id, user_id, (sum(CASE WHEN n = 1 OR h IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id))::INT AS version FROM b""",
    "latest_versions": f"""
        WITH a AS (SELECT DISTINCT snapshot_id, user_id, schedule_date, updated_at, {_PAYLOAD} AS h FROM day_snapshot WHERE snapshot_payload IS NOT NULL),
        b AS (SELECT *, lag(h) OVER w AS p, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id, schedule_date ORDER BY updated_at, snapshot_id))
        SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, sum(CASE WHEN n = 1 OR h IS DISTINCT FROM p THEN 1 ELSE 0 END)::INT AS current_version, sum(CASE WHEN n = 1 OR h IS DISTINCT FROM p THEN 1 ELSE 0 END)::INT + 1 AS next_version FROM b GROUP BY user_id, b.schedule_date""",
    "latest_snapshots": """SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, snapshot_id, source_session_id, coalesce(len(snapshot_payload), -1)::INT AS shifts FROM day_snapshot
        QUALIFY row_number() OVER (PARTITION BY user_id, day_snapshot.schedule_date ORDER BY updated_at DESC, snapshot_id DESC) = 1""",
    "first_events": f"SELECT event_id FROM schedule_event QUALIFY row_number() OVER (PARTITION BY {_DEDUPE} ORDER BY detected_at, event_id) = 1",
    "appended_events": f"""SELECT event_id FROM (SELECT * FROM schedule_event WHERE detected_at >= TIMESTAMP '{NOW}') e WHERE NOT EXISTS (SELECT 1 FROM schedule_event o WHERE o.detected_at < TIMESTAMP '{NOW}' AND {" AND ".join(f"o.{c} IS NOT DISTINCT FROM e.{c}" for c in _EVENT_KEY)})
        QUALIFY row_number() OVER (PARTITION BY {_DEDUPE} ORDER BY detected_at, event_id) = 1""",
    "lock_keys": "SELECT user_id, schedule_date, CASE WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS lock_key FROM (SELECT user_id, d AS schedule_date, ('0x' || sha256(user_id || ':' || d)[1:16])::UBIGINT::HUGEINT AS u FROM (SELECT DISTINCT user_id, strftime(schedule_date, '%Y-%m-%d') AS d FROM day_snapshot))",
    "diff_history": _DIFF + " SELECT snapshot_id, event_seq, event_type, location_fingerprint, customer_fingerprint, old_value_hash, new_value_hash FROM z",
    "event_log": _DIFF + """, k AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY user_id, schedule_date, location_fingerprint, event_type, old_value_hash, new_value_hash ORDER BY updated_at, event_seq, source_session_id) = 1)
        SELECT sha256(concat_ws('|', coalesce(user_id::VARCHAR, 'null'), coalesce(strftime(schedule_date, '%Y-%m-%d'), 'null'), coalesce(location_fingerprint, 'null'), event_type, old_value_hash, new_value_hash)) AS event_id, event_type, user_id, strftime(k.schedule_date, '%Y-%m-%d') AS schedule_date FROM k""",
    "notifications": f"""
        WITH a AS (SELECT DISTINCT ON (event_id) event_id, user_id, schedule_date, strftime(schedule_date, '%Y-%m-%d') AS d, event_type, location_fingerprint, old_value AS o, new_value AS n, source_session_id, detected_at FROM schedule_event),
        b AS (SELECT *, count(*) OVER (PARTITION BY user_id, schedule_date, source_session_id) AS c, coalesce(coalesce(n, o)."start", '99:99') AS s FROM a),
        g AS (SELECT user_id, d, source_session_id, list(event_id ORDER BY s, coalesce(location_fingerprint, ''), event_type, detected_at, event_id) AS ids FROM b WHERE c >= 3 GROUP BY ALL)
        SELECT sha256(concat_ws('|', user_id::VARCHAR, d, source_session_id, event_id)) AS notification_id, user_id, 'event' AS notification_type, {_MESSAGE} AS message, event_id AS event_ids FROM b WHERE c < 3
        UNION ALL SELECT sha256(concat_ws('|', user_id::VARCHAR, d, source_session_id, 'summary', array_to_string(ids, '|'))), user_id, 'summary', len(ids) || ' shifts updated for on ' || d, array_to_string(ids, ',') FROM g""",
    "replayed_state": """
        WITH w AS (SELECT user_id, schedule_date, detected_at, event_id, 0 AS step, old_value AS k, NULL AS v FROM schedule_event WHERE old_value IS NOT NULL
            UNION ALL SELECT user_id, schedule_date, detected_at, event_id, 1, new_value, new_value FROM schedule_event WHERE new_value IS NOT NULL),
        l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id, schedule_date, k.location_fingerprint, k.customer_fingerprint, k."start", k."end" ORDER BY detected_at DESC, event_id DESC, step DESC) = 1)
        SELECT user_id, strftime(schedule_date, '%Y-%m-%d') AS schedule_date, k.location_fingerprint AS location, k.customer_fingerprint AS customer, k."start" AS s, k."end" AS e FROM l WHERE step = 1""",
    "merged_equal_times": f"""
        WITH a AS (SELECT DISTINCT ON (agg_id) agg_id, session_id, coalesce(shift_start, '') AS s, coalesce(shift_end, '') AS e, {', '.join(f"coalesce({c}, '') AS {c}" for c in _FIELDS[2:])}, coalesce(source_count, 1) AS n FROM aggregated_shift),
        b AS (SELECT *, {_QUALITY} - CASE WHEN regexp_matches({_TEXT}, '[?+]') THEN 15 ELSE 0 END AS q, length({_TEXT}) AS l FROM a)
        SELECT session_id, s, e, arg_max(customer_name, row(length(trim(customer_name)), lower(customer_name), -agg_id)) AS customer_name, arg_max(raw_type_label, row(length(trim(raw_type_label)), lower(raw_type_label), -agg_id)) AS label,
            shift_type AS kind, arg_max(street, row(q, l, -agg_id)) AS street, arg_max(city, row(q, l, -agg_id)) AS city, sum(n)::INT AS source_count FROM b GROUP BY session_id, s, e, customer_fingerprint, shift_type, lower(raw_type_label)""",
    "screenshot_dates": "SELECT session_id AS image_id, strftime(max(schedule_date), '%Y-%m-%d') AS date FROM entry WHERE schedule_date IS NOT NULL GROUP BY 1",
    "resolved_dates": """
        WITH a AS (SELECT DISTINCT session_id, entry_id AS image_id, schedule_date AS d FROM entry), b AS (SELECT *, min(d) OVER (PARTITION BY session_id) AS lo, max(d) OVER (PARTITION BY session_id) AS hi FROM a)
        SELECT session_id, image_id, CASE WHEN lo = hi THEN strftime(lo, '%Y-%m-%d') END AS resolved, d IS NULL AND lo IS NOT NULL AND lo = hi AS inherited, CASE WHEN lo IS NULL THEN 'no date' WHEN lo <> hi THEN 'several dates' END AS error FROM b""",
    "page_boxes": "SELECT DISTINCT entry_id AS image_id, 0 AS box_seq, title AS text, (entry_id % 500)::DOUBLE AS x, (entry_id % 700)::DOUBLE AS y, 31.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM entry",
}
