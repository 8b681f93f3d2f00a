import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_snapshots import FIELDS, shift

from rotaloom.operators import aggregate, dates, diff, entries, layout, notify, sessions, versions
from rotaloom.streaming import idle

STRUCT = "struct<" + ",".join(f"`{f}`:string" for f in FIELDS) + ">"
DAY = date(2025, 3, 4)


def full(**known):
    return dict.fromkeys(FIELDS, "") | known


# diff


def pair_nearest(old, new):
    """The greedy rule as a loop: again and again the closest pair of what is left."""
    number = lambda t: int(t[:2]) * 60 + int(t[3:])
    key = lambda x, i: (x["start"], x["end"], x["customer_name"].lower(), i)
    out, o, n = [], dict(enumerate(old)), dict(enumerate(new))
    groups = defaultdict(lambda: ([], []))
    for side, items in ((0, o), (1, n)):
        for i, x in items.items():
            groups[x["location_fingerprint"], x["customer_fingerprint"]][side].append(i)
    for a, b in groups.values():
        a, b = list(a), list(b)
        while a and b:
            _, _, _, i, j = min((abs(number(o[i]["start"]) - number(n[j]["start"])) + abs(number(o[i]["end"]) - number(n[j]["end"])), key(o[i], i), key(n[j], j), i, j) for i in a for j in b)
            out.append((i, j))
            a.remove(i), b.remove(j)
    return out


def brute_diff(old, new):
    out = []
    pairs = pair_nearest(old, new)
    for i, j in pairs:
        a, b = old[i], new[j]
        kind = "shift_time_changed" if (a["start"], a["end"]) != (b["start"], b["end"]) else "shift_retitled" if a["customer_name"] != b["customer_name"] else "shift_reclassified" if a["shift_type"] != b["shift_type"] else None
        out += [(kind, b["location_fingerprint"], b["customer_fingerprint"])] if kind else []
    o = [x for i, x in enumerate(old) if i not in {p[0] for p in pairs}]
    n = [x for j, x in enumerate(new) if j not in {p[1] for p in pairs}]
    for kind, fields in (("shift_relocated", ("customer_fingerprint", "start", "end")), ("shift_retitled", ("location_fingerprint", "start", "end"))):
        order = lambda x: (x["location_fingerprint"], x["customer_fingerprint"], x["start"], x["end"])
        for b in sorted(n, key=order):
            a = next((a for a in sorted(o, key=order) if all(a[f] == b[f] for f in fields)), None)
            if a:
                out.append((kind, b["location_fingerprint"], b["customer_fingerprint"]))
                o.remove(a), n.remove(b)
    return sorted(out + [("shift_removed", x["location_fingerprint"], x["customer_fingerprint"]) for x in o] + [("shift_added", x["location_fingerprint"], x["customer_fingerprint"]) for x in n])


def test_diff_equals_loops(spark):
    random.seed(8)
    days, want = [], {}
    for day in range(40):
        make = lambda: full(location_fingerprint=random.choice("lm"), customer_fingerprint=random.choice("cd"), start=f"{random.randint(8, 10):02}:00", end=f"{random.randint(11, 12):02}:00", customer_name=random.choice(["A", "A", "B"]), shift_type=random.choice(["WORK", "WORK", "BREAK"]))
        old, new = [make() for _ in range(random.randint(0, 5))], [make() for _ in range(random.randint(0, 5))]
        days.append((day, old or random.choice([None, []]), new))
        want[day] = brute_diff(old, new)
    got = defaultdict(list)
    for r in diff.diff_days(spark.createDataFrame(days, f"day int, old_shifts array<{STRUCT}>, new_shifts array<{STRUCT}>"), ["day"]).collect():
        got[r.day].append((r.event_type, r.location_fingerprint, r.customer_fingerprint))
        assert (r.old_value is None) == (r.event_type == "shift_added") and (r.new_value is None) == (r.event_type == "shift_removed")
    assert {d: sorted(got[d]) for d in want} == want


def test_history_log_and_replay(spark):
    a, b = full(location_fingerprint="l", customer_fingerprint="c", start="08:00", end="09:00"), full(location_fingerprint="l", customer_fingerprint="c", start="10:00", end="11:00")
    states = [[a], [b], None, [a], []]
    rows = [(i, 1, DAY, s, f"s{i}", datetime(2025, 3, 1) + timedelta(hours=i)) for i, s in enumerate(states)]
    history = diff.diff_history(spark.createDataFrame(rows, f"snapshot_id bigint, user_id bigint, schedule_date date, snapshot_payload array<{STRUCT}>, source_session_id string, updated_at timestamp"))
    assert [(r.snapshot_id, r.event_type) for r in history.orderBy("snapshot_id").collect()] == [(0, "shift_added"), (1, "shift_time_changed"), (3, "shift_time_changed"), (4, "shift_removed")]
    log = diff.event_log(history)
    assert log.count() == 4 and log.select("event_id").distinct().count() == 4
    assert diff.replay(log, ["detected_at"]).count() == 0
    assert [r["shift"].start for r in diff.replay(log.where("snapshot_id < 4"), ["detected_at"]).collect()] == ["08:00"]


# versions and sessions


def test_versions(spark):
    rows = [("u", i, h) for i, h in enumerate(["A", "A", "B", "A", None, None])] + [("v", 0, "A")]
    df = spark.createDataFrame(rows, "k string, n int, h string")
    out = versions.version_progression(df, ["k"], ["n"], F.col("h"))
    assert [r.version for r in out.where("k = 'u'").orderBy("n").collect()] == [1, 1, 2, 3, 4, 4]
    assert versions.version_gaps(out.select("k", "version").distinct(), ["k"]).count() == 0
    assert versions.version_gaps(spark.createDataFrame([("a", 2), ("b", 1), ("b", 3)], "k string, version int"), ["k"]).count() == 2
    assert {tuple(r) for r in versions.latest(df, ["k"], ["n"]).collect()} == {("u", 5, None), ("v", 0, "A")}
    log = df.where("n = 0 and k = 'u'")
    assert {tuple(r) for r in versions.append(df, log, ["k", "h"], ["n"]).select("k", "h").collect()} == {("u", "B"), ("u", None), ("v", "A")}
    assert versions.append(log, log, ["k", "h"], ["n"]).count() == 0


def test_sessions(spark):
    now = datetime(2025, 1, 1, 12)
    sess = spark.createDataFrame([("a", 1, "open", now), ("b", 1, "open", now), ("c", 1, "open", now), ("d", 1, "done", now), ("e", 2, "work", now - timedelta(hours=1)), ("f", 2, "work", now)], "session_id string, user_id int, state string, created_at timestamp")
    images = spark.createDataFrame([("a", now - timedelta(seconds=25)), ("b", now - timedelta(seconds=24)), ("d", now - timedelta(hours=1))], "session_id string, created_at timestamp")
    at = F.lit(now)
    assert [r.session_id for r in sessions.finalizable(sess, images, at).collect()] == ["a"]
    assert sessions.waiting(sess, images, at).first().waiting == 2
    assert [r.session_id for r in sessions.claim_order(sess, "open", "work", F.lit(now - timedelta(minutes=5)), 9).collect()] == ["a", "b", "c", "e"]
    names = spark.createDataFrame([("a", 2, "x/2.png"), ("a", 1, "y/1.png"), ("a", 3, "z/1.png"), ("b", 4, None), ("b", None, "")], "session_id string, sequence int, object_key string")
    assert {r.session_id: r.names for r in sessions.image_names(names).collect()} == {"a": ["1.png", "2.png"], "b": ["unknown-image", "sequence-4"]}
    keys = spark.createDataFrame([("/a/b",), ("store/a",), ("storex",)], "k string").select(sessions.object_key(F.col("k"), "store/").alias("o"))
    assert [r.o for r in keys.collect()] == ["store/a/b", "store/a", "store/storex"]


# aggregation


def observe(spark, *images):
    rows = [("s", i, j, full(customer_fingerprint="c", location_fingerprint="l") | x) for i, image in enumerate(images) for j, x in enumerate(image)]
    df = spark.createDataFrame(rows, f"session_id string, image_index int, shift_index int, shift {STRUCT}")
    return sorted((r["shift"].start, r["shift"].end, r.source_count) for r in aggregate.aggregate_sessions(df).collect())


def test_aggregate(spark):
    t = lambda a, b, **k: dict(start=a, end=b, shift_type="WORK", **k)
    assert observe(spark, [t("10:00", "14:00")], [t("10:03", "13:58")]) == [("10:00", "14:00", 2)]
    assert observe(spark, [t("23:55", "00:30")], [t("23:50", "00:35")]) == [("23:50", "00:35", 2)]
    assert observe(spark, [t("10:00", "10:00")], [t("10:00", "14:00")]) == [("10:00", "14:00", 2)]
    assert observe(spark, [t("10:00", "11:00"), t("12:00", "13:00")]) == [("10:00", "11:00", 1), ("12:00", "13:00", 1)]
    assert observe(spark, [t("10:00", "11:00", customer_fingerprint="x")], [t("10:20", "10:40", customer_fingerprint="y")]) == [("10:00", "11:00", 1), ("10:20", "10:40", 1)]
    assert observe(spark, [t("", "11:00")]) == []
    # equal time and customer at two places: the cleaner address wins
    rows = [("s", full(start="10:00", end="11:00", customer_fingerprint="c", shift_type="WORK", street="Ekgatan", street_number="1", city="Ekby", location_fingerprint="l"), 2, 1), ("s", full(start="10:00", end="11:00", customer_fingerprint="c", shift_type="WORK", street="Schedule Profile +2", location_fingerprint="m", customer_name="Anna"), 1, 2)]
    got = aggregate.merge_equal_times(spark.createDataFrame(rows, f"session_id string, shift {STRUCT}, source_count int, seq int"), ["session_id"]).collect()
    assert [(r["shift"].street, r["shift"].customer_name, r.source_count) for r in got] == [("Ekgatan", "Anna", 3)]
    with pytest.raises(ValueError):
        aggregate.aggregate_sessions(None, -1)


# entries, layout and dates


def test_entries(spark):
    rows = [("08:00", "9.30", "Berg AB • Storstädning 3h", "", "Ekgatan 6A 436 57 Hovås"), ("12:00", "12:30", "Lunch", "", ""), ("13:00", "x", "Anna Berg", "Mölndal", "Ekgatan 6"), ("14:00", "15:00", "Restid 20m", None, None), ("14:00", "15:00", "Berg Storstadnlng", None, "Ekgatan 7")]
    got = entries.normalize_entries(spark.createDataFrame(rows, "start string, end string, title string, location string, address string")).collect()
    by = {(r.start, r.title): r for r in got}
    assert len(got) == 5
    s = by["08:00", "Berg AB • Storstädning 3h"]["shift"]
    assert (s.start, s.end, s.customer_name, s.shift_type, s.raw_type_label, s.street, s.street_number, s.city) == ("08:00", "09:30", "Berg", "WORK", "Storstädning", "Ekgatan", "6A", "Hovås")
    s = by["12:00", "Lunch"]["shift"]
    assert (s.customer_name, s.shift_type, s.raw_type_label) == ("", "BREAK", "Lunch")
    r = by["13:00", "Anna Berg"]
    assert r["shift"].end is None and r.error == "no time in end: x" and r["shift"].city == "Mölndal" and r["shift"].shift_type == "WORK"
    assert by["14:00", "Restid 20m"]["shift"].shift_type == "TRAVEL"
    assert by["14:00", "Berg Storstadnlng"]["shift"].raw_type_label == "Storstädning"


def box(text, x, y, w=120, h=20):
    return dict(text=text, x=float(x), y=float(y), w=float(w), h=float(h))


CARD = [box("10:00-14:00", 80, 100), box("Anna Berg", 80, 125), box("Ekgatan 6A", 80, 150), box("Mölndal", 80, 175)]


def test_layout():
    assert layout.read_boxes(CARD) == [("10:00", "14:00", "Anna Berg", "Mölndal", "Ekgatan 6A")]
    for seed in range(20):
        r = random.Random(seed)
        moved = [b | {"x": b["x"] + r.uniform(-1, 1), "y": b["y"] + r.uniform(-1, 1)} for b in CARD]
        r.shuffle(moved)
        assert layout.read_boxes(moved) == layout.read_boxes(CARD)
    second = [b | {"x": 620.0, "y": b["y"] + 10} for b in CARD]
    assert len(layout.read_boxes(CARD + second)) == 2
    stacked = [box("08:00 Berit Ek", 80, 100), box("On time", 80, 122), box("11:45 ClickAndGo", 80, 144), box("Ekgatan 2", 80, 166), box("Collaborators +2", 80, 188)]
    assert layout.read_boxes(stacked) == [("08:00", "11:45", "Berit Ek ClickAndGo", "", "Ekgatan 2")]
    assert layout.read_boxes([box("Settings", 1, 1)]) == [] and layout.read_boxes([]) == [] and layout.read_boxes([box("9:41", 5, 5)]) == []


def test_layout_frame(spark):
    rows = [(i, *b.values(), "x") for i in ("a", "b") for b in CARD] + [("c", None, 1.0, 1.0, 1.0, 1.0, "x"), ("c", " ", 1.0, 1.0, None, 1.0, "x")]
    df = spark.createDataFrame(rows, "image_id string, text string, x double, y double, w double, h double, title string")
    assert {tuple(r) for r in layout.parse_layout(df).collect()} == {(i, 0, "10:00", "14:00", "Anna Berg", "Mölndal", "Ekgatan 6A") for i in "ab"}
    pages = spark.createDataFrame([("p", [[[0.0, 1.0], [10.0, 1.0], [10.0, 5.0], [0.0, 5.0]], [[1.0, 1.0]], [[0.0, 0.0]] * 4], ["t", "u", "v"], [0.9, 0.8])], "image_id string, polygons array<array<array<double>>>, texts array<string>, scores array<double>")
    assert [tuple(r) for r in layout.page_boxes(pages).collect()] == [("p", 0, "t", 0.9, 0.0, 1.0, 10.0, 4.0)]


def test_dates(spark):
    texts = spark.createDataFrame([("Måndag 3 mars 2025",), ("Tuesday 4 Feb",), ("30 februari 2025",), ("Rum 12 platser",), ("on 5 maj 2024 or 6 maj 2024",)], "text string")
    got = {(r.text, str(r.date), r.has_weekday, r.has_year) for r in dates.dates_in_text(texts, 2026).collect()}
    assert got == {("Måndag 3 mars 2025", "2025-03-03", True, True), ("Måndag 3 mars 2025", "2025-03-03", False, True), ("Tuesday 4 Feb", "2026-02-04", True, False), ("Tuesday 4 Feb", "2026-02-04", False, False), ("on 5 maj 2024 or 6 maj 2024", "2024-05-05", False, True), ("on 5 maj 2024 or 6 maj 2024", "2024-05-06", False, True)}
    boxes = spark.createDataFrame([("a", "Måndag", 10.0, 10.0, 20.0), ("a", "3 mars 2025", 90.0, 11.0, 20.0), ("a", "7 april 2025", 10.0, 60.0, 40.0), ("b", "3 mars", 1.0, 1.0, 9.0), ("c", "-", 1.0, 1.0, 9.0)], "image_id string, text string, x double, y double, h double")
    assert {(r.image_id, str(r.date), r.error) for r in dates.image_dates(boxes).collect()} == {("a", "2025-03-03", None), ("b", "None", "a date has no year")}
    images = spark.createDataFrame([("s", 1, DAY), ("s", 2, None), ("t", 3, None), ("u", 4, DAY), ("u", 5, date(2025, 1, 1))], "session_id string, image_id int, date date")
    assert {(r.image_id, r.resolved, r.inherited, r.error) for r in dates.session_dates(images).collect()} == {(1, DAY, False, None), (2, DAY, True, None), (3, None, False, "no date"), (4, None, False, "several dates"), (5, None, False, "several dates")}


# notifications


def test_notifications(spark):
    at = datetime(2025, 3, 1)
    event = lambda i, kind, session="s", start="10:00", old=None, new=True: (i, 1, DAY, kind, "l", "c", old, full(start=start, end="11:00", city="Ekby") if new else None, session, at)
    rows = [event("e1", "shift_added", start="08:00"), event("e2", "shift_added", start="12:00"), event("e3", "shift_added", start="09:00"), event("e4", "shift_removed", "t", old=full(start="07:00", end="08:00", city="Ekby"), new=False), event("e5", "shift_time_changed", "u", old=full(start="09:00", end="11:00")), event("e1", "shift_added", start="08:00"), event("", "shift_added", "v"), event(None, "shift_added", "v")]
    df = spark.createDataFrame(rows, f"event_id string, user_id bigint, schedule_date date, event_type string, location_fingerprint string, customer_fingerprint string, old_value {STRUCT}, new_value {STRUCT}, source_session_id string, detected_at timestamp")
    told = {r.source_session_id: r for r in notify.build_notifications(df, today=F.lit(DAY)).collect()}
    assert told["s"].notification_type == "summary" and told["s"].event_ids == ["e1", "e3", "e2"] and told["s"].message == "3 shifts updated for today"
    assert told["t"].message == "Shift removed today 07:00–08:00 in Ekby" and told["u"].message == "Today Ekby shift moved 09:00 → 10:00"
    assert told["v"].event_ids == [""] and len(told) == 4
    seen = spark.createDataFrame([("e4",), ("e5",)], "event_id string")
    again = notify.build_notifications(df, seen=seen)
    assert {r.source_session_id for r in again.collect()} == {"s", "v"}
    names = spark.createDataFrame([("v", ["1.png", "2.png"])], "session_id string, names array<string>")
    assert {r.message for r in notify.with_image_names(notify.with_image_names(again, names), names).collect()} == {"3 shifts updated for on 2025-03-04", "New shift added on 2025-03-04 10:00–11:00 in Ekby (images: 1.png, 2.png)"}
    with pytest.raises(ValueError):
        notify.build_notifications(df, 0)
    assert shift()["start"] == "08:00"


# stream


def test_idle_sessions_stream(spark, tmp_path):
    from rotaloom.streaming.idle import each_batch, idle_sessions

    source, out = tmp_path / "in", []
    at = datetime(2025, 1, 1)
    batches = [[("a", at), ("a", at + timedelta(seconds=5)), (None, at)], [("b", at + timedelta(seconds=60))], [("c", at + timedelta(seconds=200))], [("c", at + timedelta(seconds=201))]]
    schema = "session_id string, created_at timestamp"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"n={n}"))
    stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = each_batch(idle_sessions(stream.select("session_id", "created_at")), lambda batch, _: out.extend(tuple(r)[:2] for r in batch.collect()), str(tmp_path / "state"), "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(out) == [("a", 2), ("b", 1)]


# sources, stores and the whole way


def test_payload_files(spark, tmp_path):
    import json

    from rotaloom.sources import payloads

    for name, body in {"a.json": json.dumps({"schedule_date": "2025-01-02", "entries": [{"start": "9.5", "end": "10:00", "title": " b ", "location": "åsa-vägen 66a"}, {"start": "09:05", "end": "10 00", "title": "A", "location": "x"}]}), "b.json": "{oops", "c.json": "[1]", "d.json": '{"entries": [{"start": "8"}]}'}.items():
        (tmp_path / name).write_text(body)
    got = {r.path[-6]: r for r in payloads.read_payloads(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": "invalid JSON", "c": "not an object", "d": None}
    rows = payloads.read_payloads(spark, str(tmp_path)).where("error is null")
    assert [tuple(r)[2:] for r in payloads.payload_entries(rows, ["path"]).where("path like '%d.json'").collect()] == [("8", "", "", "", "")]
    normal = {r.path[-6]: r for r in rows.select("path", F.inline(F.array(payloads.normalized_payload(F.col("payload.entries"))))).collect()}
    assert [tuple(e) for e in normal["a"].entries] == [("09:05", "10:00", "A", "X"), ("09:05", "10:00", "b", "Åsa-Vägen 66A")] and normal["d"].error == "start" and normal["d"].entries is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        payloads.read_payloads(spark, str(tmp_path / "none"))
    snap = spark.createDataFrame([("[]",), ("{}",), ("[{",), ('[{"start": "08:00"}]',), ("[null]",)], "t string")
    assert [r.error for r in snap.select(F.inline(F.array(payloads.read_snapshot(F.col("t"))))).collect()] == [None, "no array", "invalid JSON", "end", "no object"]


def test_objects_and_boxes(spark, tmp_path):
    from rotaloom.sources import payloads

    (tmp_path / "one.png").write_bytes(b"ab c")
    images = payloads.read_objects(spark, str(tmp_path), "*.png").select(F.lit("i").alias("image_id"), "content")

    def make():
        return lambda body: [(w.decode(), 0.5, float(n), 0.0, 1.0, 1.0) for n, w in enumerate(body.split())]

    assert [(r.box_seq, r.text, r.x) for r in payloads.extract_boxes(images, make).collect()] == [(0, "ab", 0.0), (1, "c", 1.0)]
    pages = spark.createDataFrame([("p", [{"poly": [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]], "rec": {"text": "t", "score": 0.9}}, {"poly": [[0.0, 0.0]], "rec": {"text": "u", "score": 0.9}}, {"poly": None, "rec": None}])], "image_id string, records array<struct<poly:array<array<double>>,rec:struct<text:string,score:double>>>")
    assert [(r.box_seq, r.text, r.w, r.h) for r in payloads.legacy_boxes(pages).collect()] == [(0, "t", 4.0, 2.0)]


def test_store(spark, tmp_path):
    from rotaloom.operators import store

    rows = spark.createDataFrame([(1, "open", None), (2, "done", "x"), (3, None, None)], "id int, state string, error string")
    got = {r.id: r for r in store.guarded_update(rows, F.col("state") == "open", state=F.lit("failed"), error=F.col("state")).collect()}
    assert tuple(got[1]) == (1, "failed", "open", True) and tuple(got[2]) == (2, "done", "x", False) and tuple(got[3]) == (3, None, None, False)
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (None, 1, "n"), (None, 2, "m")], "k int, t int, v string")
    assert store.append_log(path, batch, ["k"], ["t"]) == 2 and store.append_log(path, batch, ["k"], ["t"]) == 0
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["a", "n"]
    state = str(tmp_path / "state")
    assert store.write_state(state, batch, ["k"], ["t"]) == 2 and store.write_state(state, batch, ["k"], ["t"]) == 0
    assert store.write_state(state, spark.createDataFrame([(1, 9, "z"), (None, 1, "old")], batch.schema), ["k"], ["t"]) == 1
    assert {r.k: r.v for r in store.read_state(spark, state, batch.schema, ["k"], ["t"]).collect()} == {1: "z", None: "m"}


def test_from_boxes_to_messages_and_a_rerun(spark, tmp_path):
    from rotaloom.plans.pipeline import observed_states, pending_messages, store_run

    def shot(image, start, end):
        return [(image, t, 20.0, float(y), 200.0, 20.0) for t, y in (("Måndag 2 juni 2025", 0), (f"{start} - {end}".replace(" ", ""), 100), ("Anna Berg Hemstädning", 130), ("Storgatan 5 411 11", 160), ("Göteborg", 190))]

    boxes = spark.createDataFrame(shot("i1", "08:00", "10:00") + shot("i2", "08:00", "10:00") + shot("i3", "09:00", "11:00"), "image_id string, text string, x double, y double, w double, h double")
    at = lambda h: datetime(2025, 6, 1, h)
    images = spark.createDataFrame([("i1", "s1", 1, 7, at(1)), ("i2", "s1", 2, 7, at(1)), ("i3", "s2", 1, 7, at(2)), ("i9", "s9", 1, 7, at(3))], "image_id string, session_id string, sequence int, user_id bigint, created_at timestamp")
    states = observed_states(boxes, images)
    got = {r.source_session_id: r for r in states.collect()}
    assert len(got["s1"].snapshot_payload) == 1 and got["s2"].snapshot_payload[0].start == "09:00" and got["s9"].error == "no date" and got["s9"].snapshot_payload is None
    told = [r.message for r in pending_messages(states).orderBy("source_session_id").collect()]
    assert len(told) == 2 and told[0].startswith("New shift added on 2025-06-02 08:00–10:00") and "shift moved 08:00–10:00 → 09:00–11:00" in told[1]
    assert store_run(str(tmp_path), states) == {"events": 2, "states": 1, "messages": 2}
    assert store_run(str(tmp_path), states) == {"events": 0, "states": 0, "messages": 0}


def test_work_needs_a_shared_folder_off_one_machine():
    from types import SimpleNamespace

    from rotaloom.session import _work_folder

    far = lambda folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master="yarn", applicationId="a1"))
    assert _work_folder(far("hdfs://x/")) == "hdfs://x/rotaloom-a1"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _work_folder(far(""))


def test_scratch_leaves_no_tables(spark):
    import os

    from rotaloom.session import cut_lineage, scratch

    with scratch(spark):
        made = cut_lineage(spark.range(3)).inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert os.path.exists(made)
    assert not os.path.exists(made)


def test_a_quiet_stream_closes_its_last_sessions(spark, tmp_path):
    import time

    source = str(tmp_path / "in")
    spark.createDataFrame([("s1", datetime(2025, 1, 1, 8)), ("s2", datetime(2025, 1, 1, 9))], "session_id string, created_at timestamp").write.parquet(source)
    got = idle.idle_sessions(spark.readStream.schema("session_id string, created_at timestamp").parquet(source), idle_seconds=1, clock="processing")
    query = got.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    for _ in range(80):
        if spark.table("quiet").count() == 2:
            break
        time.sleep(0.5)
    query.stop()
    assert {(r.session_id, r.images) for r in spark.table("quiet").collect()} == {("s1", 1), ("s2", 1)}


def test_keys_of_python_and_jvm_agree(spark):
    import pandas as pd
    from conftest import SMALL

    from rotaloom.functions import identity

    rows = pd.read_parquet(f"{SMALL}/canonical_shift.parquet").fillna("").drop_duplicates("shift_id")
    seen = spark.createDataFrame(rows[["shift_id", "customer_name", *aggregate.ADDRESS]])
    x = F.struct(*aggregate.ADDRESS)
    made = seen.select("shift_id", identity.customer_key(F.col("customer_name")).alias("c"), identity.location_key(F.col("street"), F.col("street_number"), F.col("postal_area"), F.col("city")).alias("l"), aggregate.address_quality(x).alias("q")).toPandas().set_index("shift_id")
    for r in rows.to_dict("records"):
        own = made.loc[r["shift_id"]]
        assert (own.c, own.l, own.q) == (aggregate._customer(r["customer_name"]), aggregate._location(r), aggregate._quality(r)[0])
