import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pandas as pd
from conftest import SMALL
from test_intervals import clock

from rotaloom.operators.snapshots import key_ordinals, snapshot_changes
from rotaloom.plans.problems import p4_found

FIELDS = ["start", "end", "customer_name", "customer_fingerprint", "street", "street_number", "postal_code", "postal_area", "city", "location_fingerprint", "shift_type", "raw_type_label"]
SCHEMA = "snapshot_id bigint, user_id bigint, schedule_date date, snapshot_payload array<struct<" + ",".join(f"`{f}`:string" for f in FIELDS) + ">>, updated_at timestamp, extra string"


def plain(x):
    return " ".join((x or "").split()).lower()


def norm(x):
    t = lambda v: v if (m := clock(v)) is None else str(m)
    return (plain(x["location_fingerprint"]), plain(x["customer_fingerprint"]), plain(t(x["start"])), plain(t(x["end"])), plain(x["shift_type"]))


def compare(old, new):
    """By the words of the task, where keys occur once; repeated keys are paired by nearest times."""
    old, new, out = set(old), set(new), set()
    old, new = old - new, new - old
    keys = {x[:2] for x in old} & {x[:2] for x in new}
    for key in keys:
        o, n = sorted(x for x in old if x[:2] == key), sorted(x for x in new if x[:2] == key)
        for x in list(n):
            if same := [y for y in o if y[2:4] == x[2:4]]:
                out.add(("shift_reclassified", *key))
                for z in same:
                    o.remove(z), old.discard(z)
                n.remove(x), new.discard(x)
        num = lambda v: int(v) if v.isdigit() else 10**6
        pairs = sorted((abs(num(a[2]) - num(b[2])) + abs(num(a[3]) - num(b[3])), a, b) for a in o for b in n)
        for _, a, b in pairs:
            if a in old and b in new:
                out.add(("shift_time_changed", *key))
                old.discard(a), new.discard(b)
    for kind, at in (("shift_relocated", (1, 2, 3)), ("shift_retitled", (0, 2, 3))):
        for x in sorted(new):
            if mate := next((y for y in sorted(old) if [y[i] for i in at] == [x[i] for i in at]), None):
                out.add((kind, *x[:2]))
                old.discard(mate), new.discard(x)
    return out | {("shift_added", *x[:2]) for x in new} | {("shift_removed", *x[:2]) for x in old}


def brute(rows):
    """rows: snapshot_id, user, date, payload, updated_at."""
    days = defaultdict(dict)
    for sid, user, day, payload, at in rows:
        if payload is not None:
            days[user, day][at, sid] = [norm(x) for x in payload if x is not None]
    out = set()
    for states in days.values():
        ordered = sorted(states.items())
        for (_, old), ((_, sid), new) in zip(ordered, ordered[1:]):
            out |= {(sid, *x) for x in compare(old, new)}
    return out


def shift(loc="l", cust="c", start="08:00", end="09:00", kind="WORK"):
    return dict.fromkeys(FIELDS) | {"location_fingerprint": loc, "customer_fingerprint": cust, "start": start, "end": end, "shift_type": kind}


def changes(spark, *states):
    rows = [(i, 1, date(2025, 1, 1), s, datetime(2025, 1, 1) + timedelta(hours=i), "x") for i, s in enumerate(states)]
    return Counter(tuple(r)[2:] for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect())


def test_kinds(spark):
    assert changes(spark, [shift()], [shift(start="8.00 ", kind="work")]) == {}
    assert changes(spark, [shift()], [shift(end="10:00")]) == {(1, "shift_time_changed", "l", "c"): 1}
    assert changes(spark, [shift()], [shift(kind="BREAK")]) == {(1, "shift_reclassified", "l", "c"): 1}
    assert changes(spark, [shift()], [shift(loc="m")]) == {(1, "shift_relocated", "m", "c"): 1}
    assert changes(spark, [shift()], [shift(cust="d")]) == {(1, "shift_retitled", "l", "d"): 1}
    assert changes(spark, [shift()], [shift(loc="m", cust="d")]) == {(1, "shift_added", "m", "d"): 1, (1, "shift_removed", "l", "c"): 1}
    assert changes(spark, [shift()], None, [shift(), None, shift()]) == {}
    assert changes(spark, [shift()], [], [shift(None, "")]) == {(1, "shift_removed", "l", "c"): 1, (2, "shift_added", "", ""): 1}
    assert changes(spark, [shift(start="08:00"), shift(start="12:00", end="13:00")], [shift(start="12:30", end="13:00")]) == {(1, "shift_time_changed", "l", "c"): 1, (1, "shift_removed", "l", "c"): 1}
    assert changes(spark) == {} and changes(spark, [shift()]) == {}


def test_many_keys_use_several_words(spark):
    a = [shift(f"l{i:03}", "c") for i in range(200)]
    b = [shift(f"l{i:03}", "c") for i in range(0, 300, 2)]
    assert set(changes(spark, a, b)) == {(1, *x) for x in compare([norm(x) for x in a], [norm(x) for x in b])}


def test_random_states(spark):
    random.seed(11)
    rows = []
    for i in range(60):
        pick = lambda: shift(random.choice("lm"), random.choice("cde"), f"{random.randint(8, 9):02}:00", f"{random.randint(10, 11)}:00", random.choice(["WORK", "WORK", "BREAK"]))
        payload = random.choice([None, [], [pick()], [pick() for _ in range(2)], [pick() for _ in range(3)]])
        if payload:  # one element a key, where the words of the task are unambiguous
            payload = list({(x["location_fingerprint"], x["customer_fingerprint"]): x for x in payload}.values())
        rows.append((i, random.choice([1, 2, None]), random.choice([date(2025, 1, 1), None]), payload, datetime(2025, 1, 1) + timedelta(minutes=random.randint(0, 40)), "x"))
    rows += rows[:9]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r)[2:] for r in got} == brute([r[:5] for r in rows])
    assert len(got) == len({tuple(r) for r in got})


def test_ordinals_last(spark):
    """Numbers given once stay when snapshots come later, and the differences are those found without a table."""
    random.seed(12)
    rows = []
    for i in range(40):
        payload = [shift(random.choice("lmn"), random.choice("cdef")) for _ in range(random.randint(0, 4))]
        rows.append((i, random.choice([1, None]), date(2025, 1, 1), payload, datetime(2025, 1, 1) + timedelta(minutes=i), "x"))
    early, whole = spark.createDataFrame(rows[:15], SCHEMA), spark.createDataFrame(rows, SCHEMA)
    told = lambda t: {(r.user_id, r.schedule_date, r["loc"], r.cust): r.ordinal for r in t.collect()}
    first, later = key_ordinals(early), key_ordinals(whole, key_ordinals(early))
    assert told(first).items() <= told(later).items() and len(set(map(str, told(later)))) == len(told(later))
    for user in (1, None):
        own = sorted(o for (u, *_), o in told(later).items() if u == user)
        assert own == list(range(len(own)))
    assert {tuple(r) for r in snapshot_changes(whole, later).collect()} == {tuple(r) for r in snapshot_changes(whole).collect()} != set()
    assert key_ordinals(early.limit(0)).count() == 0


def test_p4_found(spark):
    t = pd.read_parquet(f"{SMALL}/day_snapshot.parquet")
    rows = [(r.snapshot_id, r.user_id, r.schedule_date, None if r.snapshot_payload is None else list(r.snapshot_payload), r.updated_at) for r in t.itertuples()]
    assert {tuple(r) for r in p4_found(spark, SMALL).collect()} == brute(rows)
