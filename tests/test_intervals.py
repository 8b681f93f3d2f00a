import random
import re
from collections import defaultdict

import pandas as pd
from conftest import SMALL
from pyspark.sql import functions as F

from rotaloom.functions.timeofday import minutes_of_day
from rotaloom.operators.intervals import interval_coverage
from rotaloom.plans.problems import p1_found


def brute(rows):
    days = defaultdict(set)
    for key, s, e in rows:
        if s is not None and e is not None and s < e:
            days[key].add((s, e))
    out = set()
    for key, spans in days.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def clock(text):
    """An independent reading of the notations."""
    if text is None:
        return None
    text = re.sub(r"^kl\s*", "", text.strip().lower())
    digits = re.sub(r"\D", "", text)
    if len(digits) == 6:
        digits = digits[:4]
    if not re.fullmatch(r"[\d:. ]+", text) or len(digits) not in (3, 4):
        return None
    value = int(digits[:-2]) * 60 + int(digits[-2:])
    return value if int(digits[-2:]) < 60 and value <= 1440 else None


def test_times(spark):
    texts = {"09:05": 545, "9.05": 545, " 0905 ": 545, "09 05": 545, "09:05:00": 545, "kl 9.05": 545, "24:00": 1440, "00:00": 0, "24:01": None, "8:": None, "kl": None, "12:75": None, "heldag": None, "": None, "8": None, None: None, "--:--": None, " 07:30": 450}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.m for r in df.select("t", minutes_of_day(F.col("t")).alias("m")).collect()} == texts


def test_brute_force(spark):
    random.seed(4)
    rows = [(random.choice(["a", "b", None, "hot", "hot", "hot"]), random.randint(0, 60), None) for _ in range(300)]
    rows = [(k, s, random.choice([None, s, s + random.randint(1, 9)])) for k, s, _ in rows] + [("far", -7, 2_000)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "k string, s int, e int")
    want = brute(rows)
    for block in (None, 1, 7, 1000):
        got = interval_coverage(df, {"k": F.col("k")}, F.col("s"), F.col("e"), block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want), block
    assert interval_coverage(df.limit(0), {"k": F.col("k")}, F.col("s"), F.col("e")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5, 9, 0, 0, "x")], "kind int, start int, end int, _t int, _d int, _s string")
    got = interval_coverage(df, {"key": F.col("kind")}, F.col("start"), F.col("end")).collect()
    assert [tuple(r) for r in got] == [(1, "period", 5, 9)]


def test_p1_found(spark):
    shifts = pd.read_parquet(f"{SMALL}/canonical_shift.parquet")
    rows = []
    for u, d, s, e in zip(shifts.user_id, shifts.schedule_date, shifts.shift_start, shifts.shift_end):
        s, e = clock(s), clock(e)
        if pd.notna(d) and s is not None and e is not None:
            rows.append(((u, str(d)), s, e + 1440 if e < s else e))
    got = p1_found(spark, SMALL).collect()
    assert {((r.user_id, r.schedule_date), r.kind, r.start_min, r.end_min) for r in got} == brute(rows)
    assert len(got) == len(set(got))
