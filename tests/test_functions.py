import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from rotaloom.functions import clock, identity, text
from rotaloom.functions.similar_words import closest, word_groups
from rotaloom.operators.entries import kind_of


def values(spark, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_accents(spark):
    words = ["Åsa-Vägen", "Sørensen", "Łódź", "①", "Café", "é", "", None, "straße", "ÀÉÎÕÜ"]
    plain = lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert values(spark, words, text.strip_accents) == [plain(w) for w in words]


def test_read_errors(spark):
    assert values(spark, ["b0b", "a1b1c", "10", "a0", "Yv0nne 10"], text.fix_read_digits) == ["bob", "aibic", "10", "a0", "Yvonne 10"]
    assert values(spark, ["BI11dal, 3|6!", "  a  b ", "Åsa's x-y"], text.clean_text) == ["Bi11dal 3l6", "a b", "Åsa's x-y"]
    assert values(spark, ["Kållered", "VÄG 1"], text.match_text) == ["kallered", "vag 1"]


def test_titles(spark):
    assert values(spark, ["åsa-vägen 66a", "o'neil x"], text.title_letters) == ["Åsa-Vägen 66A", "O'Neil X"]
    assert values(spark, ["åsa-vägen 66a", "ABC dEF"], text.title_words) == ["Åsa-vägen 66a", "Abc Def"]


def test_durations_and_counters(spark):
    assert values(spark, ["Storst 3h15m 25m  4h", "Lunch 25 min", "4h", "Rum 12"], text.strip_duration) == ["Storst", "Lunch", "", "Rum 12"]
    assert values(spark, ["Reklamation 1 3h omstadning", "Sjukdom dag 1-14", "a 5 b 20 min"], text.strip_counters) == ["Reklamation omstadning", "Sjukdom dag 1-14", "a b"]
    assert values(spark, ["• STÄDNING 3 2h", "(Lunch)!", "..."], text.type_label) == ["Städning", "Lunch", ""]


def test_names_and_places(spark):
    assert values(spark, ["anna BERG ab", "AB", "Berg 2 Anna", "Berg 123 Anna 4h"], text.customer_name) == ["Anna Berg", "Ab", "Berg Anna", "Berg 123 Anna"]
    assert values(spark, ["KÅLLERED", "Goteborg", "Ekby", ""], text.place_name) == ["Kållered", "Göteborg", "Ekby", ""]
    split = [(r.customer, r.job) for r in values(spark, ["Berg AB • Storstädning 3h", "Anna Berg Restid extra", "Anna Berg", "Lunch", ""], text.split_title)]
    assert split == [("Berg AB", "Storstädning"), ("Anna Berg", "Restid extra"), ("Anna Berg", ""), ("Lunch", ""), ("", "")]


def test_address_parts(spark):
    rows = [("Ekgatan 6A 436 57 Hovås", "", ("Ekgatan", "6A", "436 57", "Hovås", "Hovås")), ("Ekgatan 6", "Mölndal", ("Ekgatan", "6", "", "", "Mölndal")), ("Ekgatan 6 43657", "Hovås", ("Ekgatan", "6", "436 57", "Hovås", "Hovås")), ("Ekgatan 6 Västra Ekby", "", ("Ekgatan", "6", "", "", "Västra Ekby")), ("Ekgatan", None, ("Ekgatan", "", "", "", "")), (None, None, ("", "", "", "", ""))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string")
    got = df.select("i", text.address_parts(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == [want for *_, want in rows]


def test_times(spark):
    assert values(spark, ["9:05", " 23.59 ", "24:00", "9:5", "9 05", None], text.strict_time) == ["09:05", "23:59", None, None, None, None]
    assert values(spark, ["9:5", "9 05", "7.3", "25:00", "905"], text.loose_time) == ["09:05", "09:05", "07:03", None, None]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_keys(spark):
    assert values(spark, ["Anna Berglund AB", "berglund a", "AB", "", None, "Berg Ek"], identity.customer_key) == [sha("berglund|a")] * 2 + [sha("ab|")] + [sha("")] * 2 + [sha("berg|e")]
    spot = lambda c: identity.location_key(F.lit("Billdals väg"), c, F.lit(""), F.lit("Göteborg"))
    assert len(set(values(spark, ["3I6", "316", "3l6"], spot))) == 1
    assert values(spark, ["1"], spot) == [sha("bllldalsvag|l|goteborg")]
    df = spark.sql("select named_struct(" + ",".join(f"'{f}', cast({'null' if f == 'city' else repr(f)} as string)" for f in identity.SHIFT_FIELDS) + ") v")
    got = df.select(identity.canonical_json(F.col("v")).alias("o")).first().o
    assert got.startswith('{"city":null,"customer_fingerprint":"customer_fingerprint"') and " " not in got
    assert df.select(identity.value_hash(F.lit(None).cast(df.schema["v"].dataType)).alias("o")).first().o == sha("null")
    want = int.from_bytes(hashlib.sha256(b"7:x").digest()[:8], "big", signed=True)
    assert spark.range(1).select(identity.lock_key(F.lit(7), F.lit("x")).alias("o")).first().o == want


def test_clock(spark):
    rows = [(1430, 10), (600, 840), (840, 600), (720, 720)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = df.select(clock.clock_distance(F.col("a"), F.col("b")).alias("d"), clock.onward(F.col("a"), F.col("b")).alias("o"), clock.nearest_turn(F.col("b"), F.col("a")).alias("t"), clock.to_clock(F.col("a") - 1440).alias("c")).collect()
    assert [tuple(r) for r in got] == [(20, 20, 1450, "23:50"), (240, 240, 840, "10:00"), (240, 1200, 600, "14:00"), (0, 0, 720, "12:00")]
    holds = spark.range(1).select(*(clock.covers(*map(F.lit, x)).alias(str(i)) for i, x in enumerate([(600, 840, 600, 600), (1435, 30, 1430, 35), (1430, 35, 1435, 30), (600, 840, 590, 700)]))).first()
    assert list(holds) == [True, False, True, False]


def test_kinds(spark):
    assert values(spark, ["restid till kund", "lunch", "storstadning", "utbildning x", "nagot", "tjanstledig"], kind_of) == ["TRAVEL", "BREAK", "WORK", "TRAINING", "UNKNOWN", "LEAVE"]


def test_similar_words():
    assert word_groups("ab storstadning x") == ["storstadning", "ab storstadning", "storstadning x", "ab storstadning x"]
    assert closest("storstadnlng", ["lunch", "storstadning"])[1] == 1
    assert closest("bowling", ["lunch", "storstadning"]) == (0.0, -1) and closest("", ["lunch"]) == (0.0, -1)


@pytest.mark.parametrize("name", ["shift_times", "label_kinds"])
def test_whole_texts(spark, name):
    from conftest import SMALL

    from rotaloom.plans.catalogue import QUERIES

    assert QUERIES[name](spark, SMALL).count() > 100
