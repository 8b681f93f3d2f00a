"""Labels, names and their similarity join."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotaloom.llm.labels import closeness, glossary_table, map_labels, plain, stripped
from rotaloom.llm.names import compare, name_links, name_tokens, nickname_table
from rotaloom.llm.setsim import edit_join, similarity_join
from rotaloom.llm.spelling import osa, typos, unread


def test_similarity_join_equals_brute_force(spark):
    random.seed(3)
    rows = [(random.choice("ab"), i, random.sample("abcdefghijklmnop", random.randint(0, 9)) + random.choice([[], [None]])) for i in range(120)]
    rows += [("a", 500 + i, ["hot", "x" + str(i)]) for i in range(40)] + [("b", 999, None)]
    df = spark.createDataFrame(rows + rows[:20], "k string, id int, tokens array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for k, i, a in rows:
            for k2, j, b in rows:
                x, y = {w for w in a or [] if w}, {w for w in b or [] if w}
                if k == k2 and x and y and len(x & y) / len(x | y) >= t - 1e-9:
                    want[k, i, j] = len(x & y) / len(x | y)
        got = similarity_join(df, df, ["k"], t).collect()
        assert {tuple(r)[:3]: pytest.approx(r.jaccard) for r in got} == want and len(got) == len(want)
        own = similarity_join(df, None, ["k"], t).collect()
        assert {tuple(r)[:3] for r in own} == {x for x in want if x[1] < x[2]} and len(own) == len(set(own))


def test_edit_distance():
    assert [osa("abc", b, 2) for b in ("abc", "acb", "ab", "xyz", "abcdef")] == [0, 1, 1, 3, 3]
    assert typos("b1rgitta", "birgitta", 1) == 0 and typos("guni1la", "gunilla", 1) == 0
    assert unread("Yv0nne HumIetorpe 10") == "Yvonne Humletorpe 10"


def test_label_rules():
    assert stripped(" •  Typ: Golvvård 3h15m ?") == "Golvvård" and stripped("Jobb – Matr. (ny)") == "Matr."
    assert plain("VECKO-STÄDNING...") == "veckostadning"
    for label in ("veckost.", "veckstadning", "veckosatdning", "veckostadn", "vecko stadning", "veckostadning"):
        assert closeness(label, "veckostadning") > 0, label
    for label in ("kvartalsbokslut", "asdf", "xx", "", "bowling"):
        assert closeness(label, "veckostadning") == 0, label


def test_map_labels_edges(spark):
    entries = spark.createDataFrame([(1, "Golvvård", "x"), (2, "Matrast", "y"), (2, "Matrast", "y"), (None, "Nix", None), (9, None, None)], "entry_id int, entry string, form string")
    long = "Golvvård " + "abcdefghijklmnopqrstuvxyz " * 4_000
    values = [("GOLVVARD 4h", 1), ("golv bonvax", 1), ("Matr.", 2), ("Bowling", 0), ("?", 0), ("", 0), (long, 0)]
    df = spark.createDataFrame([(v, "z") for v, _ in values] * 2 + [(None, None)], "value string, entry_id string")
    got = {r.value: r.entry_id for r in map_labels(df, entries).collect()}
    assert got == dict(values)
    assert {r.entry_id for r in map_labels(df, entries.limit(0)).collect()} == {0}
    assert map_labels(df.limit(0), entries).count() == 0


def test_labels_and_words_that_no_list_holds(spark):
    entries = spark.createDataFrame([(1, "Solcellsmontage"), (2, "Bastuskötsel"), (3, "Ridlektion")], "entry_id int, entry string")
    values = {"montage av solceller": 1, "skötsel av bastu": 2, "Solcellsmnotage": 1, "Ridlekt.": 3, "riding lesson": 0, "Sophämtning": 0}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert {r.value: r.entry_id for r in map_labels(df, entries).collect()} == values
    own = glossary_table(df, {"riding": "rid", "lesson": "lektion"})
    assert {r.value: r.entry_id for r in map_labels(df, entries, own).collect()} == {**values, "riding lesson": 3}


def test_the_plan_of_labels_stays_small(spark):
    """The driver holds a plan of its joins again for each of their changes: they are queries of their own."""
    entries = spark.createDataFrame([(1, "Golvvård")], "entry_id int, entry string")
    mapped = map_labels(spark.createDataFrame([("golvvard",)], "value string"), entries)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 20, plan.count("Exchange")
    assert [(r.entry_id, r.score) for r in mapped.collect()] == [(1, 1.0)]


def test_short_abbreviations_and_typos_are_candidates(spark):
    entries = spark.createDataFrame([(1, "Instruktörsutbildning"), (2, "Graffitiborttagning"), (3, "Utvecklingssamtal"), (4, "Flyttstädning"), (5, "Matrast"), (6, "Golvvård")], "entry_id int, entry string")
    values = {"Instr.": 1, "Graff.": 2, "Utv.": 3, "U.saml.": 0, "I.utb.": 1, "Flyyts...": 4, "amtrats": 5, "oglvvrad": 6, "Bowling": 0}
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert {r.value: r.entry_id for r in map_labels(df, entries).collect()} == values


def kind(a, b):
    ta, tb = name_tokens(a), name_tokens(b)
    return compare(list(ta), [5.0] * len(ta), list(tb), [5.0] * len(tb))[0]


def test_name_rules():
    for a, b in [("Göran Vingestråle", "Vingestråle, Göran"), ("Göran Vingestråle", "Göran Vngestrål"), ("Noomi Tornfelt", "NoomiTornfelt"), ("V. Quillquarn", "Viktoria Quillquarn"), ("Fyrtornets Kont.hotell", "Fyrtornets Kontorshotell AB"), ("Fyrbåk Kons.", "Fyrbåk Konsult HB"), ("Ulrika Fagerstråle hund!", "ULRIKA FAGERSTRÅLE")]:
        assert kind(a, b) in ("full", "same"), (a, b)
    assert kind("Fru Trastquarn", "Josefina Trastquarn") == "a_in_b"
    for a, b in [("Lennart Skarvtorpe", "Viktoria Skarvtorpe"), ("Kopparsmed Konsult AB", "Kopparsmed Tandvård HB"), ("L. Skarvtorpe", "Viktoria Skarvtorpe"), ("?", "Anna Berg"), ("", "")]:
        assert kind(a, b) == "", (a, b)


def test_nicknames_and_the_surname_ek(spark):
    rows = [(1, "Bob Ek"), (1, "Robert Ek"), (2, "Pluttan Sjöö"), (2, "Petronella Sjöö"), (3, "Kalle Ek"), (3, "Kalle"), (4, "Fyren ek. för."), (4, "Fyren")]
    df = spark.createDataFrame(rows, "scope int, name string")
    pairs = lambda got: {(r.name_a, r.name_b) for r in got.collect()}
    assert name_tokens("Kalle Ek") == ("kalle", "ek")
    assert pairs(name_links(df)) == {("Bob Ek", "Robert Ek"), ("Kalle", "Kalle Ek"), ("Fyren", "Fyren ek. för.")}
    own = nickname_table(df, {"Pluttan": "Petronella"})
    assert pairs(name_links(df, own)) == {("Petronella Sjöö", "Pluttan Sjöö"), ("Kalle", "Kalle Ek"), ("Fyren", "Fyren ek. för.")}


def test_names_run_together_with_typos(spark):
    rows = [(1, "Elisaabet Isoprydh"), (1, "ElisabetIsoprydh"), (1, "Nils Isoprydh")]
    got = name_links(spark.createDataFrame(rows, "scope int, name string")).collect()
    assert [(r.name_a, r.name_b) for r in got] == [("Elisaabet Isoprydh", "ElisabetIsoprydh")]


def test_edit_join_finds_all_within_the_edits(spark):
    random.seed(11)
    most = lambda n: 1 if n < 6 else 2
    words = {"".join(random.choice("abcde") for _ in range(random.randint(3, 9))) for _ in range(150)} | {"a" * 9}
    got = edit_join(spark.createDataFrame([(w,) for w in words], "id string"), None, [], lambda w: F.when(F.length(w) < 6, 1).otherwise(2)).collect()
    met = {frozenset(r) for r in got}
    assert len(met) == len(got)
    rich = lambda w: len({w[i : i + 2] for i in range(len(w) - 1)}) + 2 > 3 * most(len(w))
    assert all(frozenset((a, b)) in met for a in words for b in words if a < b and rich(a) and rich(b) and osa(a, b, 2) <= most(min(len(a), len(b))))


def test_name_links_edges(spark):
    names = ["Anna Berglund", "anna  berglund", "Berglund, Anna", "A. Berglund", "Fru Norrby", "Eva Norrby", "Olof Norrby", "?", "", None, "Anna " * 4000]
    rows = [(1, n, "x") for n in names] * 2 + [(2, "Anna Berglund", "x"), (None, "Anna Berglund", "x"), (None, "anna berglund", "x")]
    df = spark.createDataFrame(rows, "scope bigint, name string, name_a string")
    got = {(r.scope, r.name_a, r.name_b) for r in name_links(df).collect()}
    same = sorted(names[:4])
    assert got == {(1, a, b) for i, a in enumerate(same) for b in same[i + 1 :]}
    assert name_links(df.limit(0)).count() == 0


def test_names_that_share_only_their_commonest_word(spark):
    hot = [(9, f"{g} Andersson") for g in ("Berit", "Doris", "Ester", "Gerda", "Hedda", "Irma")]
    rows = hot + [(1, "Fru Andersson"), (1, "Anna Karin Andersson"), (1, "A. K. Andersson"), (2, "Lyktans"), (2, "Lykatn Transport AB"), (3, "Fyrbåk Kosn."), (3, "Fyrbåk Konsult HB")]
    got = {(r.scope, r.name_a, r.name_b) for r in name_links(spark.createDataFrame(rows, "scope int, name string")).collect()}
    assert got == {(1, "Anna Karin Andersson", "Fru Andersson"), (1, "A. K. Andersson", "Fru Andersson"), (1, "A. K. Andersson", "Anna Karin Andersson"), (2, "Lykatn Transport AB", "Lyktans"), (3, "Fyrbåk Konsult HB", "Fyrbåk Kosn.")}


def test_a_large_scope_emits_no_pairs_of_strangers(spark):
    rows = [(1, f"Anna {a}{b}") for a in ("Berg", "Lind", "Ek", "Sten", "Ros", "Alm") for b in ("hjelm", "quarn", "torpe", "klintz", "bolander")]
    df = spark.createDataFrame(rows, "scope int, name string")
    assert name_links(df).count() == 0


def test_p2_and_p5_are_sound(spark):
    from conftest import SMALL

    from rotaloom.llm.queries import p2_found, p5_found

    shifts = pd.read_parquet(f"{SMALL}/canonical_shift.parquet")
    pairs = p2_found(spark, SMALL).collect()
    known = set(zip(shifts.user_id, shifts.customer_name))
    assert pairs and len(pairs) == len(set(pairs))
    assert all(r.name_a < r.name_b and (r.user_id, r.name_a) in known and (r.user_id, r.name_b) in known for r in pairs)
    labels = pd.read_parquet(f"{SMALL}/job_label.parquet").set_index("label").label_id
    found = {r.shift_id: r.label_id for r in p5_found(spark, SMALL).collect()}
    written = shifts[shifts.raw_type_label.fillna("").str.strip() != ""]
    assert set(found) == set(written.shift_id)
    assert all(found[i] == labels[x] for i, x in zip(written.shift_id, written.raw_type_label) if x in labels)
    assert F is not None
