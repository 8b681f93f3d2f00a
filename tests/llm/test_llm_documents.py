"""Leakage and personal information."""

import re

import numpy as np
import pandas as pd
from conftest import SMALL

from rotaloom.llm import leakage, personal
from rotaloom.llm.leakage import leaked_items, readable, retold_items
from rotaloom.llm.personal import decode, find, log_partition, replace, score, trained
from rotaloom.llm.personal_training import sentences

ITEM = "When the duposkite valve closes, damp pressure in the russabgralite chamber rises by 31 units until the gralkorian alarm sounds."
WEIGHTS = dict(trained())


def test_readable():
    text = "\\newcommand{\\zv}{chamber}\nWhen \\emph{the} dupos-\nkite~valve {\\bf closes,} damp\\cite{a2000} pres\\-sure in\n%% THE russabgralite \\zv{} ri{s}es\\footnotemark{} by 31 units"
    assert " ".join(re.findall(r"\w+", readable(text))[-16:]).endswith("the duposkite valve closes damp pressure in the russabgralite chamber rises by 31 units")
    assert readable("ﬁbres Desir\\'ee {\\AA}se \\\"Osten r\\\"onne") == "fibres desirée åse östen rönne"
    assert readable("") == ""


def test_word_hashes_do_not_depend_on_the_batch():
    a, _, _ = leakage.words(["one two 33"])
    b, number, owner = leakage.words(["x", "one two 33", ""])
    assert (a == b[1:]).all() and number.tolist() == [False, False, False, True] and owner.tolist() == [0, 1, 1, 1]
    assert len(np.unique(leakage.words(["ab ba a b abc"])[0])) == 5


def leaks(spark, documents, items):
    d = spark.createDataFrame(documents, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = leaked_items(d, i).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_leaks(spark):
    words = ITEM.split()
    part = " ".join(words[3:15])
    other = ITEM.replace("31", "32").replace("damp", "cold")
    documents = [(1, "Before. " + ITEM, "x"), (2, part.upper(), "x"), (3, " ".join(words[3:14]), "x"), (4, other, "x"), (5, None, "x"), (6, "", "x"), (7, "fill " * 50_000 + part, "x"), (8, part.replace("chamber", "cham-\n% ber"), "x"), (None, ITEM, "x")]
    items = [(10, ITEM, "y"), (11, "short text", "y"), (12, None, "y"), (13, "Extra words here. " + ITEM, "y")]
    assert leaks(spark, documents + documents[:3], items + items[:1]) == {(d, i) for d in (1, 2, 7, 8) for i in (10, 13)}
    assert leaks(spark, documents, items[1:3]) == set() and leaks(spark, [], items) == set() and leaks(spark, documents, []) == set()


def test_many_items_and_few_bits_lose_nothing(spark):
    d = spark.createDataFrame([(1, ITEM), (2, "nothing " * 20)], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, f"{ITEM} number {k}") for k in range(5)], "item_id bigint, text string")
    assert {tuple(r) for r in leaked_items(d, i, most_bits=15).collect()} == {(1, k) for k in range(5)}


def test_retold_questions(spark):
    """Other numbers and names are found, torn templates and the very words of an item are not."""
    ask = "A train with {a} wagons leaves {n} at noon and returns to {m} with {b} wagons before the clock strikes nine in the old tower of {n}"
    item = ask.format(a=12, n="Korvalstad", m="Bremvik", b=12)
    fillers = [(k, f"A train with {k} lamps leaves {x} at noon and returns to the old tower before the clock strikes nine wagons in of") for k, x in enumerate(("qa", "qb", "qc", "qd"), 50)]
    documents = [
        (1, "Solve this. " + ask.format(a=77, n="Ostrel", m="Vimme", b=77)), (2, item), (3, ask.format(a=77, n="Ostrel", m="Vimme", b=78)),  # 3: wagons don't return
        (4, ask.format(a="many", n="Ostrel", m="Vimme", b="many")), (5, None), (6, "words " * 40),
    ]
    d = spark.createDataFrame(documents, "doc_id bigint, text string")
    i = spark.createDataFrame([(10, item), (11, ask.format(a=3, n="Lund", m="Kil", b=3)), *fillers], "item_id bigint, text string")
    got = {r.doc_id: r for r in retold_items(d, i, share=0.3).collect()}
    assert 1 in got and got[1].item_id == 10 and got[1].windows >= 4 and not {2, 4, 5, 6} & set(got)
    assert got[1].windows > (got[3].windows if 3 in got else 0)
    assert retold_items(d, i.limit(0)).count() == 0 and retold_items(d.limit(0), i).count() == 0


def test_retold_questions_lose_no_pair(spark):
    """Windows shared with other items count for each, equal values may differ in the item, parts without
    placeholders may be the same, and each item of a class can be asked for."""
    start = "a farmer carries {a} baskets of apples to the market and sells {b} jars of honey before noon"  # seven windows
    rest = " while a second farmer waits at the gate with {c} empty carts until the evening bell has rung"
    plain = " and then both of them walk home along the river without saying a single word to their old neighbours"
    other = " so that every horse of the village can drink {c} buckets of water from the deep well"
    texts = {1: (start + other).format(a=1, b=2, c=3), 2: (start + rest).format(a=4, b=5, c=6), 3: (start + plain).format(a=7, b=8), 4: (start + plain).format(a=31, b=32), 8: ("hm" + rest + other).format(c=9)}
    documents = {1: "seen: " + start.format(a=50, b=60), 2: start.format(a=50, b=50), 3: (start + plain).format(a=50, b=60), 4: texts[4], 5: (start + rest).format(a=4, b=5, c=66), 6: None}
    d = spark.createDataFrame(list(documents.items()), "doc_id bigint, text string")
    i = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(9, None)], "item_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.windows for r in retold_items(d, i, share=0.3).collect()}
    whole = {(r.doc_id, r.item_id): r.windows for r in retold_items(d, i, share=0.3, each=True).collect()}
    assert {x for x in got if x[0] < 4} == {(k, n) for k in (1, 2, 3) for n in (1, 2, 3)} and not {4, 6} & {x[0] for x in got}
    assert got[1, 1] == got[1, 2] == got[2, 2] == 7 and got[3, 3] > got[3, 1]
    assert (got[5, 2], got[5, 8]) == (9, 7) and {x[1] for x in got if x[0] == 5} == {2, 8}  # around the new number
    assert {x: n for x, n in whole.items() if x[1] != 4} == got and {x: n for x, n in whole.items() if x[1] == 4} == {(k, 4): n for (k, m), n in got.items() if m == 3}


def test_p8_equals_brute_force(spark):
    from rotaloom.llm.queries import p8_found

    split = lambda t: re.findall(r"[^\W_]+", readable(t))
    items = pd.read_parquet(f"{SMALL}/eval_item.parquet")
    grams = {}
    for i, t in zip(items.item_id, items.text):
        w = split(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in pd.read_parquet(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False):
        w = split(t or "")
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in p8_found(spark, SMALL).collect()} == want


def test_inference_equals_enumeration():
    from itertools import combinations
    from math import exp, isclose, log

    spans = [(0, 3, "name", ("a",)), (2, 5, "name", ("b",)), (5, 8, "phone", ("c",)), (0, 8, "address", ("d",)), (3, 5, "phone", ("e",))]
    weights = {"a": 1.0, "b": 1.6, "c": 0.5, "d": 2.0, "e": 0.4}
    sets = [c for n in range(6) for c in combinations(spans, n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))]
    value = lambda c: sum(score(s, weights) for s in c)
    assert set(decode(spans, weights)) == set(max(sets, key=value))
    total, p = log_partition(spans, weights)
    assert isclose(total, log(sum(exp(value(c)) for c in sets)))
    for s, q in zip(spans, p):
        assert isclose(q, sum(exp(value(c) - total) for c in sets if s in c))


def test_held_out_sentences():
    right = wanted = found = 0
    for text, gold in sentences(600, 1234):
        got = set(find(text, WEIGHTS))
        right, wanted, found = right + len(got & set(gold)), wanted + len(gold), found + len(got)
    assert right / wanted > 0.99 and right / found > 0.99


def test_names_absent_from_training():
    from rotaloom.llm import gazetteer, personal_training

    given, family = ["Beatriz", "Tomasz", "Ngozi", "Sanjay"], ["Oliveira", "Wrona", "Adeyemi", "Krishnan"]
    assert not set(given) & {*gazetteer.GIVEN, *personal_training._OTHERS} and not set(family) & set(personal_training._FAMILIES)
    right = 0
    for g in given:
        for f in family:
            for text in (f"Thanks to {g} {f} for the samples.", f"Contact {g} {f}, tel. 031-123 45 67.", f"Participant {g} {f} left the study.", f"Professor {f}, {g} stayed."[:0] or f"We thank {g} {f} for help."):
                right += [text[a:b] for a, b, k in find(text, WEIGHTS) if k == "name"] == [f"{g} {f}"]
    assert right >= 60  # of 64


def test_short_numbers_and_long_users():
    assert [t[a:b] for t in ["Ring 08-12 34 56 idag."] for a, b, _ in find(t, WEIGHTS)] == ["08-12 34 56"]
    assert find("ISSN 0317-8471 and pages 012--345 and 03-04-05", WEIGHTS) == []
    user = "a" * 300
    assert [t[a:b] for t in [f"Mail {user}@lab.example now"] for a, b, _ in find(t, WEIGHTS)] == [f"{user}@lab.example"]


def test_spans_in_source():
    text = "% ring Sn\\\"ack\\\"oga, {\\AA}se på 031--390\\,06\\,80 om figur 3\n\\author{Anna Eklund}\n\\bibitem{x} Anna Eklund and B. Eklund. Title.\n\nThe Anna Eklund theorem. Run 20190712-9875 was discarded."
    assert [(text[a:b], k) for a, b, k in find(text, WEIGHTS)] == [("Sn\\\"ack\\\"oga, {\\AA}se", "name"), ("031--390\\,06\\,80", "phone")]
    assert replace("Mail anna@lab.example now", WEIGHTS) == "Mail [EMAIL] now" and replace("", WEIGHTS) == ""
    assert find("a" * 200_000 + " 1" * 100_000, WEIGHTS) == []


def test_names_outside_the_lists():
    for text, name in [("Thanks to Hans Müller for the data.", "Hans Müller"), ("John Smith (pnr 850412-1234) left.", "John Smith"), ("We thank Beatriz Oliveira for comments.", "Beatriz Oliveira"), ("Professor Nadia Rahman kindly shared it.", "Nadia Rahman"), ("% ask T. Okafor first", "T. Okafor")]:
        assert [text[a:b] for a, b, k in find(text, WEIGHTS) if k == "name"] == [name]
    thanked = "We thank Hans Müller, Nadia Rahman and T. Okafor for help."
    assert [thanked[a:b] for a, b, _ in find(thanked, WEIGHTS)] == ["Hans Müller", "Nadia Rahman", "T. Okafor"]
    for text in ("Thanks to Monte Carlo runs and a New York office.", "The Hilbert Space method by Springer Verlag.", "The Hans Müller theorem is sharp.", "\\author{John Smith}", "Results from Random Forest are old; a random forest is usual."):
        assert find(text, WEIGHTS) == []


def test_several_numbers_in_one_run():
    phone, other = "070-123 45 67", "031-123 45 67"
    for text, want in [
        (f"{other} / {phone}", [other, phone]), (f"{other}/{phone}", [other, phone]), (f"tel. {other} {phone}", [other, phone]), (f"850412-1230 {phone}", ["850412-1230", phone]),
        (f"1. {phone}", [phone]), (f"2024-05-01 {phone}", [phone]), (f"(2) {other}", [other]), ("+46 31 390 06 28 / 070-123 45 67", ["+46 31 390 06 28", phone]),
        ("+46 (0)70-681 68 55", ["+46 (0)70-681 68 55"]), ("values 12 034 567 89 012 13", []),
    ]:
        assert [text[a:b] for a, b, _ in find(text, WEIGHTS)] == want, text


def test_long_and_broken_lists_of_users():
    users = "anna.lindqvist, erik.bergstrom, maria.sandberg, nils.ekdahl, karin.holmgren, lars.dahlberg"
    for value in (f"\\{{{users}\\}}@uni.example", "\\{k\\_lund, anna\\}@uni.example", "{anna,\n  berg}@uni.example", f"{{{users},\r\n% {users}}}@lab.uni.example", "\\{anna, berg\\}@uni.example"):
        text = f"Mail {value} {{\\bf now}}."
        assert [text[a:b] for a, b, _ in find(text, WEIGHTS)] == [value]
    assert find("{one\n\ntwo}@uni.example and }@uni.example", WEIGHTS) == [] == find("{" + "}@" * 100_000, WEIGHTS)


def test_find_and_mask_personal(spark):
    rows = [(1, "Questions go to \\{anna, berg\\}@lab.example.net.", "k"), (2, None, "k"), (3, "", "k"), (None, "tel.~+46 31 390 06 28.", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert {tuple(r)[:3] for r in personal.find_personal(df).collect()} == {(1, "email", "\\{anna, berg\\}@lab.example.net"), (None, "phone", "+46 31 390 06 28")}
    assert {r.doc_id: r.text for r in personal.mask_personal(df).collect()} == {1: "Questions go to [EMAIL].", 2: None, 3: "", None: "tel.~[PHONE]."}
    assert personal.find_personal(df.limit(0)).count() == 0
