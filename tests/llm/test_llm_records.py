"""Survivors, places, components and packing."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from rotaloom.llm.components import components
from rotaloom.llm.packing import counter, example_sizes, fill, pack, token_counts
from rotaloom.llm.places import parse_address, place, place_links, street_forms
from rotaloom.llm.survivors import aligned, consensus_values, real, survivors


def test_components_equal_brute_force(spark):
    random.seed(5)
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
    linked = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    df = spark.createDataFrame(links + links[:9], "a bigint, b bigint")
    assert {r.node: r.root for r in components(df).collect()} == {x: top(x) for x in linked}
    assert components(df.limit(0)).count() == 0


def test_real_values(spark):
    yes = ["Anna", "12", "6B", "497 64", "0 12", "11", "Tomten", "Ingenjör"]
    no = [None, "", " ", "?", "???", "-", "–", "_", "*", "...", "#", "null", "None", "N/A", "n/a", "xxx", "tbd", "Okänd", "ingen uppgift", "000 00", "99999", "Anna...", "Veck …"]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert {r.v: r.ok for r in df.select("v", real(F.col("v")).alias("ok")).collect()} == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def votes(values, ids):
    """The closest value by the words of the docstring, in plain loops, for records of equal weight."""
    total, rank = {}, {}
    for v, i in zip(values, ids):
        total[v], rank[v] = total.get(v, 0.0) + 1, max(rank.get(v, -i), -i)
    centre = max(total, key=lambda v: (total[v], rank[v], v)).lower().split()
    columns = {v: {c[:2]: c[2] for c in aligned(centre, v.lower().split())} for v in total}
    every = sum(total.values())

    def agreement(v):
        out = 0.0
        for at, token in columns[v].items():
            told = sum(total[x] for x in total if columns[x].get(at) == token)
            silent = sum(total[x] for x in total if at not in columns[x])
            out += (told - silent) / every
        return round(out, 6)

    return max(total, key=lambda v: (agreement(v), total[v], rank[v], v)), agreement


def test_alignment():
    assert aligned(["a", "b"], ["a", "x", "b"]) == [(0, 0, "a"), (1, 1, "x"), (1, 0, "b")]
    assert aligned(["a", "b", "c"], ["a", "c"]) == [(0, 0, "a"), (2, 0, "c")]
    assert aligned(["a", "b"], ["a", "x", "y"]) == [(0, 0, "a"), (1, 0, "x"), (2, 1, "y")] and aligned(["anna", "bergh"], ["anna", "m.", "berg"]) == [(0, 0, "anna"), (1, 1, "m."), (1, 0, "berg")] and aligned([], ["a"]) == [(0, 1, "a")]


def test_alignment_does_not_depend_on_size():
    """The most alike tokens are aligned in runs of equal length, and in those of over a million comparisons."""
    assert aligned(["maria", "berg"], ["bergh", "x"]) == [(1, 0, "bergh"), (2, 1, "x")]
    assert aligned(["ek", "ab", "berg"], ["bergh", "oo", "uu"])[0] == (2, 0, "bergh")
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    a, b = [words[k % 25] + "x" for k in range(1_100)], ["zz", *(words[k % 25] + "y" for k in range(1_100))]
    assert aligned(a, b) == [(0, 1, "zz"), *((k, 0, y) for k, y in enumerate(b[1:]))]


def test_consensus_values_equal_brute_force(spark):
    random.seed(4)
    words = ["anna", "berg", "bergg", "maria", "al.", "ab"]
    rows = [(g, 100 * g + i, 0, None, " ".join(random.choice(words) for _ in range(random.randint(1, 4))), [random.choice(["hund", "-"])], "x") for g in range(40) for i in range(random.randint(1, 9))]
    rows += [(99, 10_000 + i, 0, None, "Anna Berg" if i % 3 else f"Anna Berg {i}", None, "x") for i in range(300)] + [(None, 1, 1, None, "x y", None, "x"), (50, 50_000, 1, None, "?", [], "x")]
    df = spark.createDataFrame(rows + rows[:30], "group_id int, record_id bigint, trust int, at timestamp, name string, notes array<string>, value string")
    got = {(r.group_id, r.field_name): r for r in consensus_values(df, ["name"], ["notes"]).collect()}
    for g in {r[0] for r in rows} - {None, 50}:
        own = [r for r in rows if r[0] == g]
        best, agreement = votes([r[4] for r in own], [r[1] for r in own])
        assert abs(got[g, "name"].agreement - agreement(best)) < 1e-5 and agreement(got[g, "name"].value) >= agreement(best) - 1e-5
    assert got[99, "name"].value == "Anna Berg" and (50, "name") not in got and all(r.value == "hund" for (g, f), r in got.items() if f == "notes")
    assert consensus_values(df.limit(0), ["name"], ["notes"]).count() == 0


def test_the_consensus_decides(spark):
    """The most trusted record says one thing, more weight in all another, and what wins is an existing value."""
    at = datetime(2025, 1, 1)
    rows = [(1, 1, 4, at, "Anna Bergh"), (1, 2, 2, at, "Anna Berg"), (1, 3, 2, at, "Anna M. Berg"), (2, 4, 4, at, "Storgatan 1"), (2, 5, 0, at, "Storgatan 2"), (3, 6, 3, at - timedelta(days=90), "Old"), (3, 7, 1, at, "New")]
    df = spark.createDataFrame(rows, "group_id int, record_id bigint, trust int, at timestamp, name string")
    assert {r.group_id: (r.value, r.record_id) for r in consensus_values(df, ["name"], []).collect()} == {1: ("Anna Berg", 2), 2: ("Storgatan 1", 4), 3: ("New", 7)}
    assert {r.group_id: r.record_id for r in survivors(df, ["name"], []).collect()} == {1: 1, 2: 4, 3: 6}


def test_survivors_equal_brute_force(spark):
    random.seed(9)
    rows = []
    for i in range(900):
        group = random.choice([0] * 6 + list(range(1, 60)) + [None])  # group 0 is hot
        rows.append((group, i, random.choice([None, 1, 2, 3]), random.choice([None, datetime(2025, 1, 1) + timedelta(hours=random.randint(0, 5))]), random.choice(["Anna Berg", "A...", "?", None, f"Berg {i}"]), random.choice([None, [], ["-", None], ["n/a", "hund"], [f"n{i}"]]), "x"))
    df = spark.createDataFrame(rows + rows[:50], "group_id int, record_id bigint, trust int, at timestamp, name string, notes array<string>, value string")
    bad = {"?", "A...", None}
    want = set()
    for g in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == g]
        own.sort(key=lambda r: (-(r[2] if r[2] is not None else -1), -(r[3] or datetime(1970, 1, 1)).timestamp(), r[1]))
        if len(own) > 1:
            for f, k in (("name", 4), ("notes", 5)):
                ok = [r[1] for r in own if (r[k] not in bad if f == "name" else any(x not in (None, "-", "n/a") for x in r[k] or []))]
                want |= {(g, f, ok[0])} if ok else set()
    got = survivors(df, ["name"], ["notes"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert survivors(df.limit(0), ["name"], ["notes"]).count() == 0


def test_addresses():
    assert parse_address("se 392 50 Hjorrteköping, Garvardalsgatan nr 6B") == ("Garvardalsgatan", "6B", "39250", "Hjorrteköping")
    assert parse_address("Humlelundsgatan 2, våning 3, 49764 Lommahamn") == ("Humlelundsgatan", "2", "49764", "Lommahamn")
    assert parse_address("9A Smedbackskroken, Brunnabo") == ("Smedbackskroken", "9A", "", "Brunnabo")
    assert parse_address("Norrgårdst., Rådokbo")[0::3] == ("Norrgårdst.", "Rådokbo")
    assert "norrgards|torget" in street_forms("Norrgårdst.") and "tegelbro|stigen" in street_forms("Tegelbrost.")
    assert street_forms("Humlelunds gatan") == street_forms("HUMLELUNDSGATAN") and not street_forms("-")
    assert place(None, None, None, None, None, None, None) == ([], "", [])


def entry(i, address=None, location=None, street=None, number=None, post=None, area=None, city=None):
    return (i, address, location, street, number, post, area, city, "clash")


SCHEMA = "entry_id bigint, address string, location string, street string, street_number string, postal_code string, postal_area string, city string, variant string"


def test_place_links(spark):
    same = [entry(1, "Humlelundsgatan 6B Lommahamn", "", "Humlelundsgatan", "6B", "497 64", "", "Lommahamn"), entry(2, "HumIelundsg. 6 b, lgh 1102, SE-497 64 lommahamn"), entry(3, None, "x", "Humlelundsgtaan", "6B", "49764", None, None), entry(4, "497 64 Lommahamn, Humlelundsgatan 6B")]
    other = [entry(5, "Humlelundsgatan 6A Lommahamn"), entry(6, "Humlelundsgatan 6B Skallbo"), entry(7, "Humlelundsliden 6B, 497 64 Lommahamn"), entry(8, "-"), entry(9), entry(10, "Humlelundsgatan, Lommahamn"), entry(None, "Humlelundsgatan 6B Lommahamn"), entry(11, "lång " * 5000)]
    df = spark.createDataFrame(same + other + same[:2], SCHEMA)
    assert {tuple(r) for r in place_links(df).collect()} == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)}
    assert place_links(df.limit(0)).count() == 0
    hot = spark.createDataFrame([entry(i, "Ekgatan 1, 111 22 Ekby") for i in range(60)], SCHEMA)
    got = place_links(hot, hot=7).collect()
    assert len(got) == len(set(got)) == 60 * 59 // 2


def test_a_misread_town_without_a_code_is_linked(spark):
    rows = [entry(86, "Lovisabacksgränd", "", "Lovisabacksgrand", "7", "392 36", "", "Hjorteköping"), entry(2189, "Lovisabacksgränd 7, 39236 Hjorteköp1ng"), entry(2192, "lovisabacksgränd 7", "Hjorteköping", "Lovisabacksgränd", "7", None, "", "Horteköping")]
    rows += [entry(3, "Humlelundsgatan 1, Skallbo"), entry(4, "Humlelnudsgatan 1, Skalbo"), entry(5, "Ekgatan 2, Skalbo")]  # typos in street and town, no location
    rows += [entry(10, "Ekgatan 1, 111 11 Perslebo"), entry(11, "Ekgatan 3, 111 12 Perslebo"), entry(12, "Ekgatan 1, 222 21 Persebo"), entry(13, "Ekgatan 3, 222 22 Persebo")]  # two towns
    rows += [entry(20, "Ekgatan 9, Almbo", "Granvik"), entry(21, "Ekgatan 9, Granvik")]  # the location names the municipality
    want = {(86, 2189), (86, 2192), (2189, 2192), (3, 4)}
    assert {tuple(r) for r in place_links(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def check_packing(sizes, capacity, containers):
    assert (containers >= 0).all()
    for c in np.unique(containers):
        assert (sizes[containers == c].sum(axis=0) <= capacity).all()


def test_fill_keeps_all_limits():
    rng = np.random.default_rng(1)
    capacity = np.array([2048, 6, 1500])
    sizes = np.stack([rng.integers(1, 2049, 800), rng.integers(1, 4, 800), rng.integers(0, 1500, 800)], 1)
    check_packing(sizes, capacity, fill(sizes, capacity))
    plain = np.stack([rng.integers(1, 900, 3000)] * 1 + [np.ones(3000, int)] + [np.zeros(3000, int)], 1)
    out = fill(plain, np.array([2048, 256, 2048]))
    assert plain[:, 0].sum() / 2048 / (out.max() + 1) > 0.99
    assert len(fill(plain[:0], capacity)) == 0


def test_pack(spark):
    rows = [(i, t) for i, t in enumerate([5000, 2048, 2049, 0, None, -4, 1, 700, 700, 700])] + [(1, 2048)]
    got = pack(spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, tokens int, part string"), block=4).toPandas()
    totals = got.groupby("item_id").part_tokens.sum().to_dict()
    assert totals == {0: 5000, 1: 4096, 2: 2049, 3: 0, 4: 0, 5: 0, 6: 1, 7: 700, 8: 700, 9: 700}
    assert got.groupby("container").part_tokens.sum().max() <= 2048
    assert got[got.item_id == 0].part_tokens.tolist().count(2048) == 2 and len(got[got.item_id == 7]) == 1
    wide = pack(spark.createDataFrame([(i, 10, 3, 5) for i in range(50)], "item_id int, tokens int, segments int, loss int"), segments=7, loss=9).toPandas()
    assert wide.container.nunique() == 50 and wide.groupby("container").size().max() == 1  # two would exceed the loss limit
    assert pack(spark.createDataFrame([], "item_id int, tokens int")).count() == 0


def test_example_sizes_and_blocks(spark):
    df = spark.createDataFrame([(1, "one two\n% not said\n\nthree"), (2, None), (3, "")], "doc_id int, text string")
    got = {r.item_id: r for r in example_sizes(df).collect()}
    assert set(got) == {1, 3} and got[1].segments == 2 and 0 < got[1].loss < got[1].tokens and got[3].tokens == 0
    items = spark.createDataFrame([(i, 100, 1, 10) for i in range(400)], "item_id int, tokens int, segments int, loss int")
    packed = pack(items, tokens=1000, segments=4, loss=500, block=100)
    assert packed.rdd.getNumPartitions() == 4
    assert packed.groupBy("container").count().agg(F.max("count")).first()[0] == 4  # segments bind, tokens would allow ten


def test_tokenizers_agree_on_counts(spark):
    texts = ["Hello world", "", "åäö \\section{x}", "<|endoftext|>"]
    assert counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == counter("/opt/tokenizers/byte_bpe_50k.json")(texts)
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string")
    assert {r.doc_id for r in token_counts(df).collect()} == {0, 1, 2, 3}
