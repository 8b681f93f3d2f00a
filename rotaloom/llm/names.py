"""Variant spellings of names: set-similarity join on q-grams of tokens, soft weighted token similarity."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.llm.gazetteer import FIRM_WORDS, NICKNAMES
from rotaloom.llm.setsim import edit_join, grams, overlap_join
from rotaloom.llm.spelling import typos, unaccented, unread
from rotaloom.session import cut_lineage

#: Forms of companies, and forms of address, which don't tell customers apart.
LEGAL = {"ab", "hb", "kb", "publ", "aktiebolag", "aktiebolaget", "handelsbolag", "kommanditbolag", "inc", "ltd", "gmbh"}
TITLES = {"hr", "herr", "fr", "fru", "frk", "froken", "fam", "familjen", "familj", "mr", "mrs", "ms", "dr"}
#: Remarks written behind a name.
REMARKS = {"stadning", "stad", "stadservice", "hund", "kod", "ny", "nyckel", "larm"}
_REMARK = re.compile(r"\((?!publ)[^)]*\)|\b\d+\s*(?:h|min|m)\b(?:\s*\d+\s*m(?:in)?\b)?|[!?*#]+")
_CAMEL = re.compile(r"(?<=[a-zåäöéüø])(?=[A-ZÅÄÖ][a-zåäöéüø])")


_COOPERATIVE = re.compile(r"\bek(?:onomisk)?\.? ?f[oö]r(?:ening)?\b\.?")


@lru_cache(100_000)
def name_tokens(name: str | None) -> tuple[str, ...]:
    """The tokens of a name that tell customers apart; an abbreviated token keeps its dot.

    Read errors, remarks, company forms, letter case, accents and order signs are taken out. Titles stay
    as ``=``, so that "Fru X" is known to lack a given name. Empty for a text without letters.
    """
    if not name or not any(c.isalpha() for c in name):
        return ()
    text = _REMARK.sub(" ", _CAMEL.sub(" ", unread(" ".join(name.split()))))
    text = unaccented(text).lower().replace("a.b.", "ab").replace("h.b.", "hb")
    text = _COOPERATIVE.sub(" ", text)
    words = [w for w in re.sub(r"[^\w.]+", " ", text).split() if any(c.isalnum() for c in w)]
    out, titled = [], False
    for w in words:
        bare = w.strip(".")
        if bare in TITLES and len(words) > 1:
            titled = True
        elif bare not in LEGAL and not (bare in REMARKS and len(out) >= 2):
            out.append(bare + ("." if w.endswith(".") and len(bare) > 1 else ""))
    return (*out, "=") if titled else tuple(out)


@lru_cache(400_000)
def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, less for typos, abbreviations and initials, 0 for different ones."""
    if a == b:
        return 1.0
    x, y = a.rstrip("."), b.rstrip(".")
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if len(x) == 1:
        return 0.6 if y[0] == x or (x == "1" and y[0] in "il") else 0.0
    if "." in x:  # adv.byra
        head, tail = x.split(".", 1)
        return 0.9 if y.startswith(head) and y.endswith(tail) else 0.0
    if a.endswith(".") and len(x) >= 2 and (y.startswith(x) or len(x) >= 4 and typos(x, y[: len(x)], 1) <= 1):
        return 0.9
    most = 0 if len(x) < 3 else 1 if len(x) < 6 else 2
    d = typos(x, y, most)
    if d > most or d > 1 and x[0] != y[0] and x[1] != y[1]:
        return 0.0
    return 1 - d / (len(y) + 1)


def together_typos(size: int) -> int:
    """Edits tolerated between a name of so many letters written as one word and one of several words."""
    return 0 if size < 8 else 1 if size < 12 else 2


def compare(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> tuple[str, str, str]:
    """How two names' tokens relate: kind (``full``: word for word; ``same``: with initials; ``a_in_b``,
    ``b_in_a`` or blank), and for a name that is only part of the other the first letter of what the
    other has more (at its side)."""
    no = ("", "", "")
    ta, tb = [t for t in a if t != "="], [t for t in b if t != "="]
    if not ta or not tb:
        return no
    ja, jb = "".join(ta).replace(".", ""), "".join(tb).replace(".", "")
    if len(ja) > 3 and len(ta) != len(tb) and typos(ja, jb, together_typos(min(len(ja), len(jb)))) <= together_typos(min(len(ja), len(jb))):
        return ("full", "", "")
    pairs = sorted(((token_similarity(x, y), wa[i] + wb[j], -abs(i - j), i, j) for i, x in enumerate(ta) for j, y in enumerate(tb)), reverse=True)
    used_a, used_b, strong, light = {}, {}, [], 0
    for s, w, _, i, j in pairs:
        if s > 0 and i not in used_a and j not in used_b:
            used_a[i], used_b[j] = s, s
            if min(len(ta[i]), len(tb[j])) > 1:
                strong.append((max(wa[i], wb[j]) if s < 1 else min(wa[i], wb[j]), i, j))
            light += s == 0.6
    if not strong:
        return no
    rest_a = [i for i in range(len(ta)) if i not in used_a]
    rest_b = [j for j in range(len(tb)) if j not in used_b]
    if rest_a and rest_b:
        return no
    total = sum(min(wa[i], wb[j]) * used_a[i] for _, i, j in strong)
    titled = "=" in a or "=" in b
    if not rest_a and not rest_b:
        return ("same" if light or titled or len(strong) < 2 else "full", "", "")
    # a part of the other: what is shared must weigh as much as the heaviest of what is missing
    rest, t, w = (rest_a, ta, wa) if rest_a else (rest_b, tb, wb)
    long_rest = [k for k in rest if len(t[k]) > 1]
    if not long_rest and len(strong) >= 2:
        return ("same", "", "")  # only an initial more
    if long_rest and len(strong) < 2 and not light and not titled and total < 0.75 * max(w[k] for k in long_rest):
        return no
    first = t[min(rest)][0]
    return ("b_in_a", first, "") if rest_a else ("a_in_b", "", first)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda n: list(name_tokens(n)))


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("more_a", T.StringType()), T.StructField("more_b", T.StringType())]))
def _compare(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(list(a), list(x), list(b), list(y)) for a, x, b, y in zip(ta, wa, tb, wb)], columns=["kind", "more_a", "more_b"])


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_similarity(x, y) > 0 for x, y in zip(a, b)], dtype=bool)


def nickname_table(names: DataFrame, nicknames: Mapping[str, str] | None = None) -> DataFrame:
    """A table of short forms (``nickname``, ``given``) for ``name_links``; by default the built-in lists,
    with words of company names."""
    rows = [(unaccented(a).lower(), unaccented(b).lower()) for a, b in ({**NICKNAMES, **FIRM_WORDS} if nicknames is None else nicknames).items()]
    return names.sparkSession.createDataFrame(rows, "nickname string, given string")


def name_links(names: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """Pairs of spellings within a group that mean the same person, family or organisation.

    ``names``: ``scope`` (names are compared within it) and ``name``; further columns are ignored.
    ``nicknames``: ``nickname`` and ``given``, plain lower-case words (default: ``nickname_table``).
    Result: ``scope``, ``name_a`` < ``name_b`` (exactly as given), distinct. Null scopes and names, and
    names without letters, have no links. Repeated rows count once. Of several given names of one
    nickname the first by code point is taken.

    Each distinct name becomes tokens (company forms, titles and remarks aside; nicknames as the given
    name). A token's weight is the logarithm of how few distinct names hold it, over all names. The
    distinct tokens of a scope, and its names written as one word, are joined as sets of q-grams by the
    prefix filter (``_similar_words``) with the bound that the tolerated edits set. A name's rarest token
    (and one more for each initial of the other name) meets any token of the other: as every token of one
    of the two must match a token of the other, and at most as many match an initial as the other has,
    this finds all pairs that the comparison accepts, and never all pairs of a scope. A candidate is
    verified by soft weighted token similarity: aligned tokens must each match (typo, initial,
    abbreviation), and words left over on both sides mean different customers. Two names that both match
    a third word for word are linked too, as each may have typos of its own. A name that is only part of
    another ("Fru Berg", or one word of a firm) is linked if the shared words weigh enough and all names
    that contain it in that scope agree in their further word's initial; otherwise it could be either,
    and isn't linked.
    """
    spelled = names.where(F.col("scope").isNotNull() & F.col("name").isNotNull()).select("scope", "name").distinct()
    base = cut_lineage(spelled.select("scope", "name", F.xxhash64("name").alias("_id"), _tokens("name").alias("_tk")).where(F.size("_tk") > 0))
    short = nickname_table(names) if nicknames is None else nicknames
    short = short.where(F.col("nickname").isNotNull()).groupBy(F.col("nickname").alias("_t")).agg(F.min("given").alias("_given"))
    each = base.select("scope", "_id", F.posexplode("_tk").alias("_at", "_t")).join(short, "_t", "left")
    each = each.select("scope", "_id", "_at", F.coalesce("_given", "_t").alias("_t"))
    count = each.groupBy("_t").agg(F.count("*").alias("_n"))
    total = base.count()  # one number
    weight = F.when(F.col("_t") == "=", 0.0).otherwise(F.log(1 + total / F.col("_n")))
    listed = F.array_sort(F.collect_list(F.struct("_at", "_t", "_w")))
    known = each.join(count, "_t").withColumn("_w", weight).groupBy("scope", "_id").agg(listed.alias("_l"))
    known = cut_lineage(known.select("scope", "_id", F.transform("_l", lambda x: x["_t"]).alias("_tk"), F.transform("_l", lambda x: x["_w"]).alias("_wt")))

    long = F.reverse(F.array_sort(F.filter(F.arrays_zip(F.col("_wt").alias("w"), F.col("_tk").alias("t")), lambda x: F.length(x["t"]) > 1)))
    initials = F.size(F.filter("_tk", lambda t: (F.length(t) == 1) & (t != "=")))
    tokens = known.select("scope", "_id", initials.alias("_initials"), F.posexplode(long).alias("_rank", "_r"))
    tokens = tokens.select("scope", "_id", F.lit(0).alias("_as"), "_initials", "_rank", F.col("_r.t").alias("_t"))
    own = F.filter("_tk", lambda t: t != "=")
    together = known.where(F.size(own) > 0).select("scope", "_id", F.lit(1).alias("_as"), F.lit(0).alias("_initials"), F.lit(0).alias("_rank"), F.regexp_replace(F.array_join(own, ""), "[.]", "").alias("_t"))
    keyed = cut_lineage(tokens.unionByName(together.where(F.length("_t") > 3)))
    similar = _similar_words(keyed.select("scope", "_as", F.col("_t").alias("id")).distinct())
    a = keyed.select("scope", "_as", F.col("_t").alias("left_id"), F.col("_id").alias("_x"), "_rank")
    b = keyed.select("scope", "_as", F.col("_t").alias("right_id"), F.col("_id").alias("_y"), "_initials")
    ids = similar.join(a, ["scope", "_as", "left_id"]).join(b, ["scope", "_as", "right_id"]).where("_x != _y and _rank <= _initials")
    ids = ids.select("scope", F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y")).distinct()
    left = known.select("scope", F.col("_id").alias("_x"), F.col("_tk").alias("_ta"), F.col("_wt").alias("_wa"))
    right = known.select("scope", F.col("_id").alias("_y"), F.col("_tk").alias("_tb"), F.col("_wt").alias("_wb"))
    compared = ids.join(left, ["scope", "_x"]).join(right, ["scope", "_y"]).select("scope", "_x", "_y", _compare("_ta", "_wa", "_tb", "_wb").alias("_c"))
    judged = cut_lineage(compared.select("scope", "_x", "_y", "_c.*").where("kind != ''"))

    part = judged.where("kind in ('a_in_b', 'b_in_a')").select("scope", F.when(F.col("kind") == "a_in_b", F.col("_x")).otherwise(F.col("_y")).alias("_part"), F.when(F.col("kind") == "a_in_b", F.col("_y")).otherwise(F.col("_x")).alias("_whole"), F.concat("more_a", "more_b").alias("_more"))
    by = Window.partitionBy("scope", "_part")
    clear = part.withColumn("_lo", F.min("_more").over(by)).withColumn("_hi", F.max("_more").over(by)).where("_lo = _hi")
    full = judged.where("kind = 'full'")
    around = full.select("scope", F.col("_x").alias("_m"), F.col("_y").alias("_x")).unionByName(full.select("scope", F.col("_y").alias("_m"), "_x"))
    through = around.join(around.withColumnRenamed("_x", "_y"), ["scope", "_m"]).where("_x < _y").select("scope", "_x", "_y")
    links = judged.where("kind in ('full', 'same')").select("scope", "_x", "_y").unionByName(through.distinct()).unionByName(clear.select("scope", F.col("_part").alias("_x"), F.col("_whole").alias("_y")))
    named = base.select("scope", "_id", "name")
    links = links.join(named.withColumnsRenamed({"_id": "_x", "name": "_nx"}), ["scope", "_x"]).join(named.withColumnsRenamed({"_id": "_y", "name": "_ny"}), ["scope", "_y"])
    return links.select("scope", F.least("_nx", "_ny").alias("name_a"), F.greatest("_nx", "_ny").alias("name_b")).distinct()


def _similar_words(words: DataFrame) -> DataFrame:
    """Pairs of words (``id``) of one ``scope`` and class ``_as`` that may be spellings of one another, both
    ways and each with itself: ``left_id``, ``right_id``.

    Words within the edits that ``token_similarity`` tolerates (0, 1, 2 from 1, 3, 6 letters on) come by
    ``edit_join``. An abbreviation shares all pairs of its letters up to its dot, or all but 3 from four
    letters on, with any word it stands for.
    """
    on, left = ["scope", "_as"], F.col("left_id")
    whole = words.where(~F.col("id").endswith(".") & (F.length("id") >= 3))
    near = edit_join(whole, None, on, lambda w: F.when(F.length(w) < 3, 0).when(F.length(w) < 6, 1).otherwise(2))

    pairs_of = lambda w: grams(F.translate(w, "1i", "ll"))
    head = lambda w: F.regexp_replace(w, "[.].*$", "")
    dotted = words.where(F.col("id").contains(".") & (F.col("_as") == 0))
    shorts = dotted.select(*on, "id", F.filter(pairs_of(head(F.col("id"))), lambda g: ~g.endswith("$")).alias("tokens"))
    longs = words.where("_as = 0").join(dotted.select("scope").distinct(), "scope", "left_semi").select(*on, "id", pairs_of(F.regexp_replace("id", "[.]", "")).alias("tokens"))
    slack = lambda w: F.when(F.length(head(w)) >= 4, 3).otherwise(0)
    begins = overlap_join(shorts, longs, on, lambda nl, nr: F.greatest(nl - slack(left), F.lit(1)), lambda _: slack(F.col("id")) + 1, lambda n: n)

    found = near.unionByName(begins.where("left_id != right_id").select(*on, "left_id", "right_id")).where((F.col("_as") == 1) | _alike("left_id", "right_id"))
    both = F.array(F.struct("left_id", "right_id"), F.struct(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    return found.select(*on, F.inline(both)).unionByName(words.select(*on, F.col("id").alias("left_id"), F.col("id").alias("right_id")))
