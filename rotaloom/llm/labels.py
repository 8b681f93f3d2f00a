"""Free labels mapped to a canonical list by a prefix-filtered set-similarity join."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.llm.gazetteer import FILLERS, GLOSSARY
from rotaloom.llm.setsim import best_match, edit_join, overlap_join, similarity_join, word_grams
from rotaloom.llm.spelling import typos, unaccented, unread
from rotaloom.session import cut_lineage

_LEAD = re.compile(r"^(?:[^\w(]+|(?:typ|uppdrag|jobb|pass|label|etikett)\s*[:–—-]\s*)+", re.I)
_TRAIL = re.compile(r"(?:\s+\d+\s*h\s*\d*\s*m?(?:in)?|\s+\d+\s*m(?:in)?|\s+\d+(?:\s+\d+)*|\s*\((?:ny|ej klar|ändrad)\)|\s*(?:\.{3,}|…)|[\s?!,;:–—-]+)$", re.I)


def stripped(label: str) -> str:
    """``label`` without bullets, lead words, durations, counters and remarks around it."""
    text = " ".join(label.split())
    while (cut := _TRAIL.sub("", _LEAD.sub("", text))) != text:
        text = cut
    return text


def plain(label: str) -> str:
    """Comparable form: read errors undone, lower case, no accents, only letters, digits, dots, spaces."""
    text = unaccented(unread(stripped(label)).lower())
    text = re.sub(r"(?<=\w)-(?=\w)", "", text)  # hyphens that split a word
    return " ".join(re.sub(r"\.+", ".", re.sub(r"[^\w. ]+", " ", text)).split())


@lru_cache(200_000)
def abbreviates(short: str, long: str) -> bool:
    """Whether ``short``, which has dots, is ``long`` with each dot standing for left-out letters."""
    if "." not in short or sum(c.isalnum() for c in short) < 3:
        return False
    parts = [re.escape(p.strip()) for p in short.split(".")]
    return re.fullmatch(r"[\w ]*?".join(parts[:-1]) + r"[\w ]*?\s*" + parts[-1] if parts[-1] else r"[\w ]*?\s*".join(parts[:-1]) + r"[\w ]*", long) is not None


def allowed(size: int) -> int:
    """Edits tolerated in a text of so many letters."""
    return 0 if size < 4 else 1 if size < 6 else 2 if size < 14 else 3


@lru_cache(200_000)
def closeness(label: str, entry: str) -> float:
    """1 for equal plain forms, less for abbreviations and typos, 0 if ``label`` isn't ``entry``."""
    if label == entry:
        return 1.0
    if abbreviates(label, entry):
        return 0.95
    a, b = re.sub(r"[. ]", "", label), re.sub(r"[. ]", "", entry)
    if not a:
        return 0.0
    most = allowed(min(len(a), len(b)))
    d = typos(a, b, most)
    if d <= most:
        return 0.9 - 0.5 * d / max(len(a), len(b))
    # a cut-off label, perhaps with a typo
    if (4 if label.endswith(".") else 5) <= len(a) < len(b) and len(a) >= 0.4 * len(b):
        return 0.6 if b.startswith(a) else 0.5 if typos(a, b[: len(a)], 1) <= 1 else 0.0
    return 0.0


@F.pandas_udf(T.StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(plain, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _closeness(labels: pd.Series, entries: pd.Series) -> pd.Series:
    return pd.Series([closeness(a, b) for a, b in zip(labels, entries)])


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([typos(x, y, 2) for x, y in zip(a, b)], dtype="int32")


def glossary_table(like: DataFrame, words: Mapping[str, str] | None = None) -> DataFrame:
    """A table of other words (``word``, ``senses``: array) for ``map_labels``; by default the built-in list."""
    rows = [(plain(w), [plain(x) for x in senses.split("|")]) for w, senses in (GLOSSARY if words is None else words).items()]
    return like.sparkSession.createDataFrame(rows, "word string, senses array<string>")


def _told(forms: DataFrame, glossary: DataFrame) -> DataFrame:
    """The readings of each form: ``form``, ``words`` (as typed, and with each word's n-th sense put in).

    A typed word counts as the nearest glossary words within one edit from four letters on, two from eight
    on, with the senses of all that are equally near. Words that say nothing are left out.
    """
    split = forms.select("form", F.posexplode(F.filter(F.split("form", "[ .]"), lambda w: w != "")).alias("_at", "_w")).where(~F.col("_w").isin({plain(w) for w in FILLERS}))
    known = glossary.where(F.col("word").isNotNull() & (F.size("senses") > 0)).groupBy("word").agg(F.first("senses").alias("senses"))
    typed = split.select(F.col("_w").alias("id")).distinct()
    most = lambda w: F.when(F.length(w) < 4, 0).when(F.length(w) < 8, 1).otherwise(2)
    near = edit_join(typed.where(F.length("id") > 3), known.select(F.col("word").alias("id")).where(F.length("id") > 3), [], most)
    near = near.withColumn("_d", _edits("left_id", "right_id")).where(F.col("_d") <= F.least(most(F.col("left_id")), most(F.col("right_id"))))
    same = typed.join(known.select(F.col("word").alias("id")), "id").select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), F.lit(0).alias("_d"))
    near = cut_lineage(near.unionByName(same))  # read twice below
    least = near.groupBy("left_id").agg(F.min("_d").alias("_least"))
    meant = near.join(least, "left_id").where("_d = _least").join(known, F.col("right_id") == known.word)
    meant = meant.groupBy(F.col("left_id").alias("_w")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("word", "senses"))), lambda x: x["senses"])).alias("senses"))
    words = split.join(meant, "_w", "left").groupBy("form").agg(F.array_sort(F.collect_list(F.struct("_at", "_w", "senses"))).alias("_l"))
    senses = F.array_max(F.transform("_l", lambda x: F.greatest(F.size(x["senses"]), F.lit(0))))
    sense = lambda n: F.transform("_l", lambda x: F.when(F.size(x["senses"]) > 0, F.get(x["senses"], F.least(n, F.size(x["senses"]) - 1))).otherwise(x["_w"]))
    read = F.transform(F.sequence(F.lit(0), F.greatest(senses, F.lit(0))), lambda n: F.when(n == 0, F.transform("_l", lambda x: x["_w"])).otherwise(sense(n - 1)))
    return words.select("form", F.posexplode(F.array_distinct(read)).alias("reading", "words"))


def map_labels(values: DataFrame, entries: DataFrame, glossary: DataFrame | None = None, threshold: float = 0.4, floor: float = 0.25) -> DataFrame:
    """The entry of a canonical list that each freely typed value stands for.

    ``values``: column ``value``; ``entries``: ``entry_id`` and ``entry``; ``glossary``: ``word`` and
    ``senses`` (plain words; default: ``glossary_table``); other columns are ignored. Result: ``value``
    (distinct, exactly as typed), ``entry_id`` (0: none), ``score``. Null values are left out; values
    without a letter get 0. Repeated values and entries count once. Of entries equally close the least
    entry_id wins. An empty list gives 0 for every value.

    Distinct values, in each reading that the glossary gives, and entries become sets of the letter pairs
    of their words, so that order and compounding don't matter. Sets are joined by the prefix filter at a
    Jaccard similarity of ``floor``; forms within the tolerated edits, and forms of which an entry holds
    all letter pairs but three (abbreviations and cut-off labels), are joined by the same filter with
    those bounds, as short ones may lie below ``floor``. Jaccard is computed exactly for every candidate;
    it stands if it reaches ``threshold`` or is the entry but for typos, dots or a missing end
    (``closeness``). The best by Jaccard is kept, an entry with typos before another wording. Values are
    counted out before the join, so a hot value costs one row. Each join is written and a query of its own, as
    the driver holds the plan of a query, again for each change while it runs, at once.
    """
    values = values.where(F.col("value").isNotNull()).select("value").distinct().select("value", _plain.asNondeterministic()("value").alias("form"))
    values = cut_lineage(values)  # one row for each spelling; read several times below
    forms = cut_lineage(values.select("form").distinct())
    told = cut_lineage(_told(forms, glossary_table(values) if glossary is None else glossary))
    read = told.select(F.struct("form", "reading").alias("id"), word_grams(F.col("words")).alias("tokens"))
    listed = entries.where(F.col("entry").isNotNull() & F.col("entry_id").isNotNull()).select(F.col("entry_id").cast("int").alias("entry_id"), _plain("entry").alias("name"))
    listed = cut_lineage(listed.groupBy("name").agg(F.min("entry_id").alias("entry_id")))
    sets = listed.select(F.col("name").alias("id"), word_grams(F.filter(F.split("name", "[ .]"), lambda w: (w != "") & ~w.isin({plain(x) for x in FILLERS}))).alias("tokens"))
    alike = cut_lineage(similarity_join(read, sets, [], floor).select(F.col("left_id.form").alias("form"), F.col("right_id").alias("name")))

    bare = lambda df, c: df.select(F.col(c).alias("_o"), F.regexp_replace(c, "[. ]", "").alias("id")).where("id != ''")
    typed, wanted = bare(forms, "form"), bare(listed, "name")
    near = edit_join(typed.select("id").distinct(), wanted.select("id").distinct(), [], lambda w: F.when(F.length(w) < 4, 0).when(F.length(w) < 6, 1).when(F.length(w) < 14, 2).otherwise(3), top=3)
    once = lambda df: df.select("id", word_grams(F.array("id")).alias("tokens")).distinct()
    begun = overlap_join(once(typed), once(wanted), [], lambda nl, nr: F.greatest(nl - 3, F.lit(1)), lambda _: F.lit(4), lambda n: n)
    pairs = cut_lineage(near).unionByName(cut_lineage(begun.select("left_id", "right_id"))).join(typed.withColumnsRenamed({"id": "left_id", "_o": "form"}), "left_id")
    pairs = pairs.join(wanted.withColumnsRenamed({"id": "right_id", "_o": "name"}), "right_id").select("form", "name")
    pairs = cut_lineage(alike.unionByName(pairs).distinct())

    own = read.select(F.col("id.form").alias("form"), "tokens").groupBy("form").agg(F.collect_set("tokens").alias("_readings"))
    met = pairs.join(own, "form", "left").join(sets.select(F.col("id").alias("name"), F.col("tokens").alias("_entry")), "name")
    shared = lambda t: F.size(F.array_intersect(t, "_entry"))
    jaccard = F.coalesce(F.array_max(F.transform("_readings", lambda t: shared(t) / F.greatest(F.size(t) + F.size("_entry") - shared(t), F.lit(1)))), F.lit(0.0))
    judged = met.select("form", "name", jaccard.alias("score"), _closeness("form", "name").alias("_close")).where((F.col("score") >= threshold) | (F.col("_close") > 0))
    judged = judged.withColumn("_rank", F.struct(F.col("_close") > 0, "score", "_close")).join(listed, "name")
    best = best_match(judged, ["form"], "_rank", "entry_id").select("form", "entry_id", "score")
    return values.join(best, "form", "left").select("value", F.coalesce("entry_id", F.lit(0)).alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
