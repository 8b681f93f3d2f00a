"""One surviving value for each field of a duplicate group: the most trusted record's, or the token-level consensus."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.functions.timeofday import squeeze
from rotaloom.session import cut_lineage

#: Words that stand for a missing value.
STAND_INS = [
    "ingen uppgift", "ej angivet", "ej angiven", "ej känd", "ej känt", "saknas", "okänd", "okänt", "unknown", "null", "none", "nil", "nan",
    "tbd", "tba", "todo", "n/a", "n.a.", "na", "xxx", "xx", "x", "missing", "empty", "test", "ingen", "inget", "uppgift saknas", "not available",
]


def real(value: Column) -> Column:
    """Whether ``value`` says something: not null, blank, a stand-in (word, signs, dummy digits) or cut off."""
    text = F.lower(squeeze(value))
    signs = ~text.rlike(r"[\p{L}\p{N}]")
    dummy = F.regexp_replace(text, r"[^\p{N}\p{L}]", "").rlike(r"^(?:0+|(\p{N})\1{2,}|(\p{L})\2{1,}|1234\d*)$")
    return F.coalesce(value.isNotNull() & ~signs & ~dummy & ~text.isin(STAND_INS) & ~text.rlike(r"(?:\.\.\.|…)$"), F.lit(False))


def _joined(field: str) -> Column:
    return F.array_join(F.filter(field, real), " | ")


def _rank() -> Column:
    """Trust, then the later time, then the smaller id; the greatest is best."""
    return F.struct(F.col("trust").isNotNull().alias("known"), F.coalesce("trust", F.lit(0)).cast("double").alias("trust"), F.col("at"), (-F.col("record_id")).alias("minus"))


def survivors(records: DataFrame, fields: list[str], lists: list[str]) -> DataFrame:
    """For each group and field the most trusted record with a real value.

    ``records``: ``group_id``, ``record_id``, ``trust`` (number, null is least), ``at`` (timestamp, null
    is earliest), the text ``fields`` and the ``lists`` (arrays of text, real if an item is). Result:
    ``group_id``, ``field_name``, ``record_id``; groups of at least two different record ids; a field
    without a real value gives no row. Null groups and records are left out, repeated rows count once,
    further columns are ignored.

    Values are ranked by trust, then the later ``at``, then the smaller record id. A fixed order leaves a
    vote no say, so the best rank of each field is a maximum: one aggregation, combined before its only
    exchange, whatever the size of a group. ``consensus_values`` votes.
    """
    rows = records.where(F.col("group_id").isNotNull() & F.col("record_id").isNotNull())
    ok = {**{f: real(F.col(f)) for f in fields}, **{f: F.coalesce(F.exists(f, real), F.lit(False)) for f in lists}}
    names = list(ok)
    best = [F.max(F.when(ok[f], _rank())).alias(f"_{i}") for i, f in enumerate(names)]
    wide = rows.groupBy("group_id").agg(F.min("record_id").alias("_lo"), F.max("record_id").alias("_hi"), *best).where("_lo < _hi")
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"_{i}").alias("rank")) for i, f in enumerate(names)))
    return wide.select("group_id", F.inline(each)).where("rank is not null").select("group_id", "field_name", (-F.col("rank.minus")).alias("record_id"))


def aligned(centre: list[str], tokens: list[str]) -> list[tuple[int, int, str]]:
    """The column of each of ``tokens`` when they are aligned to ``centre``: position in the centre and 0, or
    the position that an inserted token comes before and its number among those.

    Equal tokens are aligned first; between them the most alike ones, in order (``_most_alike``)."""
    out = []
    for tag, a0, a1, b0, b1 in SequenceMatcher(None, centre, tokens, False).get_opcodes():
        mates = dict(_most_alike(centre[a0:a1], tokens[b0:b1])) if tag == "replace" else {k: k for k in range(b1 - b0)} if tag == "equal" else {}
        at, nth = a0, 0
        for k in range(b1 - b0):
            if k in mates:
                at, nth = a0 + mates[k] + 1, 0
                out.append((at - 1, 0, tokens[b0 + k]))
            else:
                nth += 1
                out.append((at, nth, tokens[b0 + k]))
    return out


@lru_cache(4096)
def _matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b, False)


@lru_cache(1 << 18)
def _alike(a: str, b: str) -> float:
    """Letters' similarity of two tokens, and a little for being a pair."""
    if set(a).isdisjoint(b):
        return 0.01
    matcher = _matcher(b)
    matcher.set_seq1(a)
    return matcher.ratio() + 0.01


def _most_alike(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places in ``b`` and ``a``, in order in both, with the greatest sum of letters' similarity.

    Of equal sums the one with the earliest pair, then the one that leaves out a token of ``a`` first. The
    same at any size: different tokens are compared with each other, and a quarter of a byte is kept for
    each two places."""
    if len(a) == len(b) == 1:
        return [(0, 0)]  # all there is
    words = list(dict.fromkeys(a))
    number = {w: n for n, w in enumerate(words)}
    at = np.array([number[w] for w in a])
    row, ways = np.zeros(len(a) + 1), []
    for y in reversed(b):
        paired = row[1:] + np.array([_alike(x, y) for x in words])[at]
        row = np.append(np.maximum(row[:-1], paired), 0.0)  # without or with y, then without tokens of a
        row = np.maximum.accumulate(row[::-1])[::-1]
        ways.append((np.packbits(row[:-1] == paired), np.packbits(row[:-1] == row[1:])))
    ways.reverse()
    said = lambda bits, i: bits[i >> 3] >> (7 - (i & 7)) & 1
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if said(ways[j][0], i):
            out.append((j, i))
            i, j = i + 1, j + 1
        elif said(ways[j][1], i):
            i += 1
        else:
            j += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("token", T.StringType())])))
def _aligned(centres: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([aligned(c.lower().split(), v.lower().split()) for c, v in zip(centres, values)])


def consensus_values(records: DataFrame, fields: list[str], lists: list[str], half_life_days: float = 30.0) -> DataFrame:
    """For each group and field the existing value closest to the token-level consensus of all.

    ``records`` as for ``survivors``, as are the rows left out; groups of one record have rows too.
    Result: ``group_id``, ``field_name``, ``value`` (a list as its real items joined by `` | ``),
    ``record_id`` (the most trusted of those with that value) and ``agreement``.

    A record's vote weighs 1 + trust (null and negative trust as 0), halved for every ``half_life_days``
    that it is older than the newest of its group (no time: as old as the oldest). Equal values are one,
    with the sum of their weights. Progressive alignment: the heaviest value is the centre, the others are
    aligned to it one by one, and tokens it lacks open columns. Every column is voted with the values'
    weights, a value without a token there voting for none. A value's agreement is the share of weight
    that votes as it does, summed over its tokens, less what votes for none there. The closest value has
    the greatest; ties go to the greater weight, then the better rank, then by code point. Alignments
    don't depend on one another, so votes are counted by aggregation and no task holds a group.
    """
    rows = records.where(F.col("group_id").isNotNull() & F.col("record_id").isNotNull()).select("group_id", "record_id", "trust", "at", *fields, *lists).distinct()
    newest = rows.groupBy("group_id").agg(F.max("at").alias("_new"), F.min("at").alias("_old"))
    days = (F.unix_micros(F.col("_new").cast("timestamp")) - F.unix_micros(F.coalesce("at", "_old").cast("timestamp"))) / 86_400e6
    weight = (1 + F.greatest(F.coalesce("trust", F.lit(0)).cast("double"), F.lit(0.0))) * F.pow(F.lit(0.5), F.coalesce(days, F.lit(0.0)) / half_life_days)
    told = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), real(F.col(f)).alias("ok")) for f in fields]
    told += [F.struct(F.lit(f).alias("field_name"), _joined(f).alias("value"), F.coalesce(F.exists(f, real), F.lit(False)).alias("ok")) for f in lists]
    long = rows.join(newest, "group_id").select("group_id", weight.alias("_w"), _rank().alias("_r"), F.inline(F.array(*told))).where("ok")
    key = ["group_id", "field_name"]
    values = cut_lineage(long.groupBy(*key, "value").agg(F.sum("_w").alias("_w"), F.max("_r").alias("_r")))
    order = F.struct(F.round("_w", 9).alias("w"), "_r", "value")
    centres = values.groupBy(*key).agg(F.max(order).alias("_c"), F.sum("_w").alias("_all")).select(*key, F.col("_c.value").alias("_centre"), "_all")
    tokens = cut_lineage(values.join(centres, key).select(*key, "value", "_w", "_all", F.explode(_aligned("_centre", "value")).alias("_x")).select(*key, "value", "_w", "_all", "_x.*"))
    column = [*key, "at", "nth"]
    votes = tokens.groupBy(*column, "token").agg(F.sum("_w").alias("_votes"))
    voted = votes.groupBy(*column).agg(F.sum("_votes").alias("_any"))
    gain = (F.col("_votes") - (F.col("_all") - F.col("_any"))) / F.col("_all")
    agreed = tokens.join(votes, [*column, "token"]).join(voted, column).groupBy(*key, "value").agg(F.round(F.sum(gain), 6).alias("agreement"))
    best = values.join(agreed, [*key, "value"]).groupBy(*key).agg(F.max(F.struct("agreement", F.round("_w", 9).alias("w"), "_r", "value")).alias("_b"))
    return best.select(*key, F.col("_b.value").alias("value"), (-F.col("_b._r.minus")).alias("record_id"), F.col("_b.agreement").alias("agreement"))
