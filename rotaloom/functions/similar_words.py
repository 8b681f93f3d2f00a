"""Known labels in noisy texts, by Ratcliff-Obershelp similarity of word groups, on distinct values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LETTERS, LEAST_RATIO, LENGTH_GAP = 5, 0.82, 6


def word_groups(text: str, most: int = 3) -> list[str]:
    """All runs of up to ``most`` words with enough letters, each once, in order of text."""
    words = text.split()
    runs = (" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    return list(dict.fromkeys(r for r in runs if len(r.replace(" ", "")) >= LEAST_LETTERS))


def closest(text: str, patterns: Sequence[str]) -> tuple[float, int]:
    """Ratio and number of the pattern most like a word group of ``text``; (0, -1) below the least ratio.

    Of equal ratios the earlier pattern wins. Cheap bounds are tried before the full comparison.
    """
    best, at = 0.0, -1
    groups = word_groups(text)
    for number, pattern in enumerate(patterns):
        matcher = None
        for group in groups:
            least = max(best, LEAST_RATIO)
            if abs(len(group) - len(pattern)) > LENGTH_GAP or 2 * min(len(group), len(pattern)) < least * (len(group) + len(pattern)):
                continue
            if matcher is None:
                matcher = SequenceMatcher(None)
                matcher.set_seq2(pattern)
            matcher.set_seq1(group)
            if matcher.quick_ratio() < least:
                continue
            ratio = matcher.ratio()
            if ratio >= LEAST_RATIO and ratio > best:
                best, at = ratio, number
    return best, at


@lru_cache(200_000)
def _known(text: str, patterns: tuple[str, ...]) -> int:
    return closest(text, patterns)[1]


def closest_of(patterns: list[str]) -> Callable[[Column], Column]:
    """A function of an array of texts: for each the number of the closest pattern, -1 if none is close or
    the text is null. A text is compared once in each worker."""
    fixed = tuple(patterns)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: [-1 if t is None else _known(t, fixed) for t in ts])

    return lambda texts: numbers.asNondeterministic()(texts)


def closest_label(values: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """``values``' distinct texts with the number of the closest pattern (-1: none) and the ratio.

    The comparison is costly for its bytes, so the texts are spread over all partitions.
    """

    @F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("pattern", T.IntegerType())]))
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([closest(t or "", patterns) for t in texts], columns=["ratio", "pattern"])

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(column).distinct().repartition(parts).withColumn("_c", judged.asNondeterministic()(column))
    return distinct.select(column, "_c.ratio", "_c.pattern")
