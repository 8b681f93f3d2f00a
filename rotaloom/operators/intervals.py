"""Coverage of time intervals: continuous periods and the gaps between them (sweep line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_coverage(df: DataFrame, keys: dict[str, Column], start: Column, end: Column, block: int | None = None) -> DataFrame:
    """Periods covered by the intervals of each key, and the gaps between consecutive periods.

    Every interval gives a plus event at ``start`` and a minus event at ``end``; events of one key and
    time are summed before the shuffle, a running sum counts the active intervals, and a period lasts
    while the count is above zero. Touching intervals join.

    ``keys`` maps output names to key expressions (null is a key of its own). Rows with a null bound, or
    whose start isn't before their end, are left out. Repeated rows change nothing; an empty input gives
    an empty result. Columns of ``df`` with clashing names don't matter, as only the given expressions
    are read. Result: the keys, ``kind`` (``period`` or ``gap``), ``start``, ``end``.

    A key may own most of the rows. The sums leave at most one row per key and distinct time; where
    times aren't bounded (as minutes of a day are), ``block`` gives the width of time blocks: counts are
    then carried from block to block, so that no task holds more than one block of a key.
    """
    names = list(keys)
    bounds = df.select(*(c.alias(n) for n, c in keys.items()), start.alias("_s"), end.alias("_e")).where(F.col("_s") < F.col("_e"))
    points = bounds.select(*names, F.inline(F.array(F.struct(F.col("_s").alias("_t"), F.lit(1).alias("_d")), F.struct(F.col("_e").alias("_t"), F.lit(-1).alias("_d")))))
    sums = points.groupBy(*names, "_t").agg(F.sum("_d").alias("_d")).where(F.col("_d") != 0)
    if block is None:
        return _periods(sums.withColumn("_base", F.lit(0).cast("bigint")), names, names)

    at = F.floor(F.col("_t") / block).alias("_b")
    blocks = sums.groupBy(*names, at).agg(F.sum("_d").alias("_sum"))
    carried = Window.partitionBy(*names).orderBy("_b")
    blocks = blocks.select(*names, "_b", (F.sum("_sum").over(carried) - F.col("_sum")).alias("_base"))
    same = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    left, right = sums.withColumn("_b", at).alias("l"), blocks.alias("r")
    joined = left.join(right, [*same, F.col("l._b") == F.col("r._b")]).select("l.*", "r._base")
    edges = _edges(joined, [*names, "_b"])
    first = edges.groupBy(*names, "_b").agg(F.min("_t").alias("_first"))
    ahead = first.select(*names, "_b", F.lead("_first").over(carried).alias("_ahead"))
    next_in_block = F.lead("_t").over(Window.partitionBy(*names, "_b").orderBy("_t"))
    left, right = edges.withColumn("_in", next_in_block).alias("l"), ahead.alias("r")
    return _name(left.join(right, [*same, F.col("l._b") == F.col("r._b")]).select("l.*", F.coalesce("l._in", "r._ahead").alias("_next")), names)


def _edges(sums: DataFrame, part: list[str]) -> DataFrame:
    """Only the points where the active count leaves or reaches zero."""
    w = Window.partitionBy(*part).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    active = sums.withColumn("_active", F.col("_base") + F.sum("_d").over(w))
    return active.where((F.col("_active") == 0) | (F.col("_active") == F.col("_d")))


def _periods(sums: DataFrame, names: list[str], part: list[str]) -> DataFrame:
    edges = _edges(sums, part)
    return _name(edges.withColumn("_next", F.lead("_t").over(Window.partitionBy(*part).orderBy("_t"))), names)


def _name(edges: DataFrame, names: list[str]) -> DataFrame:
    kind = F.when(F.col("_active") > 0, "period").otherwise("gap")
    return edges.where(F.col("_next").isNotNull()).select(*names, kind.alias("kind"), F.col("_t").alias("start"), F.col("_next").alias("end"))
