"""Versions of a day's payload, an append-only log, and current states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_progression(states: DataFrame, keys: list[str], order: list[str], digest: Column) -> DataFrame:
    """``states`` with ``version``: 1 for the first, one more whenever the digest differs from the one before.

    A, A, B, A are versions 1, 1, 2, 3. A null digest is a value of its own.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = states.withColumn("_h", digest).withColumn("_new", (~F.col("_h").eqNullSafe(F.lag("_h").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return marked.withColumn("version", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_h", "_new")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (last write wins), without sorting groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (insert and ignore repeats), without sorting groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def not_yet_there(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls included, aren't in the log."""
    there = log.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return rows.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def append(rows: DataFrame, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that an insert which ignores repeats would add to the log."""
    return not_yet_there(first_of(rows, keys, order), log, keys)


def version_gaps(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Versions that don't follow their predecessor by one (the first must be 1)."""
    w = Window.partitionBy(*keys).orderBy("version")
    return versions.withColumn("expected", F.coalesce(F.lag("version").over(w), F.lit(0)) + 1).where("version != expected")


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``: 1, 2, ... within each key by ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
