"""Tables that are written: guarded updates, owned inserts, logs that ignore repeats, states where the last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from rotaloom.operators.versions import append, latest, not_yet_there
from rotaloom.session import cut_lineage, drop_table


def guarded_update(rows: DataFrame, guard: Column, **changes: Column) -> DataFrame:
    """``rows`` with ``changes`` where ``guard`` holds (null counts as not), and ``matched``: whether it did.

    All changes see the row as it was. The number of matched rows is what an update would report.
    """
    held = rows.withColumn("matched", F.coalesce(guard, F.lit(False)))
    return held.select(*(F.when(F.col("matched"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns), "matched")


def owned(rows: DataFrame, owners: DataFrame, keys: list[str], owning: Column) -> DataFrame:
    """The rows whose ``keys`` are in ``owners`` where ``owning`` holds; others may not write."""
    return rows.join(owners.where(owning).select(*keys).distinct(), keys, "left_semi")


def insert_owned(rows: DataFrame, owners: DataFrame, owner_keys: list[str], owning: Column, there: DataFrame, keys: list[str]) -> DataFrame:
    """The owned rows whose ``keys`` aren't in the table yet."""
    return not_yet_there(owned(rows, owners, owner_keys, owning), there, keys)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` after ``rows`` were written into it: each key's last row by ``order``, written ones before
    those that stood there at equal order."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).drop("_new")


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_log(path: str, rows: DataFrame, keys: list[str], order: list[str]) -> int:
    """Appends to the log at ``path`` the rows whose keys it lacks, the first of each key by ``order``, and
    returns their number. A rerun adds nothing. One writer at a time."""
    spark = rows.sparkSession
    fresh = cut_lineage(append(rows, read_log(spark, path, rows.schema), keys, order))
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    drop_table(fresh)
    return count


def write_state(path: str, rows: DataFrame, keys: list[str], order: list[str]) -> int:
    """Writes the last row of each key by ``order`` behind the states at ``path`` where it is new or newer, and
    returns their number. ``read_state`` takes each key's last. One writer at a time."""
    spark = rows.sparkSession
    there = read_state(spark, path, rows.schema, keys, order)
    ranked = latest(rows, keys, order).select(*rows.columns)
    old = there.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*order).alias("_old"))
    fresh = ranked.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").where(F.col("_old").isNull() | (F.struct(*order) > F.col("_old"))).select(*rows.columns)
    fresh = cut_lineage(fresh)
    count = fresh.count()
    if count:
        fresh.write.mode("append").parquet(path)
    drop_table(fresh)
    return count


def read_state(spark: SparkSession, path: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """The current state of each key at ``path``."""
    return latest(read_log(spark, path, schema), keys, order).select(*(f.name for f in schema))
