"""Selections over capture sessions and their images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finalizable(sessions: DataFrame, images: DataFrame, now: Column, idle_seconds: int = 25, state: str = "open") -> DataFrame:
    """Sessions in ``state`` whose last image is at least ``idle_seconds`` before ``now``.

    ``sessions``: session_id, user_id, state; ``images``: session_id, created_at. Result: session_id,
    user_id, last_image_at; sessions without images aren't among them. Images are reduced to one row a
    session before the join.
    """
    last = images.groupBy("session_id").agg(F.max("created_at").alias("last_image_at")).where(F.col("last_image_at") <= now - F.make_dt_interval(secs=F.lit(idle_seconds)))
    return sessions.where(F.col("state") == state).select("session_id", "user_id").distinct().join(last, "session_id")


def waiting(sessions: DataFrame, images: DataFrame, now: Column, idle_seconds: int = 25, state: str = "open") -> DataFrame:
    """Number of sessions in ``state`` with no image yet, or one too new: ``waiting``."""
    still = sessions.where(F.col("state") == state).select("session_id").distinct()
    return still.join(finalizable(sessions, images, now, idle_seconds, state), "session_id", "left_anti").agg(F.count("*").alias("waiting"))


def claim_order(sessions: DataFrame, first: str, again: str, stale_before: Column, count: int = 1) -> DataFrame:
    """The next ``count`` sessions to work on: those in state ``first``, then those in ``again`` since before ``stale_before``.

    A top-k by state, age and id; no full sort.
    """
    due = (F.col("state") == first) | ((F.col("state") == again) & (F.col("created_at") < stale_before))
    rank = F.when(F.col("state") == first, 0).otherwise(1)
    return sessions.where(due).select("session_id", "user_id", "state", "created_at").distinct().orderBy(rank, "created_at", "session_id").limit(count)


def image_names(images: DataFrame) -> DataFrame:
    """For each session the distinct file names of its images in order of sequence: session_id, names.

    ``images``: session_id, sequence, object_key. A blank key gives ``sequence-N``, or ``unknown-image``.
    """
    base = F.element_at(F.split(F.rtrim(F.coalesce("object_key", F.lit("")), F.lit("/")), "/"), -1)
    name = F.when(base != "", base).otherwise(F.coalesce(F.concat(F.lit("sequence-"), F.col("sequence").cast("string")), F.lit("unknown-image")))
    listed = F.array_sort(F.collect_list(F.struct("sequence", "object_key", name.alias("name"))))
    return images.groupBy("session_id").agg(F.array_distinct(F.transform(listed, lambda x: x["name"])).alias("names"))


def object_key(key: Column, prefix: str) -> Column:
    """An object's key under ``prefix``, added once, without slashes in front."""
    bare, head = F.regexp_replace(key, "^/+", ""), prefix.strip("/")
    return bare if not head else F.when(bare.startswith(head + "/"), bare).otherwise(F.concat(F.lit(head + "/"), bare))


def looked_up(keys: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """The row of each distinct key, and ``error`` where there is none (``not found``)."""
    found = rows.distinct().withColumn("_there", F.lit(True))
    return keys.select(*by).distinct().join(found, by, "left").withColumn("error", F.when(F.col("_there").isNull(), "not found")).drop("_there")
