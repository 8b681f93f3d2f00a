"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.session import cut_lineage, drop_table


def components(links: DataFrame) -> DataFrame:
    """The least node of each node's component.

    ``links``: ``a``, ``b`` (numbers). Result: ``node``, ``root``; nodes without a link to another are
    absent. Null ends are dropped; repeated links and loops don't matter; no links give no rows.

    Each round lets every node take the least root among itself and its neighbours, then the root of
    that root, so a chain's length is halved at least; the loop ends when nothing changes. Roots are
    combined before the shuffle, so a hub costs no more than its links. State is kept in
    written tables in the shared folder; each is deleted when the next is there.
    """
    edges = links.where("a is not null and b is not null and a != b").select("a", "b")
    edges = cut_lineage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:  # roots only fall, so this ends
        now = roots.select("node", "root")
        near = edges.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        onward = roots.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = step.join(onward, "mid", "left").select("node", "old", F.coalesce(F.least("mid", "far"), "mid").alias("root"))
        step = cut_lineage(step)
        drop_table(roots)
        roots = step
        if step.where("old != root").isEmpty():
            drop_table(edges)
            return roots.select("node", "root")
