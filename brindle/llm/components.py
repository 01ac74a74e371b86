"""Connected components of a distributed edge list by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import common

#: A key with more than this share of the rows is hot; so at most ``HOT`` keys are, a proven bound for their broadcast.
HOT = 1000


def looked_up(rows: DataFrame, total: int, table: DataFrame) -> DataFrame:
    """``rows(key, ...)`` joined with ``table(key, value)``, whose keys are unique and hold all of the rows' keys.

    A hub's rows never meet in one task: values of hot keys are broadcast, only rows of other keys are dealt by key."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * HOT > total).select("key")
    values = common.written(table.join(F.broadcast(hot), "key").select("key", F.col("value").alias("hot")))
    met = rows.join(F.broadcast(values), "key", "left")
    cold = met.where("hot is null").drop("hot").join(table, "key")
    return met.where("hot is not null").withColumnRenamed("hot", "value").unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction and repeated or not, to ``(node, root)`` with the smallest node reachable.

    Each round every node takes the smallest label among its neighbours, then its label's label; labels at least halve
    their distance along a chain, so rounds grow with the logarithm of the longest path. Each round is a table in
    the shared folder (a checkpoint would carry its filters into the next round's plan, which then doubles). Self links
    give a node its own component; null ends are left out; no edges give no rows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.written(both.where("a is not null and b is not null").distinct())
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    links, nodes = both.count(), labels.count()
    while True:
        known = labels.select(F.col("node").alias("key"), F.col("root").alias("value"))
        seen = looked_up(both.select("a", F.col("b").alias("key")), links, known).groupBy(F.col("a").alias("node")).agg(F.min("value").alias("near"))
        stepped = common.written(labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("key")))
        hop = stepped.select(F.col("node").alias("key"), F.col("key").alias("value"))
        jumped = looked_up(stepped, nodes, hop).select("node", "root", F.least("key", "value").alias("next"))
        moved = common.written(jumped.select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("changed")))
        labels = moved.select("node", "root")
        if not moved.where("changed").limit(1).count():
            return labels
