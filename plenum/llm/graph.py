"""Connected components of an edge list, and the pairs inside groups, in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b): the least node of each component.

    Labels spread to neighbours and are then replaced by their label's label, so the rounds grow with the logarithm of
    a chain's length. Every round is written to the checkpoint folder. A hub's labels are pre-aggregated by node.
    """
    both = cut(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("v"), "l"))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(near, labels["v"] == near["a"]).select("v", F.least("l", "m").alias("n"), F.col("l").alias("old"))
        jump = labels.select(F.col("v").alias("n"), F.col("l").alias("j"))
        new = cut(spread.join(jump, "n", "left").select("v", F.coalesce("j", "n").alias("l"), "old"))
        if not new.where("l <> old").limit(1).count():
            return new.select(F.col("v").alias("node"), F.col("l").alias("component"))
        labels = new.select("v", "l")


def all_pairs(members: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """(group, a, b) of every two nodes a < b of a group, whatever its size; (group, node) must be distinct.

    A group of more than `block` nodes is dealt over cells of about block x block pairs, so that no task holds it whole.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).join(members, group)
    dealt = sizes.withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    left = dealt.select(group, F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col(node).alias("a"))
    right = dealt.select(group, F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col(node).alias("b"))
    return left.join(right, [group, "_i", "_j"]).where("a < b").select(group, "a", "b")
