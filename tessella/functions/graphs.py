"""Components and cycles of graphs that stand as tables, by joins that double their reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stages import release, staged


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links (u, v): the least node that it is linked with, over any way.

    Each round a node takes the least label of its neighbours and then that
    label's own one, so chains shorten by halves. A round replaces the table of
    the last one.
    """
    edges = staged(links.select("u", "v").union(links.select("v", "u")).distinct(), narrow=True)
    labels = staged(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")), narrow=True)
    while True:
        offered = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("offer"))
        taken = labels.join(offered, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        further = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = staged(taken.join(further, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), narrow=True)
        settled = moved.where("old <> label").isEmpty()
        release(labels)
        labels = moved.select("node", "label")
        labels.staged_at = moved.staged_at
        if settled:
            release(edges)
            return labels


def ranked_cycles(nodes: DataFrame) -> DataFrame:
    """node, lead, steps of nodes (node, next) whose nexts are cycles: the least node of the cycle, and how many steps it is ahead.

    After k rounds a node knows the least of the next 2**k nodes; a round that
    changes nothing means that each has seen its whole cycle.
    """
    at = staged(nodes.select("node", "next", F.col("node").alias("lead"), F.lit(0).cast("long").alias("steps")), narrow=True)
    reach = 1
    while True:
        ahead = at.select(F.col("node").alias("there"), F.col("next").alias("beyond"), F.col("lead").alias("other"), (F.col("steps") + reach).alias("more"))
        better = F.col("other") < F.col("lead")
        moved = staged(
            at.join(ahead, F.col("next") == F.col("there")).select("node", F.col("beyond").alias("next"), F.when(better, F.col("other")).otherwise(F.col("lead")).alias("lead"), F.when(better, F.col("more")).otherwise(F.col("steps")).alias("steps"), better.alias("better")), narrow=True
        )
        settled = moved.where("better").isEmpty()
        release(at)
        at = moved.drop("better")
        at.staged_at = moved.staged_at
        if settled:
            return at.select("node", "lead", "steps")
        reach *= 2
