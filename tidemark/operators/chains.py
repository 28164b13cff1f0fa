"""Chains of parents or successors of any length, by pointer doubling.

Every node points to its parent; in a round each pointer is replaced by the pointer of the node it points to, so after
k rounds it reaches 2^k steps up. A chain of a million steps takes twenty rounds of one join each. Nodes that have
arrived leave the rounds, and so does everything whose pointer can't arrive: nodes on a cycle, or below one, are found by
the bound on the rounds and told apart instead of going round for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import checkpointed


def resolve(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, steps, cyclic) of every node: the end of its chain of parents and the steps to it.

    A node without a row of its own, known as a parent alone, is a root and has no row here. A null parent makes a
    root. Nodes on or below a cycle have no root and are `cyclic`. Of several rows of a node the least parent counts;
    rows without a node are left out. What is arrived and what isn't are written apart after every round (checkpoints),
    so lost executors cost no earlier round.
    """
    table = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    table = checkpointed(table)
    rooted = table.filter("up is null").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("steps"))
    parts = [rooted]
    going = table.filter("up is not null").select("node", "up", F.lit(1).cast("long").alias("steps"))
    # a parent without a row, or without a parent of its own, ends a chain
    inner = table.filter("up is not null").select(F.col("node").alias("up"), F.lit(True).alias("_on"))
    going = checkpointed(going.join(inner, "up", "left").withColumn("_on", F.col("_on").isNotNull()))
    nodes, rounds = going.count(), 0
    while True:
        parts.append(going.filter(~F.col("_on")).select("node", F.col("up").alias("root"), "steps"))
        moving = going.filter("_on").select("node", "up", "steps")
        if moving.isEmpty() or 2 ** rounds > nodes:
            break
        # the pointers of all nodes that have one: arrived ones end the walk, moving ones lengthen it
        ahead = going.select(F.col("node").alias("_at"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), "_on")
        going = checkpointed(moving.join(ahead, F.col("up") == F.col("_at")).select(
            "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), "_on")
            .unionByName(going.filter(~F.col("_on"))))
        parts = parts[:1]
        rounds += 1
    lost = moving.select("node", F.lit(None).cast(rooted.schema["root"].dataType).alias("root"),
                         F.lit(None).cast("long").alias("steps"), F.lit(True).alias("cyclic"))
    found = parts[0].unionByName(parts[-1]).withColumn("cyclic", F.lit(False))
    return found.unionByName(lost)
