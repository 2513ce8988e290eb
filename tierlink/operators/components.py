"""Connected components over an edge table, with labels kept in tables and never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached over ``edges``.

    Each round points every node to its smallest neighbour below it, follows the pointers to their ends and contracts
    the graph to these: two rounds at least halve the nodes, and nodes whose neighbours below are one leave at once. What
    is left is worked out on ever smaller tables; the pointers of a round are then followed once. All joins have a
    shuffle on either side, so AQE can split a hub's rows. Nodes without an edge aren't in the result; edges
    with a null end are ignored; directions, repeats and self-loops don't matter.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    first = materialize(known.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct())
    left, levels = first.where("a < b"), []
    for _ in range(max_rounds):
        down = materialize(left.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi")))
        if down.isEmpty():
            break
        pointers = down.select(F.col("b").alias("node"), F.col("lo").alias("label"))
        ends = _ends(pointers)
        level = _followed(pointers, ends)
        levels.append(level)
        rest = left.join(down.where("lo < hi"), "b").where("a <> lo").select("a", "lo").distinct()
        moved = _followed(rest.withColumnRenamed("lo", "label"), ends).join(level.select(F.col("node").alias("a"), F.col("label").alias("__a")), "a", "left").withColumn("a", F.coalesce("__a", "a"))
        left = materialize(moved.where("a <> label").select(F.least("a", "label").alias("a"), F.greatest("a", "label").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = None
    for level in reversed(levels):
        found = level if found is None else materialize(_followed(level, found).unionByName(found))  # no node is in two levels
    if found is None:
        return first.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    found = materialize(found) if len(levels) == 1 else found
    every = found.unionByName(found.select("label").distinct().select(F.col("label").alias("node"), "label"))
    loops = first.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    if not loops.isEmpty():
        every = every.unionByName(loops.join(every, "node", "left_anti"))
    return every.select("node", F.col("label").alias("component"))


def _followed(rows: DataFrame, ends: DataFrame | None) -> DataFrame:
    """``rows`` with labels replaced by where they point to in ``ends`` (node, label)."""
    if ends is None:
        return rows
    return rows.join(ends.select(F.col("node").alias("label"), F.col("label").alias("__end")), "label", "left").withColumn("label", F.coalesce("__end", "label")).drop("__end").select(*rows.columns)


def _ends(pointers: DataFrame) -> DataFrame | None:
    """(node, label): last node of the pointers' chain from each label that points on; None if there is none."""
    inner = materialize(pointers.join(pointers.select(F.col("label").alias("node")).distinct(), "node", "left_semi"))
    if inner.isEmpty():
        return None
    while True:
        again = materialize(inner.join(inner.select(F.col("node").alias("label"), F.col("label").alias("__end")), "label", "left").select("node", F.coalesce("__end", "label").alias("label"), F.col("__end").isNotNull().alias("moved")))
        inner = again.select("node", "label")
        if again.where("moved").isEmpty():
            return inner
