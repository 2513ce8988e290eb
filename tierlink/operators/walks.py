"""k-best walks kept as tables of back-pointers, and the paths that a target's gradient prefers.

A layer's table holds (keys, node, rank, score, src, rel, prev): the walk's last edge comes from entry ``prev`` of
node ``src`` in the layer before. Rows are of the same size at any length; only the walks that are
asked for are traced back, by one join a layer. A node's best entries are found by a ranked window, which Spark
cuts to ``beam`` rows a node before the shuffle, so a hub costs no more than another node.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions.numeric import is_close
from tierlink.operators.training import exact_sum, forward, messages
from tierlink.session import materialize

HOP = "struct<head:string,rel:string,tail:string>"


def walk_tables(start: DataFrame, hop: Callable[[DataFrame, int], DataFrame], layers: int, beam: int, keys: Sequence[str] = (), apart: bool = False) -> list[DataFrame]:
    """One table of back-pointers for each layer.

    ``start`` (keys, node, score) has one row a node. ``hop`` maps a layer's entries (keys, src, prev, before) and its number to
    edges (keys, src, prev, rel, dst, score). ``apart``: of a node's entries with scores that are close, only the first goes on.
    Ties go to the smaller src, then rel, then prev.
    """
    tables = []
    front = start.select(*keys, "node", F.lit(0).alias("rank"), "score")
    for layer in range(layers):
        if apart and layer:
            earlier = F.lag("score").over(Window.partitionBy(*keys, "node").orderBy("rank"))
            front = front.withColumn("__e", earlier).where(F.col("__e").isNull() | ~is_close(F.col("score"), F.col("__e"))).drop("__e")
        step = hop(front.select(*keys, F.col("node").alias("src"), F.col("rank").alias("prev"), F.col("score").alias("before")), layer)
        order = Window.partitionBy(*keys, "dst").orderBy(F.round("score", 12).desc(), "src", "rel", "prev")
        best = step.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam)
        front = materialize(best.select(*keys, F.col("dst").alias("node"), (F.col("rank") - 1).alias("rank"), "score", "src", "rel", "prev"))
        tables.append(front)
    return tables


def traced(tables: list[DataFrame], ends: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``ends`` (keys, node, rank, ...), entries of the last of ``tables``, with path, an array of (head, rel, tail) hops."""
    rows = ends.select("*", F.col("node").alias("__node"), F.col("rank").alias("__rank"), F.expr(f"cast(array() as array<{HOP}>)").alias("path"))
    for table in reversed(tables):
        own = table.select(*keys, F.col("node").alias("__node"), F.col("rank").alias("__rank"), F.col("src").alias("__src"), "rel", F.col("prev").alias("__prev"))
        hop = F.struct(F.col("__src").cast("string").alias("head"), F.col("rel").cast("string").alias("rel"), F.col("__node").cast("string").alias("tail"))
        rows = rows.join(own, [*keys, "__node", "__rank"]).withColumn("path", F.concat(F.array(hop), "path"))
        rows = rows.drop("__node", "__rank", "rel").withColumnsRenamed({"__src": "__node", "__prev": "__rank"})
    return rows.drop("__node", "__rank")


def path_text(path: str = "path"):
    return F.array_join(F.transform(path, lambda h: F.concat(h["head"], F.lit(">"), h["rel"], F.lit(">"), h["tail"])), ";")


def flow_walks(flows: DataFrame, prior: DataFrame, layers: int, beam: int, targets: DataFrame | None = None) -> DataFrame:
    """(node, rank, score, path): the ``beam`` best walks of exactly ``layers`` hops to each node, or to ``targets`` (node), by back-pointers."""
    def hop(front: DataFrame, layer: int) -> DataFrame:
        own = flows.where(F.col("layer") == layer).select("src", "dst", "rel", "log_flow")
        if targets is not None and layer == layers - 1:
            own = own.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
        return front.join(own, "src").withColumn("score", F.col("before") + F.col("log_flow"))

    tables = walk_tables(prior.select("node", F.col("log_mass").alias("score")), hop, layers, beam)
    return traced(tables, tables[-1].select("node", "rank", "score"))


def gradient_walks(edges: DataFrame, by_layer: list[DataFrame], sources: DataFrame, targets: DataFrame, beam: int = 10, apart: bool = True) -> list[DataFrame]:
    """Tables of the walks from ``sources`` (node) with the largest sums of gradients (t, edge, g), one table a layer.

    Each target t (``targets``) has walks of its own, none of which goes on from t; edges without a gradient count 0.
    ``apart``: as in ``walk_tables``.
    """
    def hop(front: DataFrame, layer: int) -> DataFrame:
        step = front.where("src <> t").join(edges.select("edge", "src", "rel", "dst"), "src").join(by_layer[layer].select("t", "edge", "g"), ["t", "edge"], "left")
        return step.withColumn("score", F.col("before") + F.coalesce("g", F.lit(0.0)))

    # the stated targets times the query's sources
    start = targets.select("t").distinct().join(sources.select("node").distinct()).withColumn("score", F.lit(0.0))
    return walk_tables(start, hop, len(by_layer), beam, ["t"], apart)


def average_length(tables: list[DataFrame], k: int = 10) -> DataFrame:
    """(t, place, mean, path): the ``k`` walks of any length to each target with the largest score a hop; shorter ones first among equals."""
    found = []
    for i, table in enumerate(tables):
        found.append(table.where((F.col("node") == F.col("t")) & (F.col("rank") < k)).select("t", "node", "rank", F.lit(i).alias("layer"), (F.col("score") / (i + 1)).alias("mean")))
    order = Window.partitionBy("t").orderBy(F.round("mean", 12).desc(), "layer", "rank")
    best = materialize(reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
    parts = [traced(tables[: i + 1], best.where(F.col("layer") == i), ["t"]) for i in range(len(tables))]
    return reduce(DataFrame.unionByName, parts).select("t", "place", "mean", "path")


def explained(edges: DataFrame, boundary: DataFrame, relation: DataFrame, query: DataFrame, targets: DataFrame, layers: int, beam: int = 10, k: int = 10, apart: bool = True) -> DataFrame:
    """``average_length`` walks of the model of ``forward``: the score of a target is its state times ``query`` (dim, q).

    All targets (t) go back through the layers together. Sources are the nodes of ``boundary``. Without ``apart``, walks of close scores all count.
    """
    states = forward(edges, boundary, relation, layers)
    top = targets.select("t", F.col("t").alias("node")).distinct().join(F.broadcast(query)).select("t", "node", "dim", F.col("q").alias("g"))  # one vector a target
    by_layer = backward_targets(edges, states, relation, top)
    return average_length(gradient_walks(edges, by_layer, boundary.select("node"), targets, beam, apart), k)


def backward_targets(edges: DataFrame, states: list[DataFrame], relation: DataFrame, top: DataFrame) -> list[DataFrame]:
    """Gradients (t, edge, g) of each layer for targets that share their states: only states that a target's gradient reaches are repeated for it."""
    by_layer, grad = [], top
    for state, earlier in zip(states[:0:-1], states[-2::-1], strict=True):
        own = grad.join(state.where("y > 0").select("node", "dim"), ["node", "dim"]).withColumnRenamed("node", "dst")
        wide = messages(edges, earlier.select("node", "dim", "x"), relation).join(own, ["dst", "dim"])
        parts = materialize(wide.select("t", "edge", "src", "dim", (F.col("g") * F.col("r") * F.col("x")).alias("ge"), (F.col("g") * F.col("w") * F.col("r")).alias("gx")))
        by_layer.insert(0, parts.groupBy("t", "edge").agg(exact_sum(F.col("ge")).alias("g")))
        both = parts.select("t", F.col("src").alias("node"), "dim", F.col("gx").alias("g")).unionByName(grad.select("t", "node", "dim", "g"))
        grad = materialize(both.groupBy("t", "node", "dim").agg(exact_sum(F.col("g")).alias("g")))
    return by_layer
