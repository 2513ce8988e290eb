"""Message passing from many queries over one graph, with nodes and queries that fare alike worked out once.

Nodes with the same incoming edges (src, rel, w) have equal states after every layer, whatever is asked, but for the
query's own head, where it starts. So a state belongs to a class of such nodes and to a profile of queries, whose
relation, head's class and head's outgoing edges are equal; the head has a row of its own (``own``). A message of the
rest of the head's class is that of the class, less the head's share. Sums are those of ``training``, whole multiples
of 2^-40, so states equal those of the graph as it is. A graph without such nodes costs what it cost unfolded.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlink.session import materialize

STEP = float(1 << 40)
AT = ["p", "c", "own", "dim"]


class Folded(NamedTuple):
    places: DataFrame  #: (node, c): the class of every node that hears anything, named by its smallest node
    edges: DataFrame  #: (src, rel, dst, w, n) of classes: each node of dst has n such edges from nodes of src
    queries: DataFrame  #: (q, head, p, c): profile of a query and class of its head
    heads: DataFrame  #: (p, c, rel)
    own: DataFrame  #: (p, c, rel, dst, w, n): edges of a profile's heads


def _units(x: Column) -> Column:
    return F.round(x * STEP).cast("long")


def _marks(*columns: str) -> list[Column]:
    """Fingerprint of a set of rows: their number and two 64-bit hashes, the same in any order."""
    return [F.count("*").alias("m0"), *[F.bit_xor(F.xxhash64(F.lit(salt), *columns)).alias(f"m{salt}") for salt in (1, 2)]]


MARKS = ["m0", "m1", "m2"]


def fold(edges: DataFrame, batch: DataFrame) -> Folded:
    """The graph (src, dst, rel, w) and the queries (q, head, rel), each q once, by classes and profiles."""
    if not batch.groupBy("q").count().where("count > 1").isEmpty():
        raise ValueError("a query has several heads")
    counted = materialize(edges.groupBy("src", "rel", "dst", "w").agg(F.count("*").alias("n")))
    marks = materialize(counted.groupBy(F.col("dst").alias("node")).agg(*_marks("src", "rel", "w", "n")))
    places = materialize(marks.join(marks.groupBy(*MARKS).agg(F.min("node").alias("c")), MARKS).select("node", "c"))
    # one member stands for its class as a target
    chosen = materialize(counted.join(places.where("node = c").select(F.col("c").alias("dst")), "dst", "left_semi"))
    by_class = chosen.join(places.withColumnRenamed("node", "src"), "src").groupBy(F.col("c").alias("src"), "rel", "dst", "w").agg(F.sum("n").alias("n"))
    own = chosen.join(batch.select(F.col("head").alias("src")).distinct(), "src", "left_semi")
    known = batch.select("q", "head", "rel").join(places.withColumnRenamed("node", "head"), "head", "left")
    known = known.join(own.groupBy(F.col("src").alias("head")).agg(*_marks("rel", "dst", "w", "n")), "head", "left")
    mark = F.concat_ws(":", *[F.xxhash64(F.lit(salt), "rel", "c", *MARKS).cast("string") for salt in (1, 2)])
    known = materialize(known.select("q", "head", "rel", "c", mark.alias("mark")))
    # a head that hears nothing is its own class
    heads = known.groupBy("mark").agg(F.min("q").alias("p"), F.min_by("head", "q").alias("first"), F.min(F.coalesce("c", "head")).alias("c"), F.min("rel").alias("rel"))
    heads = materialize(heads)
    return Folded(
        places,
        materialize(by_class),
        materialize(known.select("q", "head", "mark").join(heads.select("mark", "p", "c"), "mark").drop("mark")),
        heads.select("p", "c", "rel"),
        materialize(own.join(heads.select("p", "c", F.col("first").alias("src")), "src").select("p", "c", "rel", "dst", "w", "n")),
    )


def placed(folded: Folded, rows: DataFrame) -> DataFrame:
    """``rows`` (q, node, ...) with p, c and own; nodes that nothing reaches are left out."""
    d = rows.join(folded.queries.withColumnRenamed("c", "__c"), "q").join(folded.places, "node", "left").withColumn("own", F.col("node") == F.col("head"))
    return d.withColumn("c", F.when(F.col("own"), F.col("__c")).otherwise(F.col("c"))).where("c is not null").drop("__c", "head")


def _messages(folded: Folded, x: DataFrame, relation: DataFrame) -> DataFrame:
    """(p, src, own, rel, dst, dim, w, n, r, x): n messages of weight w; what the class's edges count of the head is taken off."""
    of_class = folded.edges.join(x.where("not own").select("p", F.col("c").alias("src"), "own", "dim", "x"), "src")
    of_head = folded.own.join(x.select(*AT, "x"), ["p", "c"]).withColumn("n", F.when(F.col("own"), F.col("n")).otherwise(-F.col("n"))).withColumnRenamed("c", "src")
    return of_class.unionByName(of_head).join(relation, ["rel", "dim"])


def forward(folded: Folded, boundary: DataFrame, relation: DataFrame, layers: int) -> list[DataFrame]:
    """As ``training.forward`` with sums, products and the residual: states (p, c, own, dim, x, y), each written; ``boundary`` (p, c, own, dim, x) lies at the heads."""
    states = [materialize(boundary.select(*AT, "x").withColumn("y", F.lit(None).cast("double")))]
    for _ in range(layers):
        before = states[-1].select(*AT, "x")
        m = _messages(folded, before, relation).select("p", F.col("dst").alias("c"), "dim", (F.col("n") * _units(F.col("w") * (F.col("r") * F.col("x")))).alias("u"))
        heard = m.groupBy("p", "c", "dim").agg(F.sum("u").alias("u")).join(folded.heads.select("p", F.col("c").alias("__c")), "p")
        both = F.when(F.col("c") == F.col("__c"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))  # the head hears what its class hears
        heard = heard.select("p", "c", F.explode(both).alias("own"), "dim", "u").unionByName(boundary.select(*AT, _units(F.col("x")).alias("u")))
        both = heard.withColumn("b", F.lit(None).cast("long")).unionByName(before.select(*AT, F.lit(None).cast("long").alias("u"), _units(F.col("x")).alias("b")))
        y = both.groupBy(*AT).agg((F.sum("u") / STEP).alias("y"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        states.append(materialize(y.withColumn("x", (_units(F.greatest("y", F.lit(0.0))) + F.col("b")) / STEP).select(*AT, "x", "y")))
    return states


def backward(folded: Folded, states: list[DataFrame], relation: DataFrame, grad: DataFrame) -> dict[str, DataFrame]:
    """Gradients through ``forward`` from ``grad`` (p, c, own, dim, g), summed over a profile's queries and the class's nodes: ``relation`` (rel, dim, g) and ``boundary`` (p, dim, g)."""
    by_relation, by_boundary = relation.select("rel", "dim", F.lit(0.0).alias("g")), None
    for state, earlier in zip(states[:0:-1], states[-2::-1], strict=True):
        own = grad.join(state.where("y > 0").select(*AT), AT)
        heard = own.groupBy("p", F.col("c").alias("dst"), "dim").agg((F.sum(_units(F.col("g"))) / STEP).alias("g"))
        wide = _messages(folded, earlier.select(*AT, "x"), relation).join(heard, ["p", "dst", "dim"])
        share = lambda c: F.col("n") * _units(F.col("g") * (F.col("w") * F.col(c)))
        parts = materialize(wide.select("p", F.col("src").alias("c"), "own", "rel", "dim", share("x").alias("gr"), share("r").alias("gx")))
        by_relation = by_relation.unionByName(parts.groupBy("rel", "dim").agg((F.sum("gr") / STEP).alias("g")))
        loop = own.where("own").select("p", "dim", "g")
        by_boundary = loop if by_boundary is None else by_boundary.unionByName(loop)
        below = parts.select(*AT, F.col("gx").alias("u")).unionByName(grad.select(*AT, _units(F.col("g")).alias("u")))
        grad = materialize(below.groupBy(*AT).agg((F.sum("u") / STEP).alias("g")))
    start = grad.join(states[0].select(*AT), AT).select("p", "dim", "g")
    by_boundary = start if by_boundary is None else by_boundary.unionByName(start)
    total = (F.sum(_units(F.col("g"))) / STEP).alias("g")
    return {"relation": by_relation.groupBy("rel", "dim").agg(total), "boundary": by_boundary.groupBy("p", "dim").agg(total)}
