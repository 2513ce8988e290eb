"""Training of relational message passing: gradients as joins, losses' gradients, a resumable optimiser, parameter bundles.

States are long tables (keys, node, dim, x): ``keys`` may name a batch's queries or targets, so that all of a batch
goes through the same joins. A reverse pass joins the edges the other way round. Edges are (edge, src, dst, rel, w).

Sums of doubles depend on the order in which a shuffle delivers rows, so those that parameters are made of are
sums of whole multiples of 2^-40: two runs give equal parameters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierlink.functions.numeric import sigmoid, softmax
from tierlink.operators import folded as folding
from tierlink.operators.folded import Folded, fold, placed
from tierlink.operators.graph import draw_negatives
from tierlink.session import materialize
from tierlink.sources.sinks import exists

STEP = float(1 << 40)


def exact_sum(x: Column) -> Column:
    """Sum in whole multiples of 2^-40, the same in any order."""
    return F.sum(F.round(x * STEP).cast("long")) / STEP


# -- G6: gradients of one layer ---------------------------------------------------------------------
def messages(edges: DataFrame, x: DataFrame, relation: DataFrame, mul: str = "mul") -> DataFrame:
    """(keys, edge, src, dst, rel, w, dim, x, r, m): m = w * (r mul x) for each edge and dim of its source."""
    m = F.col("w") * (F.col("r") * F.col("x") if mul == "mul" else F.col("r") + F.col("x"))
    return edges.join(x.withColumnRenamed("node", "src"), "src").join(relation, ["rel", "dim"]).withColumn("m", m)


def spmm_gradients(edges: DataFrame, x: DataFrame, relation: DataFrame, grad: DataFrame, add: str = "sum", mul: str = "mul", keys: Sequence[str] = (), out: DataFrame | None = None) -> dict[str, DataFrame]:
    """Gradients of ``spmm`` from those of its result (keys, node, dim, g).

    ``edge`` (keys, edge, g), ``relation`` (rel, dim, g) and ``state`` (keys, node, dim, g). A minimum or maximum hands its
    gradient to every edge that attains it; ``out`` (keys, node, dim, x) is its value if something else
    took part in it too. What gets no gradient is absent.
    """
    wide = messages(edges, x, relation, mul)
    if add != "sum":
        if out is None:
            out = wide.groupBy(*keys, F.col("dst").alias("node"), "dim").agg({"min": F.min, "max": F.max}[add]("m").alias("x"))
        extreme = out.select(*keys, F.col("node").alias("dst"), "dim", F.col("x").alias("__out"))
        wide = wide.join(extreme, [*keys, "dst", "dim"]).where("m = __out")
    wide = wide.join(grad.withColumnRenamed("node", "dst"), [*keys, "dst", "dim"])
    by_edge = F.col("r") * F.col("x") if mul == "mul" else F.col("r") + F.col("x")
    by_relation, by_state = (F.col("w") * F.col(o) if mul == "mul" else F.col("w") for o in ("x", "r"))
    # three groupings of the same joined rows, which are written once instead of being joined three times
    parts = materialize(wide.select(*keys, "edge", "src", "rel", "dim", (F.col("g") * by_edge).alias("ge"), (F.col("g") * by_relation).alias("gr"), (F.col("g") * by_state).alias("gx")))
    return {
        "edge": parts.groupBy(*keys, "edge").agg(exact_sum(F.col("ge")).alias("g")),
        "relation": parts.groupBy("rel", "dim").agg(exact_sum(F.col("gr")).alias("g")),
        "state": parts.groupBy(*keys, F.col("src").alias("node"), "dim").agg(exact_sum(F.col("gx")).alias("g")),
    }


# -- layers, forwards and back -----------------------------------------------------------------------
def forward(edges: DataFrame, boundary: DataFrame, relation: DataFrame, layers: int, keys: Sequence[str] = (), add: str = "sum", mul: str = "mul", residual: bool = True) -> list[DataFrame]:
    """States (keys, node, dim, x, y) after 0 to ``layers`` layers, each written: y is the aggregate with the boundary as a self-loop, x = relu(y), plus the earlier x if ``residual``."""
    at = [*keys, "node", "dim"]
    states = [materialize(boundary.select(*at, "x").withColumn("y", F.lit(None).cast("double")))]
    gather = {"sum": exact_sum, "min": F.min, "max": F.max}[add]
    for _ in range(layers):
        before = states[-1].select(*at, "x")
        m = messages(edges, before, relation, mul).select(*keys, F.col("dst").alias("node"), "dim", "m")
        y = m.unionByName(boundary.select(*at, F.col("x").alias("m"))).groupBy(*at).agg(gather(F.col("m")).alias("y"))
        x = y.withColumn("x", F.greatest("y", F.lit(0.0)))
        if residual:
            both = x.unionByName(before.withColumn("y", F.lit(None).cast("double")))
            x = both.groupBy(*at).agg(exact_sum(F.col("x")).alias("x"), F.max("y").alias("y"))
        states.append(materialize(x.select(*at, "x", "y")))
    return states


def backward(edges: DataFrame, states: list[DataFrame], boundary: DataFrame, relation: DataFrame, grad: DataFrame, keys: Sequence[str] = (), add: str = "sum", mul: str = "mul", residual: bool = True) -> dict:
    """Gradients through ``forward`` from those of its last state (keys, node, dim, g).

    ``layers``: one (keys, edge, g) a layer, as if each had edge weights of its own; ``relation`` (rel, dim, g);
    ``boundary`` (keys, node, dim, g). Both are sums over the layers.
    """
    at = [*keys, "node", "dim"]
    by_layer, by_relation, by_boundary = [], [], []
    for state, earlier in zip(states[:0:-1], states[-2::-1], strict=True):
        y = state.where("y > 0").select(*at, F.col("y").alias("x"))
        own = grad.join(y.select(*at), at)
        found = spmm_gradients(edges, earlier.select(*at, "x"), relation, own, add, mul, keys, y if add != "sum" else None)
        by_layer.insert(0, found["edge"])
        by_relation.append(found["relation"])
        loop = own.join(boundary.select(*at, F.col("x").alias("__b")), at)
        if add != "sum":
            loop = loop.join(y, at).where("__b = x")
        by_boundary.append(loop.select(*at, "g"))
        parts = found["state"].select(*at, "g")
        if residual:
            parts = parts.unionByName(grad.select(*at, "g"))
        grad = materialize(parts.groupBy(*at).agg(exact_sum(F.col("g")).alias("g")))
    by_boundary.append(grad.join(boundary.select(*at), at).select(*at, "g"))

    def summed(parts: list[DataFrame], by: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(exact_sum(F.col("g")).alias("g"))

    none = relation.select("rel", "dim", F.lit(0.0).alias("g"))
    return {"layers": by_layer, "relation": summed([none, *by_relation], ["rel", "dim"]), "boundary": summed(by_boundary, at)}


# -- A28-A30: gradients of the losses ----------------------------------------------------------------
def bce_gradient(df: DataFrame, keys: Sequence[str], temperature: float = 0.0) -> DataFrame:
    """``df`` (keys, score, target) with g, the gradient of ``metrics.bce_loss`` by each score.

    The weights of negatives are constants of the gradient, as in the loss.
    """
    side = [*keys, "target"]
    d = df.withColumn("__n", F.count("*").over(Window.partitionBy(*side)))
    even = 1 / F.col("__n")
    if temperature > 0:
        d = softmax(d.withColumn("__x", F.col("score") / temperature), "__x", side, "__s")
        even = F.when(F.col("target") == 1, even).otherwise(F.col("__s"))
    d = d.withColumn("__w", even)
    rows = df.select(*keys).distinct().agg(F.count("*").alias("__rows"))  # one row
    slope = F.col("__w") * (sigmoid(F.col("score")) - F.col("target")) / F.sum("__w").over(Window.partitionBy(*keys))
    return d.withColumn("g", slope).join(F.broadcast(rows)).withColumn("g", F.col("g") / F.col("__rows")).select(*df.columns, "g")


def list_ce_gradient(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` (keys, score, target) with g, the gradient of ``metrics.list_ce_loss``; samples without a positive have none."""
    own = Window.partitionBy(*keys)
    p, total = sigmoid(F.col("score")), F.col("__total")
    d = df.withColumns({"__p": p, "__positive": (F.col("target") == 1).cast("int")})
    d = d.withColumns({"__total": F.sum("__p").over(own) + 1e-5, "__k": F.sum("__positive").over(own)})
    pull = F.when(F.col("target") == 1, -1 / ((F.col("__p") / total + 1e-5) * F.col("__k"))).otherwise(0.0)
    d = d.withColumn("__a", pull)
    shared = F.sum(F.col("__a") * F.col("__p")).over(own) / (total * total)
    g = F.when(F.col("__k") > 0, (F.col("__a") / total - shared) * F.col("__p") * (1 - F.col("__p"))).otherwise(0.0)
    counted = df.where("target = 1").select(*keys).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("__rows"))  # one row
    return d.withColumn("g", g).join(F.broadcast(counted)).withColumn("g", F.col("g") / F.col("__rows")).select(*df.columns, "g")


# -- parameters: (name, key, dim, value, first, second) ----------------------------------------------
def parameters(named: dict[str, DataFrame]) -> DataFrame:
    """Parameter table of arrays (key, dim, value), with both moments at 0."""
    parts = [t.select(F.lit(n).alias("name"), F.col("key").cast("string").alias("key"), F.col("dim").cast("int").alias("dim"), F.col("value").cast("double").alias("value")) for n, t in named.items()]
    return reduce(DataFrame.unionByName, parts).withColumns({"first": F.lit(0.0), "second": F.lit(0.0)})


def array_of(params: DataFrame, name: str, key: str, value: str) -> DataFrame:
    return params.where(F.col("name") == name).select(F.col("key").alias(key), "dim", F.col("value").alias(value))


def adam(params: DataFrame, grads: DataFrame, step: int, rate: float = 0.05, decay: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> DataFrame:
    """Parameters after step number ``step`` (from 1) of Adam; those without a gradient (name, key, dim, g) take 0."""
    d = params.join(grads.select("name", F.col("key").cast("string").alias("key"), F.col("dim").cast("int").alias("dim"), "g"), ["name", "key", "dim"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    first = decay[0] * F.col("first") + (1 - decay[0]) * F.col("g")
    second = decay[1] * F.col("second") + (1 - decay[1]) * F.col("g") * F.col("g")
    d = d.withColumns({"first": first, "second": second})
    move = rate * (F.col("first") / (1 - decay[0] ** step)) / (F.sqrt(F.col("second") / (1 - decay[1] ** step)) + eps)
    return d.withColumn("value", F.col("value") - move).select("name", "key", "dim", "value", "first", "second")


def save_bundle(params: DataFrame, config: dict, path: str) -> None:
    """Named arrays as Parquet and the configuration beside them; the folder must be new."""
    params.write.partitionBy("name").parquet(f"{path}/arrays")
    spark = params.sparkSession
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.parquet(f"{path}/config")  # last, so a bundle with a configuration is whole


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(parameters, configuration) of a bundle; an error if it isn't whole."""
    config = spark.read.parquet(f"{path}/config").first()["config"]
    params = spark.read.parquet(f"{path}/arrays").select("name", F.col("key").cast("string").alias("key"), F.col("dim").cast("int").alias("dim"), "value", "first", "second")
    return params.withColumn("name", F.col("name").cast("string")), json.loads(config)


# -- the model and its fitting loop -------------------------------------------------------------------
def initial(edges: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    """Parameters of the link model: for each relation a message (``relation``) and a start (``query``) vector, and read-out weights (``out``).

    Values lie between 0.2 and 1 by hash.
    """
    rel = edges.select(F.col("rel").cast("string").alias("key")).distinct().withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))))
    one = edges.sparkSession.range(1).select(F.lit("all").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))

    def drawn(df: DataFrame, salt: str) -> DataFrame:
        return df.withColumn("value", 0.2 + 0.8 * F.pmod(F.xxhash64(F.lit(f"{salt}{seed}"), "key", "dim"), F.lit(1 << 30)) / float(1 << 30))

    return parameters({"relation": drawn(rel, "relation"), "query": drawn(rel, "query"), "out": drawn(one, "out")})


def scored(edges: DataFrame, params: DataFrame, batch: DataFrame, candidates: DataFrame, layers: int) -> tuple[DataFrame, Folded, list[DataFrame]]:
    """(candidates with score, folded graph, states): links (q, head, rel) propagated from their heads; candidates are (q, node, ...).

    States are those of ``folded.forward``: nodes and queries that fare alike are worked out once.
    """
    folded = fold(edges, batch)
    boundary = folded.heads.join(array_of(params, "query", "rel", "x"), "rel").withColumn("own", F.lit(True))
    states = folding.forward(folded, boundary, array_of(params, "relation", "rel", "r"), layers)
    out = array_of(params, "out", "__all", "o").drop("__all")
    reached = states[-1].join(out, "dim").groupBy("p", "c", "own").agg(exact_sum(F.col("x") * F.col("o")).alias("score"))
    score = placed(folded, candidates.select("q", "node").distinct()).join(reached, ["p", "c", "own"]).select("q", "node", "score")
    return candidates.join(score, ["q", "node"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))), folded, states


def gradients(edges: DataFrame, params: DataFrame, batch: DataFrame, rows: DataFrame, folded: Folded, states: list[DataFrame]) -> DataFrame:
    """(name, key, dim, g) of all parameters, from scored candidates with their gradient g; ``folded`` and ``states`` are those of ``scored``."""
    at = ["p", "c", "own"]
    own = placed(folded, rows.groupBy("q", "node").agg(exact_sum(F.col("g")).alias("g")))
    by_out = own.join(states[-1].select(*at, "dim", "x"), at).groupBy("dim").agg(exact_sum(F.col("g") * F.col("x")).alias("g"))
    out = array_of(params, "out", "__all", "o").drop("__all")
    last = own.groupBy(*at).agg(exact_sum(F.col("g")).alias("g")).join(states[-1].select(*at, "dim"), at)
    top = last.join(out, "dim").select(*at, "dim", (F.col("g") * F.col("o")).alias("g"))
    found = folding.backward(folded, states, array_of(params, "relation", "rel", "r"), materialize(top))
    by_query = found["boundary"].join(folded.heads.select("p", "rel"), "p").groupBy("rel", "dim").agg(exact_sum(F.col("g")).alias("g"))

    def named(name: str, df: DataFrame, key: Column) -> DataFrame:
        return df.select(F.lit(name).alias("name"), key.cast("string").alias("key"), "dim", "g")

    return named("out", by_out, F.lit("all")).unionByName(named("relation", found["relation"], F.col("rel"))).unionByName(named("query", by_query, F.col("rel")))


def fit(
    edges: DataFrame,
    links: DataFrame,
    nodes: DataFrame,
    path: str,
    steps: int,
    dims: int = 8,
    layers: int = 2,
    negatives: int = 8,
    batches: int = 1,
    rate: float = 0.05,
    temperature: float = 0.0,
    seed: int = 1,
    gradient: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(parameters, losses) after ``steps`` mini-batch steps of fitting the link model.

    ``links`` (q, head, rel, tail) are told from drawn tails (G18); a batch's own links are taken out of the
    edges (F8). Batches are the links of equal hash modulo ``batches``, in turn. Every step leaves its
    parameters, moments and loss in ``path``/step-N, the loss last; a run that finds steps there goes on behind
    the last whole one. ``gradient`` turns (q, node, score, target) into rows with g and l, its loss; the default is ``bce_gradient``.
    """
    from tierlink.operators.metrics import bce_loss

    spark = edges.sparkSession
    loss_of = None if gradient else (lambda rows: bce_loss(rows, ["q"], temperature))
    slope = gradient or (lambda rows: bce_gradient(rows, ["q"], temperature))
    done, losses = 0, []
    while done < steps and exists(spark, f"{path}/step-{done + 1}/loss/_SUCCESS"):
        done += 1
        losses.append(spark.read.parquet(f"{path}/step-{done}/loss"))
    params = spark.read.parquet(f"{path}/step-{done}/parameters") if done else materialize(initial(edges, dims, seed))
    graph = materialize(edges)
    for step in range(done + 1, steps + 1):
        turn = F.pmod(F.xxhash64(F.lit(seed), "q"), F.lit(batches)) == (step - 1) % batches
        batch = materialize(links.where(turn).select("q", "head", "rel", F.col("tail").alias("node")))
        known = links.select("head", F.col("rel").alias("relation"), "tail")
        wrong = draw_negatives(batch.select("q", "head", F.col("rel").alias("relation")), known, nodes, negatives, seed=seed * 1_000_003 + step)
        candidates = materialize(batch.select("q", "node", F.lit(1).alias("target")).unionByName(wrong.select("q", F.col("candidate").alias("node"), F.lit(0).alias("target"))))
        rest = graph.join(batch.select(F.col("head").alias("src"), "rel", F.col("node").alias("dst")).distinct(), ["src", "rel", "dst"], "left_anti")
        rows, folded, states = scored(rest, params, batch, candidates, layers)
        rows = materialize(slope(materialize(rows)))
        loss = loss_of(rows) if loss_of else rows.agg(exact_sum(F.col("l")).alias("loss"))
        found = gradients(rest, params, batch, rows, folded, states)
        adam(params, found, step, rate).write.mode("overwrite").parquet(f"{path}/step-{step}/parameters")
        loss.select(F.lit(step).alias("step"), F.round("loss", 9).alias("loss")).coalesce(1).write.mode("overwrite").parquet(f"{path}/step-{step}/loss")
        params = spark.read.parquet(f"{path}/step-{step}/parameters")
        losses.append(spark.read.parquet(f"{path}/step-{step}/loss"))
    return params, reduce(DataFrame.unionByName, losses)

