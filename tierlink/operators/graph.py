"""Graph computation: link-prediction joins, message passing, flows, path masses, k-best walks, logic queries.

Graphs are edge tables; node states are long tables (node, dim, x). Iterations run a fixed number
of layers and keep each layer's table lazily or in the shared folder, never in a local checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions.numeric import softmax
from tierlink.operators.components import connected_components
from tierlink.session import materialize
from tierlink.sources.encode import numbered


# -- J1-J3, F8, F9, G18, G19: link prediction ----------------------------------------------------
def edge_match(edges: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, edge_id) of edges equal to a query on ``keys``."""
    return queries.join(edges, keys).select("qid", "edge_id")


def match_counts(edges: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Number of matching edges of every query."""
    n = edges.groupBy(*keys).agg(F.count("*").alias("__n"))
    return queries.join(n, keys, "left").select("qid", F.coalesce("__n", F.lit(0)).alias("n_match"))


def all_negatives(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node as tail of every batch row; the batch is the small stated query set."""
    return nodes.select(F.col("node").alias("candidate")).join(batch)


def strict_negatives(batch: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate tails that make no true edge with the row's head and relation."""
    true = edges.select("head", "relation", F.col("tail").alias("candidate")).distinct()
    return all_negatives(batch, nodes).join(true, ["head", "relation", "candidate"], "left_anti")


def remove_easy_edges(edges: DataFrame, batch: DataFrame, one_hop: bool = False) -> DataFrame:
    """F8: edges without those of the batch, by (head, tail) or (head, relation, tail)."""
    keys = ["head", "tail"] if one_hop else ["head", "relation", "tail"]
    return edges.join(batch.select(*keys).distinct(), keys, "left_anti")


def sample_negatives(batch: DataFrame, edges: DataFrame, nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` strict negatives a row, drawn with replacement by hash over numbered candidates."""
    numbered = strict_negatives(batch, edges, nodes).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("candidate")) - 1)
    size = numbered.groupBy("qid").agg(F.count("*").alias("m"))
    unit = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("qid").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    draws = size.select("qid", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("k", F.floor(unit * F.col("m")).cast("int"))
    return draws.join(numbered, ["qid", "k"]).select("qid", "draw", "candidate")


def draw_negatives(batch: DataFrame, edges: DataFrame, nodes: DataFrame, n: int, seed: int = 42, rounds: int = 64) -> DataFrame:
    """(q, draw, candidate, attempt): ``n`` strict negatives of each batch row (q, head, relation), drawn with replacement by rejection.

    Nodes are numbered once, in order of a hash; a draw is a number by hash, and those that hit a true edge (head, relation, candidate) draw
    again, so the work is in proportion to the draws. Four attempts are made at once and the first without a hit counts; what is
    left makes more at once. What ``rounds`` attempts don't settle (rows with next to no negatives) is an error.
    """
    def number(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long")

    ordered = nodes.select("node").distinct().withColumn("p", number(F.col("node")))
    ids = materialize(numbered(ordered, "node", "p"))
    size = ids.count()
    asked = batch.select("head", "relation").distinct()
    true = materialize(edges.join(asked, ["head", "relation"], "left_semi").select("head", "relation", F.col("tail").alias("candidate")).distinct())
    open_ = batch.select("q", "head", "relation").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    settled, done, most = [], 0, 4
    while done < rounds:
        last = min(done + most, rounds) - 1
        tried = open_.withColumn("attempt", F.explode(F.sequence(F.lit(done), F.lit(last))))
        at = number(F.col("q"), F.col("draw"), F.col("attempt"), F.lit(seed)) % max(size, 1)
        drawn = tried.withColumn("id", at).join(ids.select("id", F.col("node").alias("candidate")), "id").drop("id")
        hit = drawn.join(true.withColumn("__true", F.lit(True)), ["head", "relation", "candidate"], "left")
        free = F.when(F.col("__true").isNull(), F.struct("attempt", "candidate"))
        found = materialize(hit.groupBy("q", "head", "relation", "draw").agg(F.min(free).alias("f")))
        settled.append(found.where("f is not null").select("q", "draw", "f.candidate", "f.attempt"))
        open_ = found.where("f is null").select("q", "head", "relation", "draw")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        done, most = last + 1, 4 * most
    left = ", ".join(str(r["q"]) for r in open_.select("q").distinct().limit(5).collect())
    raise ValueError(f"no negative found in {rounds} rounds for {left}")


def to_tail_form(samples: DataFrame, n_relations: int) -> DataFrame:
    """Head-corrupted rows (``corrupt_head``) turned round with the inverse relation."""
    flip = F.col("corrupt_head")
    return samples.select("qid", F.when(flip, F.col("tail")).otherwise(F.col("head")).alias("head"), F.when(flip, F.col("relation") + n_relations).otherwise(F.col("relation")).alias("relation"), F.when(flip, F.col("head")).otherwise(F.col("tail")).alias("tail"))


def relation_graph(edges: DataFrame) -> DataFrame:
    """(a, b, kind) of relations that share an entity as head/head, tail/tail, head/tail or tail/head."""
    h = edges.select(F.col("head").alias("node"), F.col("relation").alias("r")).distinct()
    t = edges.select(F.col("tail").alias("node"), F.col("relation").alias("r")).distinct()
    out = []
    for kind, x, y in (("hh", h, h), ("tt", t, t), ("ht", h, t), ("th", t, h)):
        # relations are few: pre-aggregate each node's set, so a hub gives one row
        a = x.groupBy("node").agg(F.collect_set("r").alias("ra"))
        b = y.groupBy("node").agg(F.collect_set("r").alias("rb"))
        out.append(a.join(b, "node").select("ra", "rb").distinct().select(F.explode("ra").alias("a"), "rb").select("a", F.explode("rb").alias("b"), F.lit(kind).alias("kind")).distinct())
    return reduce(DataFrame.unionByName, out)


# -- G5, G7, G8, G20: message passing -------------------------------------------------------------
def spmm(edges: DataFrame, x: DataFrame, relation: DataFrame, add: str = "sum", mul: str = "mul") -> DataFrame:
    """out[dst, dim] = add over edges of w * (relation[rel, dim] mul x[src, dim]).

    ``edges`` (src, dst, rel, w), ``x`` (node, dim, x), ``relation`` (rel, dim, r). Rows without an
    edge are absent; partial aggregation before the shuffle keeps memory at the size of the result.
    """
    message = F.col("w") * (F.col("r") * F.col("x") if mul == "mul" else F.col("r") + F.col("x"))
    wide = edges.join(x.withColumnRenamed("node", "src"), "src").join(relation, ["rel", "dim"])
    f = {"sum": F.sum, "min": F.min, "max": F.max}[add]
    return wide.groupBy(F.col("dst").alias("node"), "dim").agg(f(message).alias("x"))


def rotated(edges: DataFrame, x: DataFrame, relation: DataFrame, size: int) -> DataFrame:
    """(node, dim, m): messages of states as complex numbers turned by the relation's; the first half of the dims is real."""
    half = size // 2

    def halves(df: DataFrame, key: str, value: str) -> DataFrame:
        pick = [F.max(F.when(F.col("dim") < half, F.col(value))), F.max(F.when(F.col("dim") >= half, F.col(value)))]
        return df.groupBy(key, F.pmod("dim", F.lit(half)).alias("pair")).agg(pick[0].alias(f"{value}_re"), pick[1].alias(f"{value}_im"))

    wide = edges.join(halves(x, "node", "x").withColumnRenamed("node", "src"), "src").join(halves(relation, "rel", "r"), ["rel", "pair"])
    real = F.col("x_re") * F.col("r_re") - F.col("x_im") * F.col("r_im")
    imaginary = F.col("x_re") * F.col("r_im") + F.col("x_im") * F.col("r_re")
    parts = F.array(F.struct(F.col("pair").alias("dim"), (F.col("w") * real).alias("m")), F.struct((F.col("pair") + half).alias("dim"), (F.col("w") * imaginary).alias("m")))
    return wide.select(F.col("dst").alias("node"), F.explode(parts).alias("p")).select("node", "p.dim", "p.m")


def aggregate_messages(edges: DataFrame, x: DataFrame, relation: DataFrame, boundary: DataFrame, kind: str = "sum", mul: str = "mul", size: int | None = None) -> DataFrame:
    """Neighbourhood aggregate with the boundary state as a self-loop: sum, mean, max, min or pna.

    ``mul``: ``mul``, ``add``, or ``rotate`` over ``size`` dims.

    ``pna`` gives mean, max, min and std, each times 1, s and 1 / max(s, 0.01), where s is the log
    in-degree (self-loop included) over its mean; columns ``x_mean`` ... ``x_std_inv``.
    """
    message = F.col("w") * (F.col("r") * F.col("x") if mul == "mul" else F.col("r") + F.col("x"))
    if mul == "rotate":
        m = rotated(edges, x, relation, size)
    else:
        m = edges.join(x.withColumnRenamed("node", "src"), "src").join(relation, ["rel", "dim"]).select(F.col("dst").alias("node"), "dim", message.alias("m"))
    m = m.unionByName(boundary.select("node", "dim", F.col("x").alias("m")))
    g = m.groupBy("node", "dim")
    if kind != "pna":
        return g.agg({"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[kind]("m").alias("x"))
    std = F.sqrt(F.greatest(F.avg(F.col("m") * F.col("m")) - F.avg("m") * F.avg("m"), F.lit(1e-6)))
    a = g.agg(F.avg("m").alias("x_mean"), F.max("m").alias("x_max"), F.min("m").alias("x_min"), std.alias("x_std"))
    degree = edges.select(F.col("dst").alias("node")).unionByName(boundary.select("node").distinct()).groupBy("node").agg(F.ln(F.count("*")).alias("__ld"))
    mean = degree.agg(F.avg("__ld").alias("__m"))
    a = a.join(degree, "node").crossJoin(F.broadcast(mean)).withColumn("__s", F.coalesce(F.try_divide("__ld", "__m"), F.lit(0.0)))  # one row
    names = ("x_mean", "x_max", "x_min", "x_std")
    return a.select("node", "dim", *names, *[(F.col(c) * F.col("__s")).alias(f"{c}_amp") for c in names], *[(F.col(c) / F.greatest(F.col("__s"), F.lit(0.01))).alias(f"{c}_inv") for c in names])


def seed_features(seeds: DataFrame, query: DataFrame) -> DataFrame:
    """(sample, node, dim, x): seed weight times the question's vector, seeds only."""
    return seeds.join(query, "sample").select("sample", "node", "dim", (F.col("w") * F.col("q")).alias("x"))


def propagate(edges: DataFrame, boundary: DataFrame, relation: DataFrame, layers: int, kind: str = "sum", residual: bool = True, activation: str | None = "relu") -> DataFrame:
    """Bellman-Ford layers with identity projections; the state of every node that was reached."""
    x = boundary
    for _ in range(layers):
        y = aggregate_messages(edges, x, relation, boundary, kind)
        if activation == "relu":
            y = y.withColumn("x", F.greatest("x", F.lit(0.0)))
        x = materialize(y.unionByName(x).groupBy("node", "dim").agg(F.sum("x").alias("x")) if residual else y)
    return x


def linear(x: DataFrame, weight: DataFrame, bias: DataFrame, relu: bool = False) -> DataFrame:
    """(node, dim, x) after a dense layer of weights (dim, out, w) and biases (out, b); absent states count as 0."""
    y = x.join(F.broadcast(weight), "dim").groupBy("node", F.col("out").alias("dim")).agg(F.sum(F.col("x") * F.col("w")).alias("x"))  # weights are a model's
    y = y.join(F.broadcast(bias.withColumnRenamed("out", "dim")), "dim").select("node", "dim", (F.col("x") + F.col("b")).alias("x"))
    return y.withColumn("x", F.greatest("x", F.lit(0.0))) if relu else y


def score_nodes(x: DataFrame, query: DataFrame, size: int, layers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(node, score): a perceptron over each node's state (dims below ``size``) followed by the query's (dim, q)."""
    both = x.select("node", "dim", "x").unionByName(x.select("node").distinct().crossJoin(F.broadcast(query)).select("node", (F.col("dim") + size).alias("dim"), F.col("q").alias("x")))
    for i, (weight, bias) in enumerate(layers):
        both = linear(both, weight, bias, relu=i < len(layers) - 1)
    return both.where("dim = 0").select("node", F.col("x").alias("score"))


def score_triples(edges: DataFrame, batch: DataFrame, boundary: DataFrame, relation: DataFrame, query: DataFrame, layers: int) -> DataFrame:
    """(node, score) of every reached node as a tail, with the batch's own edges out of the way.

    ``edges`` and ``batch``: (head, relation, tail); the score is the product of state and query (dim, q).
    """
    rest = remove_easy_edges(edges, batch).select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("relation").alias("rel"), F.lit(1.0).alias("w"))
    state = propagate(rest, boundary, relation, layers)
    return state.join(F.broadcast(query), "dim").groupBy("node").agg(F.sum(F.col("x") * F.col("q")).alias("score"))


# -- G10, G11: equivalence ------------------------------------------------------------------------
def canonical_names(equivalent: DataFrame, a: str = "head", b: str = "tail") -> DataFrame:
    """(name, canonical): the smallest name of each class of the equivalence closure."""
    return connected_components(equivalent, a, b).toDF("name", "canonical")


# -- G12-G17: flows and walks ---------------------------------------------------------------------
def local_flow(messages: DataFrame, temperature: float = 1.0, eps: float = 1e-12) -> DataFrame:
    """Flow and log flow of each edge: softmax of logit / temperature over a node's incoming edges of a layer."""
    scaled = messages.withColumn("__l", F.col("logit") / temperature)
    return softmax(scaled, "__l", ["layer", "dst"], "flow", 0.0).withColumn("log_flow", F.ln(F.greatest(F.col("flow"), F.lit(eps)))).drop("__l")


def source_prior(sources: DataFrame) -> DataFrame:
    """(node, log_mass): positive weights normalised to 1; an error if there is none."""
    positive = sources.where("w > 0")
    total = positive.agg(F.sum("w").alias("__t"))
    checked = F.when(F.col("__t").isNull(), F.raise_error(F.lit("no positive source weight")).cast("double")).otherwise(F.col("__t"))
    return positive.crossJoin(F.broadcast(total)).select("node", F.ln(F.col("w") / checked).alias("log_mass"))  # one row


def path_mass(flows: DataFrame, prior: DataFrame, layers: int) -> DataFrame:
    """(node, log_mass) after exactly ``layers`` hops: logsumexp over incoming edges, layer by layer."""
    mass = prior
    for layer in range(layers):
        own = flows.where(F.col("layer") == layer).select("src", "dst", "log_flow")
        step = own.join(mass.withColumnRenamed("node", "src"), "src").select("dst", (F.col("log_mass") + F.col("log_flow")).alias("v"))
        top = step.groupBy("dst").agg(F.max("v").alias("m"))
        mass = step.join(top, "dst").groupBy(F.col("dst").alias("node"), "m").agg(F.sum(F.exp(F.col("v") - F.col("m"))).alias("s")).select("node", (F.col("m") + F.ln("s")).alias("log_mass"))
    return mass


def viterbi(flows: DataFrame, prior: DataFrame, layers: int, beam: int, targets: DataFrame | None = None) -> DataFrame:
    """(node, rank, score, path): the ``beam`` best walks of exactly ``layers`` hops to each node.

    Nodes may repeat; ties go to the smaller path text ``head>rel>tail;...``.
    """
    front = prior.select("node", F.col("log_mass").alias("score"), F.array().cast("array<struct<head:string,rel:string,tail:string>>").alias("path"), F.lit("").alias("text"))
    for layer in range(layers):
        own = flows.where(F.col("layer") == layer).select(F.col("src").alias("node"), "dst", "rel", "log_flow")
        if targets is not None and layer == layers - 1:
            own = own.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
        hop = F.struct(F.col("node").cast("string").alias("head"), F.col("rel").cast("string").alias("rel"), F.col("dst").cast("string").alias("tail"))
        text = F.concat("text", F.col("node").cast("string"), F.lit(">"), F.col("rel").cast("string"), F.lit(">"), F.col("dst").cast("string"), F.lit(";"))
        step = front.join(own, "node").select(F.col("dst").alias("node"), (F.col("score") + F.col("log_flow")).alias("score"), F.concat("path", F.array(hop)).alias("path"), text.alias("text"))
        best = Window.partitionBy("node").orderBy(F.col("score").desc(), "text")
        front = step.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beam)
        if layer < layers - 1:
            front = front.drop("rank")
    return front


def explain_paths(scores: DataFrame, mass: DataFrame, walks: DataFrame, by_score: int = 20, by_mass: int = 20) -> DataFrame:
    """Walks to the mixed targets with their target score and path mass."""
    from tierlink.operators.rank import mixed_targets

    one = F.lit(0)
    chosen = mixed_targets(scores.select(one.alias("sample"), F.col("node").alias("id"), "score"), mass.select(one.alias("sample"), F.col("node").alias("id"), F.col("log_mass").alias("score")), by_score, by_mass)
    t = chosen.select(F.col("id").alias("node"), "position").join(scores.select("node", F.col("score").alias("target_score")), "node", "left").join(mass, "node", "left")
    return t.join(walks.select("node", "rank", F.col("score").alias("walk_score"), "text"), "node", "left")


def average_length_paths(walks: DataFrame, hops: int, k: int) -> DataFrame:
    """The k best walks by score per hop, the first of equal (node, rank)."""
    return walks.withColumn("mean_score", F.col("score") / hops).orderBy(F.col("mean_score").desc(), "text").limit(k)


# -- U7: logical queries --------------------------------------------------------------------------
def to_postfix(query: tuple) -> list[tuple]:
    """Nested ('e', entity), ('p', query, relation), ('i'|'u', a, b, ...), ('n', a) to postfix tokens."""
    op, *args = query
    if op == "e":
        return [("e", args[0])]
    if op == "p":
        return to_postfix(args[0]) + [("p", args[1])]
    if op == "n":
        return to_postfix(args[0]) + [("n",)]
    return [t for a in args for t in to_postfix(a)] + [(op, len(args))]


def readable(query: tuple) -> str:
    op, *args = query
    if op == "e":
        return str(args[0])
    if op == "p":
        return f"{args[1]}({readable(args[0])})"
    return ("not " if op == "n" else "") + "(" + {"i": " and ", "u": " or "}.get(op, "").join(readable(a) for a in args) + ")"


def run_logic(postfix: list[tuple], edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers of a postfix query: projection joins, intersections, unions, negation from all entities."""
    stack: list[DataFrame] = []
    for op, *args in postfix:
        if op == "e":
            stack.append(entities.where(F.col("entity") == args[0]).select("entity").distinct())
        elif op == "p":
            own = edges.where(F.col("relation") == args[0]).select(F.col("head").alias("entity"), "tail")
            stack.append(stack.pop().join(own, "entity").select(F.col("tail").alias("entity")).distinct())
        elif op == "n":
            stack.append(entities.select("entity").distinct().join(stack.pop(), "entity", "left_anti"))
        else:
            parts = [stack.pop() for _ in range(args[0])]
            stack.append(reduce(DataFrame.intersect if op == "i" else lambda a, b: a.union(b).distinct(), parts))
    return stack.pop()


# -- V1, V4, J7, J9: vectors ----------------------------------------------------------------------
def nearest(queries: DataFrame, index: DataFrame, k: int, metric: str = "l2", block: int = 4096) -> DataFrame:
    """V1, V4: (q, name, score, rank) of the k nearest rows of ``index`` (name, v) to each query (q, v), exactly.

    Queries are the stated set: they go to the tasks in blocks of at most ``block`` rows, one pass
    each; every task keeps k rows a query before the final ranking. ``l2`` is the squared distance,
    ``cosine`` the normalised dot product. Vectors of another size than the first query's are an error.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from tierlink.operators.closest import Closest, matrix

    parts, held = [], []

    def scan(chunk: list):
        ids = pa.array([r["q"] for r in chunk], to_arrow_type(queries.schema["q"].dataType))
        mat = np.array([r["v"] for r in chunk], float)

        def run(batches):
            best, kind = Closest(mat, k, metric), None
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))
                    if x.shape[1] != mat.shape[1]:
                        raise ValueError(f"vectors of {x.shape[1]} numbers in an index of {mat.shape[1]}")
                    best.add(x, batch.column(0).to_numpy(zero_copy_only=False))
                    kind = batch.schema.field(0).type
            if kind is not None:
                yield best.table(ids, kind)

        return index.select("name", "v").mapInArrow(run, f"q {dict(queries.dtypes)['q']}, name {dict(index.dtypes)['name']}, score double")

    for row in queries.select("q", "v").toLocalIterator():
        held.append(row)
        if len(held) == block:
            parts.append(scan(held))
            held = []
    if held or not parts:
        parts.append(scan(held) if held else index.select(F.lit(None).cast(dict(queries.dtypes)["q"]).alias("q"), "name", F.lit(0.0).alias("score")).where("false"))
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "name")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", -F.col("score")) if metric == "l2" else ranked


def link_scores(found: DataFrame) -> DataFrame:
    """V4, V5: norm_score = score / best score of the query."""
    return found.withColumn("norm_score", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy("q"))), F.lit(0.0)))


def synonymy_edges(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(head, equivalent, tail) of near phrases other than the phrase itself."""
    return link_scores(found).where((F.col("norm_score") >= threshold) & (F.col("q") != F.col("name"))).select(F.col("q").alias("head"), F.lit("equivalent").alias("relation"), F.col("name").alias("tail"))


def augment(edges: DataFrame, synonymy: DataFrame) -> DataFrame:
    """Edges with synonymy ones, which replace any relation of their pair."""
    return synonymy.unionByName(edges.select("head", "relation", "tail").join(synonymy.select("head", "tail").distinct(), ["head", "tail"], "left_anti").select("head", "relation", "tail"))


def check_dimensions(index: DataFrame, size: int) -> DataFrame:
    """V3: the index, with an error on a vector of another size."""
    ok: Column = F.when(F.size("v") == size, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("vector size "), F.size("v").cast("string"))))
    return index.withColumn("v", ok)
