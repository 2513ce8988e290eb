"""Subgraph pattern matching, exact: a pattern is compiled into joins for each of its edges, first from the leaves for bounds, then from the root.

Scores add node and relation distances; lower is better. Matches are ordered by
(score, reuse, edges). The expansion starts at the pattern node with fewest candidates and follows
a depth-first order of the pattern's edges, neighbours of higher degree first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.session import materialize

GATE = 0.6
REVERSE_PENALTY = 0.25
WILD = "UNKNOWN"


class PatternError(ValueError):
    """A pattern without a root: all names unknown, or a root without candidates."""


def adjacency(facts: DataFrame, reverse: bool) -> DataFrame:
    """(src, rel, dst, penalty) in forward direction, and backward ones if ``reverse``."""
    forward = facts.select(F.col("head").alias("src"), F.col("relation").alias("rel"), F.col("tail").alias("dst"), F.lit(0.0).alias("penalty")).distinct()
    if not reverse:
        return forward
    backward = forward.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), F.lit(REVERSE_PENALTY).alias("penalty"))
    return forward.unionByName(backward).groupBy("src", "rel", "dst").agg(F.min("penalty").alias("penalty"))


def components_of(pattern: list[tuple[str, str, str]]) -> list[list[tuple[str, str, str]]]:
    """Pattern edges (one a pair of nodes, the last relation kept) by connected component."""
    unique: dict[frozenset, tuple[str, str, str]] = {}
    for h, r, t in pattern:
        unique[frozenset((h, t))] = (h, r, t)
    groups: list[tuple[set, list]] = []
    for h, r, t in unique.values():
        touching = [g for g in groups if h in g[0] or t in g[0]]
        groups = [g for g in groups if g not in touching]
        groups.append((set.union({h, t}, *[g[0] for g in touching]), [e for g in touching for e in g[1]] + [(h, r, t)]))
    return [g[1] for g in groups]


def edge_order(edges: list[tuple[str, str, str]], root: str) -> list[tuple[str, str, str]]:
    """(from, relation, to) of each edge once, depth first from the root."""
    near: dict[str, list[tuple[str, str]]] = {}
    for h, r, t in edges:
        near.setdefault(h, []).append((t, r))
        near.setdefault(t, []).append((h, r))
    degree = {n: len(v) for n, v in near.items()}
    seen, out, visited = set(), [], set()

    def walk(node: str) -> None:
        visited.add(node)
        for to, r in sorted(near[node], key=lambda x: (-degree[x[0]], x[0])):
            if frozenset((node, to)) in seen:
                continue
            seen.add(frozenset((node, to)))
            out.append((node, r, to))
            if to not in visited:
                walk(to)

    walk(root)
    return out


def hops(adj: DataFrame, node_candidates: DataFrame, relation_candidates: DataFrame, relation: str, target: str, closing: bool) -> DataFrame:
    """(src, rel, dst, nd, rc, penalty): data edges that may stand for a pattern edge, whatever they start from, and their costs."""
    step = adj
    if closing or WILD in target:
        step = step.withColumn("nd", F.lit(0.0))
    else:
        cand = node_candidates.where(F.col("q") == target).select(F.col("name").alias("dst"), F.col("distance").alias("nd"))
        step = step.join(cand, "dst")
    if WILD in relation:
        return step.withColumn("rc", F.lit(0.0))
    near = relation_candidates.where(F.col("q") == relation).select(F.col("name").alias("rel"), F.col("distance").alias("rd"))
    open_gate = F.lit(True) if WILD in target or closing else F.col("nd") <= GATE
    return step.join(near, "rel", "left").where(~open_gate | F.col("rd").isNotNull()).withColumn("rc", F.when(open_gate, F.col("rd")).otherwise(0.0))


def least(table: DataFrame, column: str, k: int) -> float | None:
    """The k-th smallest value of a column, None if there are fewer rows."""
    row = table.select(column).orderBy(column).limit(k).agg(F.count("*").alias("n"), F.max(column).alias("most")).first()
    return row["most"] if row["n"] == k else None


def match_component(edges: list[tuple[str, str, str]], adj: DataFrame, node_candidates: DataFrame, relation_candidates: DataFrame, sizes: dict[str, int], k: int | None = None, rows: list[int] | None = None) -> DataFrame:
    """Matches of one component: (score, reuse, edges) with ``edges`` as text ``src>rel>dst`` joined by ``;``; with ``k`` at least its k best, ties included.

    A pass from the leaves gives every data node the least cost of what hangs below it in the pattern, and drops
    nodes that nothing completes. The expansion from the root carries each partial match's score plus those least costs, a bound
    that no completion falls below. As long as no edge closes a circle the bound is reached, so the k-th smallest
    bound is a threshold; with circles the threshold is the k-th score of a first, narrow expansion. Costs are not negative.
    ``rows`` is given the number of partial matches after each edge.
    """
    names = dict.fromkeys(n for h, _, t in edges for n in (h, t))
    known = [n for n in names if WILD not in n]
    if not known:
        raise PatternError("no_similar_root_node")
    root = min(known, key=lambda n: sizes.get(n, 0))
    if not sizes.get(root):
        raise PatternError("no_similar_root_node")
    column = {n: f"n{i}" for i, n in enumerate(names)}
    plan, bound = [], [root]
    for source, relation, target in edge_order(edges, root):
        plan.append((source, relation, target, target in bound))
        bound += [] if target in bound else [target]
    circles = any(closing for *_, closing in plan)

    below: dict[str, DataFrame] = {}  # pattern node -> (name, h), the least cost below it
    tables: list[DataFrame] = []
    for source, relation, target, closing in reversed(plan):
        hop = hops(adj, node_candidates, relation_candidates, relation, target, closing)
        if closing:
            tables.insert(0, hop.withColumn("extra", F.col("nd") + F.col("rc") + F.col("penalty")))
            continue
        if target in below:
            hop = hop.join(below[target].withColumnRenamed("name", "dst"), "dst")
        else:
            hop = hop.withColumn("h", F.lit(0.0))
        hop = materialize(hop.withColumn("extra", F.col("nd") + F.col("rc") + F.col("penalty") + F.col("h")).drop("h"))
        best = hop.groupBy(F.col("src").alias("name")).agg(F.min("extra").alias("best"))
        tables.insert(0, hop.join(best.withColumnRenamed("name", "src"), "src").withColumn("extra", F.col("extra") - F.col("best")).drop("best"))
        own = below.get(source)
        below[source] = best.withColumnRenamed("best", "h") if own is None else own.join(best, "name").select("name", (F.col("h") + F.col("best")).alias("h"))
    start = node_candidates.where(F.col("q") == root)
    start = start.join(below[root], "name") if root in below else start.withColumn("h", F.lit(0.0))  # a loop alone
    start = start.select(F.col("name").alias(column[root]), F.col("distance").alias("score"), (F.col("distance") + F.col("h")).alias("bound"), F.lit("").alias("edges"), F.lit(False).alias("reuse"))

    def expanded(limit: float | None, narrow: int | None, sharp: bool) -> DataFrame:
        state, taken = start, [root]
        for (source, _, target, closing), hop in zip(plan, tables, strict=True):
            step = state.join(hop.withColumnRenamed("src", column[source]), column[source])
            if closing:
                step = step.where(F.col("dst") == F.col(column[target]))
            again = F.lit(False) if closing else reduce(lambda a, b: a | b, [F.col("dst") == F.col(column[n]) for n in taken])
            keep = [c for c in state.columns if c not in ("score", "bound", "edges", "reuse")]
            new = [] if closing else [F.col("dst").alias(column[target])]
            text = F.concat("edges", F.when(F.col("edges") == "", "").otherwise(";"), column[source], F.lit(">"), "rel", F.lit(">"), "dst")
            score = F.col("score") + F.col("nd") + F.col("rc") + F.col("penalty")
            state = step.select(*keep, *new, score.alias("score"), (F.col("bound") + F.col("extra")).alias("bound"), text.alias("edges"), (F.col("reuse") | again).alias("reuse"))
            taken += [] if closing else [target]
            if k is None:
                continue
            if limit is not None:
                state = state.where(F.col("bound") <= limit + 1e-9)
            if narrow is not None:
                state = state.orderBy("bound", "edges").limit(narrow)
            state = materialize(state)
            if sharp and (most := least(state, "bound", k)) is not None:
                limit = most if limit is None else min(limit, most)
                state = state.where(F.col("bound") <= limit + 1e-9)
            if rows is not None:
                rows.append(state.count())
        return state

    limit = least(expanded(None, max(4 * k, 64), False), "score", k) if k is not None and circles else None
    return expanded(limit, None, not circles).select("score", "reuse", "edges")


def match_pattern(pattern: list[tuple[str, str, str]], facts: DataFrame, node_candidates: DataFrame, relation_candidates: DataFrame, k: int = 3) -> DataFrame:
    """G1: the k best matches (score, reuse, edges, position) of a pattern over facts (head, relation, tail).

    Candidates: (q, name, distance) of every known pattern node and relation. Components are matched
    apart and ranked together. If nothing matches forward edges, backward ones are tried at a penalty.
    An empty pattern matches nothing.
    """
    spark = facts.sparkSession
    empty = spark.createDataFrame([], "score double, reuse boolean, edges string, position int")
    if not pattern:
        return empty
    nodes = facts.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    own = node_candidates.join(nodes, "name", "left_semi")
    sizes = {r["q"]: r["count"] for r in own.groupBy("q").count().collect()}  # as many rows as pattern nodes
    for reverse in (False, True):
        adj = adjacency(facts, reverse)
        found = reduce(DataFrame.unionByName, [match_component(c, adj, own, relation_candidates, sizes, k) for c in components_of(pattern)])
        best = materialize(found.orderBy("score", "reuse", "edges").limit(k))  # k rows
        if reverse or not best.isEmpty():
            return best.withColumn("position", F.row_number().over(Window.orderBy("score", "reuse", "edges")))  # k rows
    return empty


def match_with_reason(pattern, facts, node_candidates, relation_candidates, k: int = 3) -> tuple[DataFrame | None, str]:
    """Matches, and the reason code if there is none."""
    if not pattern:
        return None, "empty_condition_triples"
    try:
        return match_pattern(pattern, facts, node_candidates, relation_candidates, k), ""
    except PatternError as error:
        return None, str(error)


def best_score(pattern, facts, node_candidates, relation_candidates) -> float:
    """Lowest score of a match; 0 without a pattern, infinity without a match."""
    if not pattern:
        return 0.0
    try:
        row = match_pattern(pattern, facts, node_candidates, relation_candidates, 1).first()
    except PatternError:
        row = None
    return row["score"] if row else float("inf")


def matched_triples(matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Step 9: (position, triple_id) of a match's edges, in either direction."""
    e = matches.select("position", F.explode(F.split("edges", ";")).alias("e")).select("position", F.split("e", ">").alias("p"))
    ends = e.select("position", F.col("p")[0].alias("a"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("b"))
    both = ends.select("position", F.col("a").alias("head"), "relation", F.col("b").alias("tail")).unionByName(ends.select("position", F.col("b").alias("head"), "relation", F.col("a").alias("tail")))
    return both.join(facts.select("head", "relation", "tail", "triple_id"), ["head", "relation", "tail"]).select("position", "triple_id").distinct()
