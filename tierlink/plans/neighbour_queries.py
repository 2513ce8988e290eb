"""Catalogue of nearest-neighbour joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlink.operators import graph as G
from tierlink.operators import neighbours as N
from tierlink.plans.graph_queries import COS, L2
from tierlink.session import table

QUERIES, ORACLE_SQL = {}, {}
ALL = "q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings), x AS (SELECT vec_id AS name, embedding::DOUBLE[] AS b FROM embeddings)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _all(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").alias("v"))
    return e.withColumnRenamed("name", "q"), e


@query("j09_self_join", f"WITH {ALL} SELECT q, name, round({L2}, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round({L2}, 9), name) AS rank FROM q, x QUALIFY rank <= 6")
def _(s, d):
    """All cells are visited, so the result is exact."""
    return N.knn_join(*_all(s, d), 6, recall=None, per_cell=50, block=64).select("q", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SYN = f"WITH {ALL}, s AS (SELECT q, name, {COS} AS score FROM q, x), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, name) AS rank FROM s QUALIFY rank <= 6), n AS (SELECT *, score / max(score) OVER (PARTITION BY q) AS norm_score FROM r)"


@query("j09_synonyms_of_all", SYN + " SELECT q AS head, 'equivalent' AS relation, name AS tail FROM n WHERE norm_score >= 0.2 AND q <> name")
def _(s, d):
    return G.synonymy_edges(N.knn_join(*_all(s, d), 6, "cosine", None, per_cell=50, block=64), 0.2)


MEANS = "q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings), p AS (SELECT label AS name, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT name, i, avg(v) AS v FROM p GROUP BY ALL), x AS (SELECT name, list(v ORDER BY i) AS b FROM c GROUP BY name)"


@query("j07_link_all", f"WITH {MEANS}, s AS (SELECT q, name, {COS} AS score FROM q, x) SELECT q, name FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, name) = 1")
def _(s, d):
    """Every vector is linked to the label whose mean is nearest."""
    e = table(s, d, "embeddings")
    means = e.select(F.col("label").alias("name"), F.posexplode("embedding").alias("i", "x")).groupBy("name", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    index = means.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return N.knn_join(_all(s, d)[0], index, 1, "cosine", None).select("q", "name")


@query("j09_halo_recall")
def _(s, d):
    """(cells, n, recall): recall of ten neighbours over all ids with a halo for 0.95, against exact search for a sample; a number, held to 0.9 by a test."""
    q, x = _all(s, d)
    found = N.knn_join(q, x, 10, recall=0.95, per_cell=50)
    return N.measured_recall(q, x, found, 10).withColumn("recall", F.round("recall", 6))


@query("v02_graph_recall")
def _(s, d):
    """(n, recall, share): the graph index's ten neighbours of the queries of ``v01`` against exact search, and the share of vectors that its searches read."""
    from tierlink.operators import neighbour_graph as NG
    from tierlink.operators import vectors as VX
    from tierlink.plans.graph_queries import _vectors

    queries, index = _vectors(s, d)
    found, read = NG.search_graph(queries, index, NG.build_graph(index), 10)
    share = F.round(F.lit(float(read)) / (F.col("n") * index.count()), 6).alias("share")
    return queries.agg(F.count("*").alias("n")).crossJoin(VX.recall(found, G.nearest(queries, index, 10))).select("n", F.round("recall", 6).alias("recall"), share)
