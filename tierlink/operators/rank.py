"""Document ranking, score fusion, activation, selection and path relations.

Scores are long tables (sample, id, score); nothing is made dense. Every top-k has an id as last
key, so ties are settled alike everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.functions.numeric import is_close
from tierlink.operators.metrics import with_nulls
from tierlink.session import broadcast_if_small, materialize

PAIRS = 1 << 21  # of entity scores and documents in a task, about


def top_k(scores: DataFrame, keys: list[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """Rows of rank <= k in each group, best score first, smallest id among equals."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def idf(doc_entity: DataFrame) -> DataFrame:
    """A1: (entity, idf) with idf = 1 / number of documents with the entity; absent entities weigh nothing."""
    return doc_entity.groupBy("entity").agg((1.0 / F.count("*")).alias("idf"))


def of_entities(doc_entity: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows of the entities that scores name; all of an entity's, so its document frequency stays."""
    return doc_entity.join(scores.select("entity").distinct(), "entity", "left_semi")


def simple_rank(entity_scores: DataFrame, doc_entity: DataFrame) -> DataFrame:
    """(sample_id, doc_id, score): sparse product of entity scores and the incidence table."""
    return in_parts(broadcast_if_small(entity_scores), doc_entity).groupBy("sample_id", "doc_id").agg(F.sum("w").alias("score"))


def in_parts(entity_scores: DataFrame, doc_entity: DataFrame) -> DataFrame:
    """Both tables joined by entity, dealt by sample and document to tasks of about ``PAIRS`` rows: they are counted first.

    Nothing is summed before, where next to no two rows have a sample and document in common.
    """
    asked = entity_scores.groupBy("entity").agg(F.count("*").alias("__n"))
    pairs = doc_entity.select("entity").join(asked, "entity").agg(F.sum("__n").alias("n")).first()["n"] or 0
    few = int(doc_entity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-pairs // PAIRS), min(few, -(-pairs // (PAIRS // 16))))
    return doc_entity.join(entity_scores, "entity").repartition(parts, "sample_id", "doc_id")


def idf_rank(entity_scores: DataFrame, doc_entity: DataFrame) -> DataFrame:
    """A2: the same with each entity's score times its idf."""
    own = of_entities(doc_entity, entity_scores)
    return simple_rank(entity_scores.join(idf(own), "entity").withColumn("w", F.col("w") * F.col("idf")), own)


def best_entities(entity_scores: DataFrame, k: int) -> DataFrame:
    return top_k(entity_scores, ["sample_id"], k, "w", "entity").drop("rank")


def top_k_rank(entity_scores: DataFrame, doc_entity: DataFrame, k: int = 10) -> DataFrame:
    """A3: number of a sample's top-k entities that a document has."""
    return in_parts(broadcast_if_small(best_entities(entity_scores, k)), doc_entity).groupBy("sample_id", "doc_id").agg(F.count("*").cast("double").alias("score"))


def top_k_idf_rank(entity_scores: DataFrame, doc_entity: DataFrame, k: int = 20) -> DataFrame:
    """A4: sum of the idf of a sample's top-k entities in a document; the entity score only selects."""
    best = broadcast_if_small(best_entities(entity_scores, k))  # read several times
    own = of_entities(doc_entity, best)
    return simple_rank(best.join(idf(own), "entity").select("sample_id", "entity", F.col("idf").alias("w")), own)


def densify(scores: DataFrame, samples: DataFrame, ids: DataFrame, key: str = "sample_id", id_col: str = "doc_id") -> DataFrame:
    """Scores with zeros for ids a sample lacks. Only for few samples: it makes samples * ids rows."""
    return samples.select(key).distinct().join(ids.select(id_col).distinct()).join(scores, [key, id_col], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def micro_doc_scores(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """(sample_id, doc_id, score): the best 1 / (1 + max(0, distance)) over hits (sample_id, triple_id, distance)."""
    return hits.join(facts.select("triple_id", "doc_id"), "triple_id").groupBy("sample_id", "doc_id").agg(F.max(1 / (1 + F.greatest(F.lit(0.0), F.col("distance")))).alias("score"))


def activated(hits: DataFrame, align: DataFrame) -> DataFrame:
    """Entities aligned with the triples that were hit."""
    return hits.select("sample_id", "triple_id").join(align, "triple_id").select("sample_id", "entity").distinct()


def anchors(pattern: DataFrame, with_tails: bool = False, min_chars: int = 4, min_tokens: int = 1) -> DataFrame:
    """(sample_id, anchor): normalised heads (and tails) of condition triples that are long enough and known."""
    names = F.array("head", "tail") if with_tails else F.array("head")
    a = pattern.select("sample_id", F.explode(F.transform(names, T.normalize_phrase)).alias("anchor")).distinct()
    return a.where((F.col("anchor") != "") & ~F.contains("anchor", F.lit("unknown")) & (F.length("anchor") >= min_chars) & (F.size(T.tokens("anchor")) >= min_tokens))


def anchor_doc_scores(near: DataFrame, incident: DataFrame, facts: DataFrame, max_distance: float = 1.0) -> DataFrame:
    """Sum over anchors of the best weight / (1 + distance) of a document.

    ``near``: (sample_id, anchor, node, distance); ``incident``: (node, triple_id).
    Documents whose facts touch the same nodes score alike, so one document of each such set is worked out.
    """
    close = near.where(F.col("distance") <= max_distance).withColumn("s", T.anchor_weight("anchor") / (1 + F.col("distance")))
    close = broadcast_if_small(close.groupBy("sample_id", "anchor", "node").agg(F.max("s").alias("s")))
    own = incident.join(close.select("node").distinct(), "node", "left_semi")
    touched = materialize(own.join(facts.select("triple_id", "doc_id"), "triple_id").select("doc_id", "node").distinct())
    marks = [F.count("*").alias("m0"), *[F.bit_xor(F.xxhash64(F.lit(salt), "node")).alias(f"m{salt}") for salt in (1, 2)]]  # of a set of nodes, 128 bits
    by = ["m0", "m1", "m2"]
    sets = materialize(touched.groupBy("doc_id").agg(*marks))
    one = sets.groupBy(*by).agg(F.min("doc_id").alias("doc_id"))
    hit = touched.join(one, "doc_id").join(close, "node")
    best = hit.groupBy("sample_id", *by, "anchor").agg(F.max("s").alias("s"))
    scores = best.groupBy("sample_id", *by).agg(F.sum("s").alias("score"))
    return sets.join(scores, by).select("sample_id", "doc_id", "score")


def merge_max(graph: DataFrame, node: DataFrame, weight: float = 1.0) -> DataFrame:
    """max(graph, node * weight, 0) of each (sample_id, doc_id)."""
    both = graph.select("sample_id", "doc_id", "score").unionByName(node.select("sample_id", "doc_id", (F.col("score") * weight).alias("score")))
    return both.groupBy("sample_id", "doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def merge_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two score tables."""
    return a.select("sample_id", "doc_id", "score").unionByName(b.select("sample_id", "doc_id", "score")).groupBy("sample_id", "doc_id").agg(F.sum("score").alias("score"))


def capped_select(ranked: DataFrame, keys: list[str], k: int, cap: int | None, by: list[Column | str] = ["rank"]) -> DataFrame:
    """Walk in the order ``by``, skip images beyond ``cap``, stop at k, then fill up with the skipped ones in order.

    ``ranked``: (keys, is_image, ...); adds ``position``. Either kind is taken in its order, so only its
    first k rows can be: they are told apart before the exchange, and no task orders all rows of a group.
    """
    kind = Window.partitionBy(*keys, "is_image").orderBy(*by)
    first = ranked.withColumn("__n", F.row_number().over(kind)).where(F.col("__n") <= k)
    late = (F.col("is_image") & (F.col("__n") > cap)) if cap is not None else F.lit(False)
    order = Window.partitionBy(*keys).orderBy("__late", *by)
    return first.withColumn("__late", late).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k).drop("__late", "__n")


def scaled(scores: DataFrame, keys: list[str], columns: dict[str, str], constant: float, zero: DataFrame | None = None) -> DataFrame:
    """``scores`` plus each named column scaled to 0..1 over its group, ``constant`` where all are close.

    Least and greatest come by aggregation and join, so a large group isn't gathered. ``zero`` (keys,
    __zero): groups that count as if they held a 0 too.
    """
    ends = scores.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{end}") for n, c in columns.items() for end, f in (("lo", F.min), ("hi", F.max))])
    if zero is not None:
        ends = ends.join(zero, keys, "left")
        bound = {"lo": F.least, "hi": F.greatest}
        ends = ends.withColumns({f"__{n}_{end}": F.when(F.col("__zero"), f(F.col(f"__{n}_{end}"), F.lit(0.0))).otherwise(F.col(f"__{n}_{end}")) for n in columns for end, f in bound.items()}).drop("__zero")
    out = with_nulls(scores, ends, keys)
    for n, c in columns.items():
        lo, hi = F.col(f"__{n}_lo"), F.col(f"__{n}_hi")
        out = out.withColumn(n, F.when(is_close(hi, lo), F.lit(constant)).otherwise((F.col(c) - lo) / (hi - lo))).drop(lo, hi)
    return out


def unreached(branches: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The first ``2 * k`` documents by id of either kind that a sample's branches lack, with scores of 0.

    A sample that has reached all of them has reached k documents of that kind, so no more are needed
    to fill its selection; the lists are bounded and broadcast.
    """
    first = [docs.where(c).orderBy("doc_id").limit(2 * k) for c in (F.col("is_image"), ~F.col("is_image"))]
    both = first[0].unionByName(first[1]).select("doc_id", "is_image")
    zero = F.lit(0.0)
    every = branches.select("sample_id").distinct().crossJoin(F.broadcast(both))
    return every.join(branches.select("sample_id", "doc_id"), ["sample_id", "doc_id"], "left_anti").withColumns({"text_score": zero, "image_score": zero})


def fuse(branches: DataFrame, k: int = 5, cap: int | None = None, micro: DataFrame | None = None, scale: float = 0.333333, docs: DataFrame | None = None) -> DataFrame:
    """Dual-branch fusion of (sample_id, doc_id, text_score, image_score, is_image).

    Each branch is scaled to 0..1 over the sample; with ``micro`` candidates (sample_id, doc_id,
    score) their scaled micro score replaces the image branch and others' image score shrinks.

    ``docs`` (doc_id, is_image), each document once: those that ``branches`` lacks count with scores of
    0, as if all were listed: 0 enters the scales, and they fill a selection of fewer than k.
    """
    own = branches.select("sample_id", "doc_id", "text_score", "image_score", "is_image")
    if docs is not None:
        reached = own.groupBy("sample_id").agg(F.count("*").alias("__own"))
        total = docs.agg(F.count("*").alias("__all"))
        zero = reached.crossJoin(F.broadcast(total)).select("sample_id", (F.col("__own") < F.col("__all")).alias("__zero"))  # one row
        x = own.unionByName(unreached(own, docs, k))
    else:
        x, zero = own, None
    x = scaled(x, ["sample_id"], {"text_norm": "text_score", "image_norm": "image_score"}, 0.0, zero)
    if micro is not None:
        m = scaled(micro, ["sample_id"], {"micro_norm": "score"}, 1.0).select("sample_id", "doc_id", "micro_norm")
        x = x.join(m, ["sample_id", "doc_id"], "left").withColumn("image_norm", F.coalesce("micro_norm", F.col("image_norm") * scale))
    x = x.withColumn("merged", F.greatest("text_norm", "image_norm")).withColumn("score", F.greatest("text_score", "image_score"))
    order = [F.round("merged", 9).desc(), F.col("doc_id")]  # sums in another order differ beyond
    return capped_select(x, ["sample_id"], k, cap, order)


def expand_seeds(seeds: DataFrame, extra: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Seeds with activated entities of the vocabulary, the larger weight of each."""
    both = seeds.select("sample_id", "entity", "w").unionByName(extra.select("sample_id", "entity", F.lit(1.0).alias("w")))
    return both.join(vocabulary.select("entity").distinct(), "entity", "left_semi").groupBy("sample_id", "entity").agg(F.max("w").alias("w"))


def k_smallest(scored: DataFrame, keys: list[str], k: int, score: str, payload: str, reuse: Column | None = None) -> DataFrame:
    """The k lowest scores of a group; among equals the smallest payloads go first out."""
    order = Window.partitionBy(*keys).orderBy(F.col(score), F.col(payload).desc())
    kept = scored.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")
    final = Window.partitionBy(*keys).orderBy(F.col(score), *([reuse] if reuse is not None else []), F.col(payload))
    return kept.withColumn("position", F.row_number().over(final))


def align_ids(test: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(rid, id): a retrieval id that is an integer within range is a position, others match raw ids; null if neither.

    ``test``: (pos, id); ``retrieved``: (rid).
    """
    by_pos = retrieved.join(test.select(F.col("pos").alias("__p"), F.col("id").alias("__by_pos")), F.col("rid").try_cast("long") == F.col("__p"), "left")
    by_id = by_pos.join(test.select(F.col("id").alias("__by_id")), F.col("rid") == F.col("__by_id"), "left")
    return by_id.select("rid", F.coalesce("__by_pos", "__by_id").alias("id"))


def budget_lookup(samples: DataFrame, by_id: DataFrame, by_question: DataFrame, default: int) -> DataFrame:
    """The image budget by id, else by folded question, else the default."""
    q = by_question.select(T.fold("question").alias("__q"), F.col("budget").alias("__bq")).groupBy("__q").agg(F.max("__bq").alias("__bq"))
    x = samples.join(by_id.select("id", F.col("budget").alias("__bi")), "id", "left").join(q, T.fold("question") == F.col("__q"), "left")
    return x.select("id", F.coalesce("__bi", "__bq", F.lit(default)).alias("budget"))


def resolve_titles(names: DataFrame, ids: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, doc_id): a document of that id, else all of that title."""
    exact = names.join(ids.select(F.col("doc_id").alias("name"), "doc_id"), "name").select("name", "doc_id")
    rest = names.join(ids.select(F.col("doc_id").alias("name")), "name", "left_anti")
    named = rest.join(titles.select(F.lower("title").alias("__t"), "doc_id"), F.lower("name") == F.col("__t")).select("name", "doc_id")
    return exact.unionByName(named).distinct()


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K4-K9: rows of ``work`` whose keys aren't done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def mixed_targets(scores: DataFrame, mass: DataFrame, by_score: int = 20, by_mass: int = 20) -> DataFrame:
    """The top ids by score and then those by mass, each once, in that order."""
    a = top_k(scores, ["sample"], by_score).select("sample", "id", F.lit(0).alias("src"), "rank")
    b = top_k(mass, ["sample"], by_mass).select("sample", "id", F.lit(1).alias("src"), "rank")
    first = a.unionByName(b).groupBy("sample", "id").agg(F.min(F.struct("src", "rank")).alias("f"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("sample").orderBy("f.src", "f.rank"))).select("sample", "id", "position")


def path_relations(hops: DataFrame, doc_keys: DataFrame, window: int = 2, decay: float = 0.4) -> DataFrame:
    """(sample, a, b, score, n_evidence) of selected documents joined by path hops.

    ``hops``: (sample, path, pos, n_hops, head, tail, score); ``doc_keys``: (sample, key, doc). A hop
    weighs score / hops (1 if the score is not positive); windows of w consecutive hops add the
    first hop's weight times decay ** (w - 1) between the first head and the last tail.
    """
    score = F.when((F.col("score") > 0) & ~F.isnan("score") & (F.col("score") < float("inf")), F.col("score")).otherwise(1.0)
    base = hops.withColumn("weight", score / F.col("n_hops"))
    spans = base.select("sample", "path", "pos", "head", "tail", "weight")
    for w in range(2, window + 1):
        end = base.select("sample", "path", (F.col("pos") - (w - 1)).alias("pos"), F.col("tail").alias("end"))
        spans = spans.unionByName(base.join(end, ["sample", "path", "pos"]).select("sample", "path", "pos", "head", F.col("end").alias("tail"), (F.col("weight") * decay ** (w - 1)).alias("weight")))
    left = doc_keys.select("sample", F.col("key").alias("head"), F.col("doc").alias("x"))
    right = doc_keys.select("sample", F.col("key").alias("tail"), F.col("doc").alias("y"))
    pairs = spans.join(left, ["sample", "head"]).join(right, ["sample", "tail"]).where("x <> y")
    return pairs.groupBy("sample", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("score"), F.count("*").alias("n_evidence"))


def neighbours(relations: DataFrame, k: int = 5) -> DataFrame:
    """A document's strongest neighbours."""
    both = relations.select("sample", F.col("a").alias("doc"), F.col("b").alias("id"), "score").unionByName(relations.select("sample", F.col("b").alias("doc"), F.col("a").alias("id"), "score"))
    return top_k(both, ["sample", "doc"], k)
