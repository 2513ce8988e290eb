"""End-to-end compositions: index building (documents to graph artifacts) and retrieval.

``build_index`` goes from extracted triples and table facts to the two-tier graph and its document
maps; ``retrieve`` from question mentions to ranked documents in two branches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.functions import text as T
from tierlink.operators import answers, micro, neighbours
from tierlink.operators import build as B
from tierlink.operators import graph as G
from tierlink.operators import prompts as A
from tierlink.operators import rank as R
from tierlink.sources import sinks
from tierlink.session import materialize
from tierlink.sources.readers import graph_entities


@dataclass
class Index:
    """Artifacts of index building."""

    edges: DataFrame  # head, relation, tail
    micro: DataFrame  # triple_id, head, relation, tail, modality, source_ref, confidence, doc_id
    align: DataFrame  # triple_id, entity
    doc_entity: DataFrame  # doc_id, entity (text branch)
    image_entity: DataFrame  # doc_id, entity (image branch)
    stats: DataFrame

    def write(self, folder: str, force: bool = False) -> None:
        for name in ("edges", "micro", "align", "doc_entity", "image_entity", "stats"):
            sinks.write_if_absent(getattr(self, name), f"{folder}/{name}", force)


def extract(docs: DataFrame) -> DataFrame:
    """(seq, doc_id, items): triples of each document by the extraction hook, in document order."""
    t = docs.select("doc_id", F.posexplode(hooks.apply("openie", "text")).alias("pos", "items"))
    return t.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("-"), F.lpad(F.col("pos").cast("string"), 9, "0")).alias("seq"), "doc_id", "items")


def synonymy(entities: DataFrame, threshold: float = 0.8, k: int = 100) -> DataFrame:
    """J9 over all phrases of more than two letters or digits, vectors by the embedding hook, as a join of cells with halos."""
    own = materialize(entities.where(T.alnum_len("entity") > 2).select(F.col("entity").alias("name")).distinct().select("name", hooks.apply("embed", "name").alias("v")))
    return neighbours.synonyms(own, threshold, k)


def linked(mentions: DataFrame, entities: DataFrame, k: int = 1, threshold: float = 0.0) -> DataFrame:
    """(mention, entity, norm_score): a mention that is an entity is itself, others get their ``k`` nearest entities by the embedding hook."""
    names = mentions.select("mention").distinct()
    same = names.join(entities.select("entity").distinct(), F.col("mention") == F.col("entity"), "left_semi").select("mention", F.col("mention").alias("entity"), F.lit(1.0).alias("norm_score"))
    rest = names.join(entities.select(F.col("entity").alias("mention")), "mention", "left_anti").select(F.col("mention").alias("q"), hooks.apply("embed", "mention").alias("v"))
    index = entities.select(F.col("entity").alias("name")).distinct().select("name", hooks.apply("embed", "name").alias("v"))
    near = G.link_scores(neighbours.knn_join(rest, index, k, "cosine")).where(F.col("norm_score") >= threshold)
    return same.unionByName(near.select(F.col("q").alias("mention"), F.col("name").alias("entity"), "norm_score"))


def build_index(extracted: DataFrame, facts: DataFrame, doc_ids: DataFrame, image_ids: DataFrame, synonyms: DataFrame | None = None, descriptions: DataFrame | None = None, candidates: DataFrame | None = None) -> Index:
    """P3, P4, J9, P8, F1, J5, F2, M2, J6, J10, J11, A15 in order.

    ``extracted``: (seq, doc_id, items); ``facts``: raw micro facts (M1 gives them from media); ``doc_ids``
    and ``image_ids``: the documents (doc_id) of either branch; ``descriptions``: (doc_id, description) of
    images; ``candidates``: (mention, entity, norm_score) of the linker for names that aren't entities.
    """
    raw = B.clean_triples(extracted).where("status = 'clean'")
    edges = B.last_wins(raw)
    if synonyms is not None:
        edges = G.augment(edges, synonyms)
    entities = graph_entities(edges)
    base = raw.select("doc_id", F.explode(F.array("head", "tail")).alias("entity")).distinct()
    kept = B.filter_micro(B.normalize_micro(facts))
    align = B.cross_tier(kept, entities, candidates)
    kept = B.prune_unaligned(kept, align)
    align = align.join(kept.select("triple_id"), "triple_id", "left_semi")
    by_doc = kept.select("triple_id", "doc_id", "modality").join(align, "triple_id")
    described = by_doc.where("false").select("doc_id", "entity")
    if descriptions is not None:
        near = candidates if candidates is not None else entities.where("false").select(F.col("entity").alias("mention"), "entity", F.lit(0.0).alias("norm_score"))
        described = micro.link_described(micro.described_mentions(descriptions), entities, near)
    aligned = {m: by_doc.where(F.col("modality") == m).select("doc_id", "entity").distinct() for m in ("table", "image")}
    text = B.text_branch(base.withColumn("doc_id", F.col("doc_id").cast("string")), entities, aligned["image"], aligned["table"], doc_ids).where("entity is not null")
    image = B.image_branch(described, aligned["image"], entities, image_ids)
    return Index(edges.select("head", "relation", "tail"), kept, align, text.select("doc_id", "entity"), image, B.micro_stats(doc_ids, kept, align))


def retrieve(questions: DataFrame, index: Index, top_k: int = 5, best: int = 20, max_image_docs: int | None = None, extra: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Mentions (the whole question if none), exact linking, seeds, both branch rankings, fusion.

    ``questions``: (sample_id, question). Documents that no seed reaches score 0; with ``docs`` (doc_id,
    is_image), all documents, they enter the scales and fill up a ranking, else they are left out.
    """
    found = F.transform(hooks.apply("ner", "question"), T.normalize_phrase)
    q = questions.withColumn("m", found).withColumn("m", F.when(F.size("m") == 0, F.array(T.normalize_phrase("question"))).otherwise(F.col("m")))
    seeds = q.select("sample_id", F.explode("m").alias("entity")).groupBy("sample_id", "entity").agg(F.count("*").cast("double").alias("w"))
    return rank_documents(seeds, index, top_k, best, max_image_docs, extra, docs).select("sample_id", "doc_id", "score", "merged", "is_image", "position")


def rank_documents(seeds: DataFrame, index: Index, top_k: int = 5, best: int = 20, max_image_docs: int | None = None, extra: DataFrame | None = None, docs: DataFrame | None = None, micro_scores: DataFrame | None = None) -> DataFrame:
    """Ranked documents of all samples at once: seeds (sample_id, entity, w) with activated ones, both branches, fusion.

    ``extra``: activated entities (sample_id, entity); ``micro_scores``: (sample_id, doc_id, score) of candidates.
    """
    vocabulary = index.doc_entity.select("entity").unionByName(index.image_entity.select("entity")).distinct()
    seeds = R.expand_seeds(seeds, extra if extra is not None else seeds.where("false"), vocabulary)
    text = R.top_k_idf_rank(seeds, index.doc_entity, best).withColumn("is_image", F.lit(False)).withColumnRenamed("score", "text_score")
    image = R.top_k_idf_rank(seeds, index.image_entity, best).withColumn("is_image", F.lit(True)).withColumnRenamed("score", "image_score")
    both = text.unionByName(image, allowMissingColumns=True).groupBy("sample_id", "doc_id").agg(F.coalesce(F.max("text_score"), F.lit(0.0)).alias("text_score"), F.coalesce(F.max("image_score"), F.lit(0.0)).alias("image_score"), F.max("is_image").alias("is_image"))
    if docs is not None:  # the kind of a document is known then, not told by the branch that reached it
        both = both.drop("is_image").join(docs, "doc_id")
    return R.fuse(both, top_k, max_image_docs, micro_scores, docs=docs)


def predict_answers(samples: DataFrame, retrieved: DataFrame, contents: DataFrame) -> DataFrame:
    """``samples`` (sample_id, question, ...) plus retrieved_docs, prompt and the model's response, in the order of ids.

    ``retrieved``: (sample_id, doc_id, position), ``contents``: (doc_id, content). A sample without documents is asked bare.
    """
    found = retrieved.join(contents.select("doc_id", "content"), "doc_id", "left")
    lists = found.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("position", "doc_id", "content"))).alias("d"))
    x = samples.join(lists, "sample_id", "left")
    texts = F.transform("d", lambda r: F.coalesce(r["content"], F.lit("")))
    none = F.array().cast("array<string>")
    x = x.withColumns({"retrieved_docs": F.coalesce(F.transform("d", lambda r: r["doc_id"].cast("string")), none), "prompt": A.standard_prompt(none, F.coalesce(texts, none), F.col("question"))})
    return answers.ordered_results(x.drop("d").withColumn("response", hooks.apply("generate", "prompt")), "sample_id")
