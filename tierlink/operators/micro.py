"""Micro facts from media: extraction with a cache, described entities, index tables and model answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.functions import text as T
from tierlink.operators.build import LINK_THRESHOLD, LINK_TOP_K, normalize_micro
from tierlink.sources import encode

FACTS = ("triple_id", "head", "relation", "tail", "modality", "source_ref", "confidence", "doc_id")


def media_items(docs: DataFrame, modalities: tuple[str, ...] = ("image", "table")) -> DataFrame:
    """(doc_id, modality, item as JSON) of documents with ``images`` and ``tables`` arrays; null items are skipped."""
    parts = []
    for modality in modalities:
        items = docs.select(F.coalesce("doc_id", "title").alias("doc_id"), F.lit(modality).alias("modality"), F.explode(f"{modality}s").alias("x"))
        parts.append(items.where("x is not null").select("doc_id", "modality", F.to_json("x").alias("item")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def micro_graph(items: DataFrame, extract: Callable[[DataFrame], DataFrame], cached: DataFrame | None = None, keep_stale: bool = False) -> DataFrame:
    """M1: (cache_key, facts) of all media items; only items whose key the cache lacks are extracted and normalised.

    ``items``: (doc_id, modality, item); ``extract`` gives raw facts with ``cache_key``; ``cached``: an earlier
    result. Facts of cached items that are gone are dropped, or kept with ``keep_stale``.
    """
    keyed = items.withColumn("cache_key", F.concat_ws("|", "doc_id", "modality", F.md5("item"))).dropDuplicates(["cache_key"])
    todo = keyed if cached is None else keyed.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")
    raw = extract(todo)
    ids = raw.select("cache_key", "doc_id", "modality", "source_ref").distinct()
    new = normalize_micro(raw.select("doc_id", "head", "relation", "tail", "modality", "source_ref", "confidence"))
    new = new.join(ids, ["doc_id", "modality", "source_ref"]).select("cache_key", *FACTS)
    if cached is None:
        return new
    old = cached if keep_stale else cached.join(keyed.select("cache_key"), "cache_key", "left_semi")
    return old.select("cache_key", *FACTS).unionByName(new)


def described_mentions(descriptions: DataFrame) -> DataFrame:
    """M2: (doc_id, mention): entities that the recognition hook finds in each non-blank description of a document."""
    return descriptions.where(F.trim("description") != "").select("doc_id", F.explode(hooks.apply("ner", "description")).alias("mention"))


def link_described(mentions: DataFrame, entities: DataFrame, candidates: DataFrame, threshold: float = LINK_THRESHOLD, top_k: int = LINK_TOP_K) -> DataFrame:
    """(doc_id, entity): a normalised mention that is a macro entity, else its near candidates that are.

    ``candidates``: (mention, entity, norm_score) of the linker, ``top_k`` of each mention counting.
    """
    named = mentions.select("doc_id", T.normalize_phrase("mention").alias("mention")).where("mention <> ''").distinct()
    macro = entities.select("entity").distinct()
    exact = named.join(macro.withColumnRenamed("entity", "mention"), "mention", "left_semi").select("doc_id", F.col("mention").alias("entity"))
    best = Window.partitionBy("mention").orderBy(F.col("norm_score").desc(), "entity")
    near = candidates.withColumn("__n", F.row_number().over(best)).where((F.col("__n") <= top_k) & (F.col("norm_score") >= threshold))
    rest = named.join(macro.withColumnRenamed("entity", "mention"), "mention", "left_anti").join(near.select("mention", "entity"), "mention").join(macro, "entity", "left_semi")
    return exact.unionByName(rest.select("doc_id", "entity")).distinct()


def entities_of_passages(passages: DataFrame) -> DataFrame:
    """M3: (doc_id, entity) of (seq, title, entities); the last passage of a title wins, without entities it has none."""
    last = passages.groupBy("title").agg(F.max_by(F.coalesce("entities", F.array().cast("array<string>")), "seq").alias("e"))
    return last.select(F.col("title").alias("doc_id"), F.explode("e").alias("entity"))


def index_tables(facts: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """M6: (id, name, v) of nodes and of relations, ids by first appearance, vectors by the embedding hook; empty without facts."""
    nodes, relations = encode.dictionaries(facts, seq)
    return tuple(x.select("id", "name", hooks.apply("embed", "name").alias("v")) for x in (nodes, relations))


def extracted_triples(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """M7: ``answers`` plus ``triples``: those of a model's JSON answer, empty if it doesn't parse or has none."""
    parsed = F.from_json(T.extract_json(answer), "triples array<array<string>>")["triples"]
    return answers.withColumn("triples", F.coalesce(parsed, F.array().cast("array<array<string>>")))
