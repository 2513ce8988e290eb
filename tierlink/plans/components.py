"""Named DataFrame components, to be chosen by configuration: linkers, extractors, matchers, rankers, losses, evaluators, constructors.

Each kind has one signature, which a registered function must keep:

* ``linker`` (X3): (queries (q, v), index (name, v), k) -> (q, name, rank, norm_score)
* ``extractor`` (X4): (items (cache_key, doc_id, modality, item)) -> raw facts with cache_key
* ``matcher`` (X5): (pattern, facts, node candidates, relation candidates, k) -> (score, reuse, edges, position)
* ``ranker`` (X6): (entity scores (sample_id, entity, w), doc_entity) -> (sample_id, doc_id, score)
* ``loss`` (X9): (scores (sample, id, score, target)) -> one row (loss)
* ``evaluator`` (X10): (predictions (id, response, answer)) -> one row of metrics
* ``constructor`` (X11): (extracted, facts, doc_ids, image_ids, synonyms) -> Index
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators import build as B
from tierlink.operators import graph as G
from tierlink.operators import metrics as M
from tierlink.operators import pattern as P
from tierlink.operators import rank as R
from tierlink.plans import pipelines


def dense_linker(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    return G.link_scores(G.nearest(queries, index, k, "cosine"))


def media_extractor(items: DataFrame) -> DataFrame:
    """Captions of images, and rows of tables given as (schema, rows of maps)."""
    x = items.select("cache_key", "doc_id", "modality", F.from_json("item", "image_id string, caption string, table_id string, schema array<string>, rows array<map<string,string>>").alias("x"))
    x = x.select("cache_key", "doc_id", "modality", "x.*")
    images = x.where("modality = 'image'")
    captions = B.caption_facts(images).join(images.select("cache_key", F.col("doc_id"), F.col("image_id").alias("source_ref")), ["doc_id", "source_ref"])
    cells = x.where("modality = 'table'").select("cache_key", "doc_id", "table_id", "schema", F.posexplode("rows").alias("row_id", "r"))
    lists = cells.select("cache_key", "doc_id", "table_id", "row_id", F.col("schema").alias("headers"), F.transform("schema", lambda c: F.try_element_at("r", c)).alias("cells"))
    keys = lists.select("cache_key", "doc_id", F.concat("table_id", F.lit("#row"), F.col("row_id").cast("string")).alias("source_ref"))
    facts = B.unpivot_lists(lists.drop("cache_key")).join(keys, ["doc_id", "source_ref"])
    columns = ["cache_key", "doc_id", "head", "relation", "tail", "modality", "source_ref", "confidence"]
    return captions.select(*columns).unionByName(facts.select(*columns))


def answer_evaluator(predictions: DataFrame) -> DataFrame:
    f = T.token_f1("response", "answer")
    return predictions.agg(F.avg(T.exact_match("response", "answer")).alias("em"), F.avg(f["f1"]).alias("f1"), F.avg(f["precision"]).alias("precision"), F.avg(f["recall"]).alias("recall"))


_COMPONENTS: dict[str, dict[str, Callable]] = {
    "linker": {"dense": dense_linker},
    "extractor": {"media": media_extractor},
    "matcher": {"pattern": P.match_pattern},
    "ranker": {"simple": R.simple_rank, "idf": R.idf_rank, "topk": R.top_k_rank, "idf_topk": R.top_k_idf_rank},
    "loss": {"bce": lambda scores: M.bce_loss(scores, ["sample"], 0.0), "list_ce": lambda scores: M.list_ce_loss(scores, ["sample"])},
    "evaluator": {"answers": answer_evaluator},
    "constructor": {"default": pipelines.build_index},
}


def component(kind: str, name: str) -> Callable:
    if name not in _COMPONENTS.get(kind, {}):
        raise KeyError(f"no {kind} {name!r}; there are { {k: sorted(v) for k, v in _COMPONENTS.items()} }")
    return _COMPONENTS[kind][name]


def register_component(kind: str, name: str, function: Callable) -> None:
    if kind not in _COMPONENTS:
        raise KeyError(f"no kind {kind!r}; there are {sorted(_COMPONENTS)}")
    _COMPONENTS[kind][name] = function
