"""Samples, retrieval results and answers: filters, score maps, counters, context and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlink.functions import text as T
from tierlink.operators import metrics as M
from tierlink.operators import rank as R

CONTEXT_HEAD = "Answer from the documents and images below."
CONTEXT_END = "Give a short answer."


def usable_samples(samples: DataFrame, entities: DataFrame, split: str = "split") -> DataFrame:
    """samples with at least one question entity of the vocabulary; those of the test split always stay.

    ``samples``: (sample_id, split, question_entities); adds ``n_linked``.
    """
    named = samples.select("sample_id", F.explode(F.array_distinct("question_entities")).alias("entity"))
    linked = named.join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("sample_id").agg(F.count("*").alias("n_linked"))
    out = samples.join(linked, "sample_id", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))
    return out.where((F.col(split) == "test") | (F.col("n_linked") > 0))


def one_sample(batch: DataFrame, sample: int | str, key: str = "sample_id") -> DataFrame:
    """The rows of one sample."""
    return batch.where(F.col(key) == sample)


def index_mask(ids: DataFrame, indices: DataFrame, key: str = "id") -> DataFrame:
    """(id, mask): 1 for listed ids, 0 for the others."""
    on = indices.select(key).distinct().withColumn("mask", F.lit(1))
    return ids.join(on, key, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def group_indices(sizes: DataFrame, key: str = "group", size: str = "size") -> DataFrame:
    """(group, pos) of each element of groups of those sizes; empty groups have none."""
    return sizes.where(F.col(size) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1)).alias("pos"))


def score_map(rankings: DataFrame) -> DataFrame:
    """(sample_id, doc_id, score) of listed entries (sample_id, pos, doc_id, score); blank ids go, the last of equals wins, no score is 0."""
    named = rankings.withColumn("doc_id", F.trim(F.coalesce(F.col("doc_id"), F.lit("")))).where("doc_id <> ''")
    return named.groupBy("sample_id", "doc_id").agg(F.max_by(F.coalesce("score", F.lit(0.0)), "pos").alias("score"))


def micro_ranking(hits: DataFrame, near: DataFrame, incident: DataFrame, facts: DataFrame, max_match_score: float, max_distance: float = 1.0, weight: float = 1.0, k: int = 20) -> DataFrame:
    """(sample_id, doc_id, score, rank): pattern hits under the cut (F4, A10) and anchor nodes (A11) merged (A12), the k best."""
    graph = R.micro_doc_scores(hits.where(F.col("distance") <= max_match_score), facts)
    merged = R.merge_max(graph, R.anchor_doc_scores(near, incident, facts, max_distance), weight)
    return R.top_k(merged.withColumn("score", F.round("score", 6)), ["sample_id"], k, "score", "doc_id")


def scaled_top(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each sample with their min-max scaled score."""
    from tierlink.functions.numeric import min_max

    scaled = scores.withColumn("norm_score", min_max(F.col("score"), Window.partitionBy("sample_id"), 0.0))
    return R.top_k(scaled, ["sample_id"], k, "score", "doc_id")


def activation_counters(trace: DataFrame) -> DataFrame:
    """One row of counters over samples (parsed, n_condition, failed, n_seeds, n_in_graph, n_before, n_after)."""
    flag = {
        "parse_success": "parsed", "parse_fail": "not parsed", "condition_nonempty": "parsed and n_condition > 0", "condition_empty": "parsed and n_condition = 0",
        "activation_fail": "failed", "extra_seed_nonempty": "n_seeds > 0", "extra_seed_empty": "n_seeds = 0", "mask_expanded": "n_after > n_before", "mask_unchanged": "n_after <= n_before",
    }
    total = {"seed_total": "n_seeds", "seed_in_graph_total": "n_in_graph", "seed_oov_total": "n_seeds - n_in_graph", "mask_delta_total": "n_after - n_before"}
    zero = F.lit(0).cast("long")
    return trace.agg(
        F.count("*").alias("total_samples"),
        *[F.count_if(F.expr(c)).alias(n) for n, c in flag.items()],
        *[F.coalesce(F.sum(F.expr(c)).cast("long"), zero).alias(n) for n, c in total.items()],
        F.coalesce(F.max(F.expr("n_after - n_before")).cast("long"), zero).alias("mask_delta_max"),
    )


def stage_timers(spans: DataFrame) -> DataFrame:
    """(stage, n, total_s, mean_s) of timed spans (stage, seconds)."""
    return spans.groupBy("stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"))


def ordered_results(results: DataFrame, key: str = "id") -> DataFrame:
    """Results in the order of their ids, by a range shuffle."""
    return results.orderBy(key)


def table_text(schema: Column, rows: Column) -> Column:
    """The column names and each row's cells (maps by name, absent ones empty) joined by `` | ``, a line each."""
    line = F.transform(rows, lambda r: F.array_join(F.transform(schema, lambda c: F.coalesce(F.try_element_at(r, c), F.lit(""))), " | "))
    head = F.when(F.size(schema) > 0, F.array(F.array_join(schema, " | "))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, line), "\n")


def alias_map(top: DataFrame, resolved: DataFrame) -> DataFrame:
    """T5: (sample, doc, alias): ``doc{rank}`` for a retrieved name and each id it resolves to; the later rank wins.

    ``top``: (sample, doc, rank); ``resolved``: (doc, doc_id).
    """
    own = top.where(F.trim("doc") != "").select("sample", "doc", "rank")
    ids = own.join(resolved, "doc").select("sample", F.col("doc_id").alias("doc"), "rank")
    return own.unionByName(ids).groupBy("sample", "doc").agg(F.max("rank").alias("r")).select("sample", "doc", F.concat(F.lit("doc"), F.col("r").cast("string")).alias("alias"))


def media_context(question: Column, docs: Column, media: Column) -> Column:
    """Question, numbered documents (title, content) and numbered media (doc_id, modality, title, caption) as text."""
    doc_lines = F.transform(docs, lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["title"], F.lit("\n"), x["content"]))
    media_lines = F.transform(media, lambda x, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" ("), x["modality"], F.lit(", "), x["doc_id"], F.lit("): "), x["title"], F.lit("; "), x["caption"]))
    return F.concat_ws("\n", F.lit(CONTEXT_HEAD), F.concat(F.lit("Question: "), question), F.array_join(doc_lines, "\n"), F.nullif(F.array_join(media_lines, "\n"), F.lit("")), F.lit(CONTEXT_END))


def media_items_of(docs: DataFrame, images: DataFrame) -> DataFrame:
    """(sample, position, doc_id, modality, path): media of retrieved documents in order, each path once.

    ``docs``: (sample, rank, doc_id); ``images``: (doc_id, modality, path), images before table images.
    """
    x = docs.join(images, "doc_id").withColumn("o", F.struct("rank", F.col("modality") != "image", "path"))
    first = x.groupBy("sample", "path").agg(F.min_by(F.struct("doc_id", "modality"), "o").alias("m"), F.min("o").alias("o"))
    order = Window.partitionBy("sample").orderBy("o")
    return first.select("sample", F.row_number().over(order).alias("position"), "m.doc_id", "m.modality", "path")


def marked_answers(rows: DataFrame) -> DataFrame:
    """``rows`` (response, answer) plus parsed_letter, parsed_index (-1 if none) and is_correct."""
    letter = T.answer_letter("response")
    index = F.when(F.col("parsed_letter").isin(*"ABCDE"), F.ascii("parsed_letter") - F.ascii(F.lit("A"))).otherwise(F.lit(-1))
    out = rows.withColumn("parsed_letter", F.coalesce(letter, F.lit(""))).withColumn("parsed_index", index)
    return out.withColumn("is_correct", F.coalesce((F.col("parsed_index") >= 0) & (F.col("parsed_index") == F.col("answer")), F.lit(False)))


def answer_summary(marked: DataFrame, buckets: list[str]) -> DataFrame:
    """Accuracy in all and by each bucket column."""
    return M.bucket_accuracy(marked.withColumn("correct", F.col("is_correct").cast("int")), buckets)
