"""Ranking and answer metrics, losses and grouped statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tierlink.functions.numeric import sigmoid, softmax
from tierlink.session import materialize


PARTS = 64


def in_parts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` with ``__part``: ranges of falling score in each group, equal scores together.

    So a group's ranks come from parts that are ordered apart and shifted by those before, and no task
    orders a whole group.
    """
    at = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = scores.groupBy(*keys).agg(F.percentile_approx("score", at, 1000).alias("__cuts"))
    placed = scores.join(cuts, keys)
    return placed.withColumn("__part", F.size(F.filter("__cuts", lambda c: c > F.col("score")))).drop("__cuts")


def shifts(parts: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, __part, __before): sum of ``value`` over the parts before."""
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.groupBy(*keys, "__part").agg(value.alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")


def raw_ranks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by falling score, smallest id among equals."""
    parts = in_parts(scores, keys)
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(F.col("score").desc(), "id"))
    ranked = parts.withColumn("rank", own).join(shifts(parts, keys, F.count("*")), [*keys, "__part"])
    return ranked.withColumn("rank", (F.col("rank") + F.col("__before")).cast("int")).drop("__part", "__before")


def filtered_ranks(scores: DataFrame, keys: list[str], answer: Column) -> DataFrame:
    """answers' ranks among non-answers: raw rank less the answers ranked before."""
    a = raw_ranks(scores, keys).where(answer)
    return a.withColumn("filtered", F.col("rank") - F.row_number().over(Window.partitionBy(*keys).orderBy("rank")) + 1)


def pessimistic_ranks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """1 + number of a group's negatives that score at least as much; ``target`` marks positives."""
    parts = in_parts(scores, keys)
    order = Window.partitionBy(*keys, "__part").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("rank", F.sum(1 - F.col("target")).over(order) + 1).where("target = 1").join(shifts(parts, keys, F.sum(1 - F.col("target"))), [*keys, "__part"])
    return ranked.withColumn("rank", F.col("rank") + F.col("__before")).drop("__part", "__before")


def link_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10), rank: str = "rank") -> DataFrame:
    """Mean rank, mean reciprocal rank and hits@k."""
    r = F.col(rank)
    return ranks.agg(F.avg(r).alias("mr"), F.avg(1 / r).alias("mrr"), *[F.avg((r <= k).cast("int")).alias(f"hits_{k}") for k in ks])


def sampled_hits(rank: Column, n_candidates: int, n_sample: int, k: int) -> Column:
    """Chance that fewer than k of ``n_sample`` random negatives rank before the positive."""
    p = (rank - 1) / F.lit(n_candidates - 1)
    total: Column = F.lit(0.0)
    ways = 1
    for i in range(k):
        total = total + F.lit(float(ways)) * F.pow(p, F.lit(i)) * F.pow(1 - p, F.lit(n_sample - i))
        ways = ways * (n_sample - i) // (i + 1)
    return total


def qa_metrics(answers: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 2, 5), rank: str = "filtered") -> DataFrame:
    """Mean over queries of mean reciprocal rank, recall@k (by raw rank) and hits@k (by filtered rank)."""
    q = answers.groupBy(*keys).agg(F.avg(1 / F.col(rank)).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("int")).alias(f"recall_{k}") for k in ks], *[F.avg((F.col(rank) <= k).cast("int")).alias(f"hits_{k}") for k in ks])
    return q.agg(*[F.avg(c).alias(c) for c in q.columns if c not in keys])


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks of ties and population deviations (+1e-10)."""
    for c in (a, b):
        w = Window.partitionBy(*keys)
        df = df.withColumn(f"__{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0)
    return df.groupBy(*keys).agg((F.covar_pop(f"__{a}", f"__{b}") / (F.stddev_pop(f"__{a}") * F.stddev_pop(f"__{b}") + 1e-10)).alias("spearman"))


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives before each negative in falling score, over (positives * negatives + 1e-10)."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__p", F.sum("target").over(w))
    n1, n0 = F.sum("target"), F.sum(1 - F.col("target"))
    return x.groupBy(*keys).agg((F.sum(F.col("__p") * (1 - F.col("target"))) / (n1 * n0 + 1e-10)).alias("auroc"))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 5, 10), empty: str = "skip") -> DataFrame:
    """Mean recall@k of (sample_id, doc_id, rank); samples without gold are skipped or count 0."""
    g = gold.select("sample_id", "doc_id").distinct()
    n = g.groupBy("sample_id").agg(F.count("*").alias("n"))
    hit = ranked.join(g, ["sample_id", "doc_id"], "left_semi").groupBy("sample_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"__{k}") for k in ks])
    samples = ranked.select("sample_id").distinct()
    base = samples.join(n, "sample_id", "inner" if empty == "skip" else "left").join(hit, "sample_id", "left")
    return base.agg(*[F.avg(F.coalesce(F.col(f"__{k}") / F.col("n"), F.lit(0.0))).alias(f"recall_{k}") for k in ks])


def bucket_accuracy(rows: DataFrame, buckets: list[str], correct: str = "correct") -> DataFrame:
    """Count, correct and accuracy by each bucket column at once (grouping sets)."""
    sets = [[]] + [[b] for b in buckets]
    x = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(b) for b in buckets])
    return x.agg(F.count("*").alias("n"), F.sum(correct).cast("long").alias("n_correct"), F.avg(correct).alias("accuracy"))


def judge_summary(rows: DataFrame) -> DataFrame:
    """Direct, rag, either and final accuracy, and how often the judge decided (columns direct, rag, final, source)."""
    return rows.agg(F.count("*").alias("n"), F.avg("direct").alias("direct"), F.avg("rag").alias("rag"), F.avg(F.greatest("direct", "rag")).alias("oracle_or"), F.avg("final").alias("final"), F.count_if(F.col("source").startswith("judge")).alias("n_judged"))


def grouped_reduce(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """A5: sum, mean, max, min and count of each id; empty groups are 0."""
    a = df.groupBy(key).agg(F.sum("score").alias("sum"), F.avg("score").alias("mean"), F.max("score").alias("max"), F.min("score").alias("min"), F.count("*").alias("n"))
    return ids.join(a, key, "left").fillna(0)


def logsumexp(df: DataFrame, keys: list[str], x: str = "score") -> DataFrame:
    """Max + ln(sum(exp(x - max))) of each group, in two aggregations without a window."""
    m = df.groupBy(*keys).agg(F.max(x).alias("__m"))
    return df.join(m, keys).groupBy(*keys, "__m").agg((F.col("__m") + F.ln(F.sum(F.exp(F.col(x) - F.col("__m"))))).alias("logsumexp")).drop("__m")


def masked_means(df: DataFrame, keys: list[str], mask: Column, x: str = "score") -> DataFrame:
    """Mean under a mask, and mean of values that aren't NaN."""
    return df.groupBy(*keys).agg(F.avg(F.when(mask, F.col(x))).alias("masked_mean"), F.avg(F.when(~F.isnan(x), F.col(x))).alias("nan_mean"))


def bce_loss(df: DataFrame, keys: list[str], temperature: float = 0.0) -> DataFrame:
    """Binary cross entropy of logits; positives weigh 1/#pos, negatives softmax(x / T) or 1/#neg; mean of row means."""
    x = F.col("score")
    signed = F.when(F.col("target") == 1, x).otherwise(-x)
    loss = F.ln(1 + F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0))
    side = [*keys, "target"]
    d = df.withColumn("__loss", loss).withColumn("__n", F.count("*").over(Window.partitionBy(*side)))
    if temperature > 0:
        d = softmax(d.withColumn("__x", x / temperature), "__x", side, "__s").withColumn("__w", F.when(F.col("target") == 1, 1 / F.col("__n")).otherwise(F.col("__s")))
    else:
        d = d.withColumn("__w", 1 / F.col("__n"))
    row = d.groupBy(*keys).agg((F.sum(F.col("__loss") * F.col("__w")) / F.sum("__w")).alias("loss"))
    return row.agg(F.avg("loss").alias("loss"))


def list_ce_loss(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of -ln(s / (sum s + 1e-5) + 1e-5) over positives of samples that have one."""
    s = sigmoid(F.col("score"))
    d = df.withColumn("__s", s).withColumn("__t", F.sum(s).over(Window.partitionBy(*keys)))
    row = d.where("target = 1").groupBy(*keys).agg(F.avg(-F.ln(F.col("__s") / (F.col("__t") + 1e-5) + 1e-5)).alias("loss"))
    return row.agg(F.avg("loss").alias("loss"))


def soft_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of probabilities above one half."""
    p = sigmoid(F.col("score"))
    return df.groupBy(*keys).agg(F.sum(F.when(p > 0.5, p).otherwise(0.0)).alias("size"))


def with_nulls(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` with the other columns of ``b`` where all keys are the same, null keys too."""
    names = {k: f"__b{i}" for i, k in enumerate(keys)}
    other = b.withColumnsRenamed(names)
    return a.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]).drop(*names.values())


def interval_union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal disjoint [start, stop) intervals that cover the given ones; empty and null ones cover nothing.

    A group's places are cut into ranges by quantiles. Depths run within a range from the sum of those before; an interval
    that a range leaves open ends at the first stop of a later one. Windows over a whole group see a row a range.
    """
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))
    events = spans.where("start < stop").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    events = materialize(events.where("d <> 0"))  # a place where as many begin as end doesn't change the depth
    quantiles = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = events.groupBy(*keys).agg(F.percentile_approx("at", quantiles, 1000).alias("__cuts"))
    placed = with_nulls(events, cuts, keys).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("at")))).drop("__cuts")
    parts = placed.groupBy(*keys, "__part").agg(F.sum("d").alias("__n"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    run = Window.partitionBy(*keys, "__part").orderBy("at")
    depth = with_nulls(placed, before, [*keys, "__part"]).withColumn("depth", F.col("__before") + F.sum("d").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    edges = depth.where("(depth - d = 0) <> (depth = 0)").withColumn("stop", F.lead("at").over(run))
    later = edges.groupBy(*keys, "__part").agg(F.min(F.when(F.col("depth") == 0, F.col("at"))).alias("__first"))
    after = later.withColumn("__after", F.min("__first").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(1, Window.unboundedFollowing))).drop("__first")
    starts = edges.where("depth > 0")
    return with_nulls(starts, after, [*keys, "__part"]).select(*keys, F.col("at").alias("start"), F.coalesce("stop", "__after").alias("stop"))


def variadic_concat(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Group-wise concatenation: (keys, pos, value) with b's rows after a's."""
    both = a.withColumn("__s", F.lit(0)).unionByName(b.withColumn("__s", F.lit(1)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("__s", "pos")) - 1).drop("__s")


@F.pandas_udf(DoubleType())
def rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """ROUGE-L F of two token arrays; the common subsequence by bit-parallel dynamic programming."""

    def one(p, g) -> float:
        if p is None or g is None or not len(p) or not len(g):
            return 0.0
        masks: dict[str, int] = {}
        for i, w in enumerate(g):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << len(g)) - 1
        row = full
        for w in p:
            hit = row & masks.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        same = len(g) - row.bit_count()
        return 2.0 * same / (len(p) + len(g)) if same else 0.0

    return pd.Series([one(p, g) for p, g in zip(pred, gold, strict=True)], dtype="float64")


PAIRS = 32  # of texts whose token vectors are in memory at once


def token_matches(pairs: DataFrame) -> DataFrame:
    """(id, ref, p, r) of ``pairs`` (id, ref, prediction, reference): each token of either text with m, its similarity to the most similar token of the other.

    Vectors come from the ``embed_tokens`` hook and stay in the task, for a few texts at a time.
    """
    from tierlink.functions import hooks

    model = hooks.model_of("embed_tokens")

    def unit(tokens: list) -> np.ndarray:
        x = np.array([v for _, v in tokens], float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def best(p: list, r: list) -> tuple[list, list]:
        by_pred, by_ref = np.full(len(p), -np.inf), np.full(len(r), -np.inf)
        if p and r:
            a, b = unit(p), unit(r)
            for i in range(0, len(a), 1024):  # texts of any length in bounded memory
                for j in range(0, len(b), 1024):
                    s = a[i : i + 1024] @ b[j : j + 1024].T
                    by_pred[i : i + 1024] = np.maximum(by_pred[i : i + 1024], s.max(1))
                    by_ref[j : j + 1024] = np.maximum(by_ref[j : j + 1024], s.max(0))
        return tuple([{"token": t, "m": float(m) if p and r else 0.0} for (t, _), m in zip(x, by, strict=True)] for x, by in ((p, by_pred), (r, by_ref)))

    kind = pa.list_(pa.struct([("token", pa.string()), ("m", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PAIRS):
                part = batch.slice(lo, PAIRS)
                sides = [[list(x or []) for x in model(part.column(c).to_pylist())] for c in ("prediction", "reference")]
                both = [best(p, r) for p, r in zip(*sides, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ref"), *[pa.array([x[i] for x in both], kind) for i in (0, 1)]], names=["id", "ref", "p", "r"])

    tokens = "array<struct<token:string,m:double>>"
    return pairs.select("id", "ref", "prediction", "reference").mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, ref int, p {tokens}, r {tokens}")


def bert_score(rows: DataFrame, idf: bool = True) -> DataFrame:
    """(id, precision, recall, f1) of ``rows`` (id, prediction, references): the reference of the best F1, the first among equals.

    Token vectors come from the ``embed_tokens`` hook. With ``idf`` a token weighs ln((M + 1) / (df + 1)) over the M references. Blank
    references count as none; a blank prediction or none at all scores 0.
    """
    refs = rows.select("id", "prediction", F.posexplode("references").alias("ref", "reference")).where("trim(reference) <> '' and trim(prediction) <> ''")
    both = materialize(token_matches(refs))
    at = both.select("id", "ref", F.lit("p").alias("side"), F.explode("p").alias("x")).unionByName(both.select("id", "ref", F.lit("r").alias("side"), F.explode("r").alias("x")))
    at = at.select("id", "ref", "side", "x.token", "x.m").withColumn("w", F.lit(1.0))
    if idf:
        df = both.select(F.explode(F.array_distinct(F.transform("r", lambda x: x["token"]))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        size = both.agg(F.count("*").alias("n"))  # one row
        at = at.join(df, "token", "left").join(F.broadcast(size)).withColumn("w", F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    sides = [F.when(F.col("side") == s, F.col("m") * F.col("w")) for s in "pr"], [F.when(F.col("side") == s, F.col("w")) for s in "pr"]
    sums = at.groupBy("id", "ref").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in zip(("pm", "rm", "pw", "rw"), [*sides[0], *sides[1]], strict=True)])
    means = [F.when(F.col(f"{s}w") > 0, F.col(f"{s}m") / F.col(f"{s}w")).otherwise(0.0).alias(n) for s, n in (("p", "precision"), ("r", "recall"))]
    both_means = F.col("precision") + F.col("recall")
    scored = sums.select("id", "ref", *means).withColumn("f1", F.when(both_means > 0, 2 * F.col("precision") * F.col("recall") / both_means).otherwise(0.0))
    best = scored.groupBy("id").agg(F.max(F.struct(F.round("f1", 12).alias("f"), (-F.col("ref")).alias("o"), F.struct("precision", "recall", "f1").alias("s"))).alias("x")).select("id", "x.s.*")
    found = rows.select("id").distinct().join(best, "id", "left")
    return found.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
