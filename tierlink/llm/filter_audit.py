"""Filter interaction audit: what every filter removes, alone and in every order, by a relational word pipeline.

Words are exploded, counted by (document, word) and then by document, which gives totals and distinct
words; flags that need no words, the flag of copies and the labels are joined from outside. Every document
then fails some subset of the filters, and 2^k conditional-count columns a part (32 for five filters) hold all
that any order of the filters does: what a step removes is a sum over subsets that hold its filter and none
of those before it.

Texts are shuffled once, by document; counting words and then documents needs no shuffle after that, as
the text's key is part of both. Rows of one id and text meet as one with a count before any text moves in
full numbers. Copies are told by the SHA-256 of the text: a group of copies is reduced in the map tasks to one
row for each (text, part, flags, marks), so a group with a third of all rows is no hot key. Null ids are
dealt by their text's hash.

Defined cases: a null text is empty (no words: fails A, passes B); a null part is the empty string; every row counts,
repeated ones too; a null id has no labels, is a copy of nothing and makes no copy of others; rows of one id and
one text aren't copies of each other; a document is good or toxic if any of its labels says so, null labels say
nothing; an empty table gives no part and so no row; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MARKS = ("good", "toxic")
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"


def word_counts(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, total, distinct) of documents that have words; ``text`` depends on ``keys`` alone."""
    texts = docs.groupBy(*keys).agg(F.first(text).alias("__t"))
    words = texts.select(*keys, F.explode(F.split("__t", WORD_GAP)).alias("__word")).where("__word <> ''")
    counted = words.groupBy(*keys, "__word").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))


def flagged_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): number of documents by the set of filters they fail (bit 0: A, bit 4: E) and by their labels."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        t.alias("t"),
        F.xxhash64(t, F.col(id_col).isNull()).alias("h"),
    ).withColumn("key", F.coalesce("id", F.lit(0).cast(docs.schema[id_col].dataType)))
    own = (100 * F.regexp_count("t", F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.char_length("t")).cast("int") * 4 + F.col("t").rlike(SYMBOLS).cast("int") * 8
    flags = rows.select("key", "h", "id", "part", F.unhex(F.sha2("t", 256)).alias("same"), own.alias("own")).groupBy("key", "h", "id", "part", "same", "own").agg(F.count("*").alias("n"))
    flags = flags.join(word_counts(rows, ("key", "h"), "t"), ["key", "h"], "left")
    total, distinct = (F.coalesce(c, F.lit(0)) for c in ("total", "distinct"))
    of_words = (total < MIN_WORDS).cast("int") + (100 * distinct < MIN_DISTINCT_PERCENT * total).cast("int") * 2
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("own_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # null ids meet no label; they are dealt by their text's hash
    at = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("h")))
    flags = flags.withColumn("at", at).join(marks.select(F.col("own_id").cast("string").alias("at"), *MARKS), "at", "left")
    named = flags.select("id", "part", "same", "n", (F.col("own") + of_words).alias("mask"), *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS])
    first = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = named.groupBy("same", "part", "mask", *MARKS).agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("same"))  # one row a part and set of flags
    groups = groups.withColumn("free", F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct("mask", F.col("free").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n")))).alias("x")
    return groups.select("part", *MARKS, both).select("part", *MARKS, "x.mask", "x.n").where("n > 0")


def interactions(flagged: DataFrame, filters: str = FILTERS, marks: Sequence[str] = MARKS) -> DataFrame:
    """One row for each part, order of the filters (one letter each) and step, from (part, mask, marks, n).

    kept, removed, redundant, unique_fails, ``<mark>_removed`` for each mark, and shapley: the filter's removed
    summed over all orders.
    """
    k = len(filters)
    classes = F.explode(F.array(F.lit("all"), *[F.when(F.col(m), F.lit(m)) for m in marks])).alias("class")
    rows = flagged.select("part", "mask", "n", classes).where("class is not null")
    counts = rows.groupBy("part", "class").agg(*[F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)).alias(f"fails_{m}") for m in range(1 << k)])
    wide = counts.select("part", "class", F.array(*[f"fails_{m}" for m in range(1 << k)]).alias("c"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << k)
    parts = wide.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("class") == x, F.col("c"))), none).alias(f"c_{x}") for x in ("all", *marks)])
    orders = F.lit(",".join("".join(p) for p in permutations(filters)))
    steps = parts.withColumn("filter_order", F.explode(F.split(orders, ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def bit(at: str) -> str:
        return f"shiftleft(1, instr('{filters}', substr(filter_order, {at}, 1)) - 1)"

    steps = steps.withColumns({"bit": F.expr(bit("step")), "before": F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> if(i < step, a | {bit('i')}, a))")})

    def summed(column: str, condition: str, value: str = "n") -> Column:
        return F.expr(f"aggregate(transform({column}, (n, m) -> if({condition}, {value}, 0L)), 0L, (a, x) -> a + x)")

    removed = "m & before = 0 and m & bit <> 0"
    orders_of = " ".join(f"when {j} then {len(list(permutations(filters))) // j}" for j in range(1, k + 1))  # orders in which one of j filters comes before the others
    return steps.select(
        "part",
        "filter_order",
        "step",
        summed("c_all", "m & (before | bit) = 0").alias("kept"),
        summed("c_all", removed).alias("removed"),
        summed("c_all", "m & before <> 0 and m & bit <> 0").alias("redundant"),
        summed("c_all", "m = bit").alias("unique_fails"),
        *[summed(f"c_{m}", removed).alias(f"{m}_removed") for m in marks],
        summed("c_all", "m & bit <> 0", f"n * (case bit_count(m) {orders_of} else 0 end)").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """All interactions of the five filters over ``docs``."""
    return interactions(flagged_documents(docs, labels, id_col, text, part))


def op12_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``filter_audit`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit(docs, labels).withColumnsRenamed({"good_removed": "good_lost", "toxic_removed": "toxic_lost"})


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
             + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, e.c, h.c, i.c) AS filter_order FROM x a, x b, x e, x h, x i WHERE len(list_distinct([a.c, b.c, e.c, h.c, i.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, (1 << (ascii(filter_order[step]) - 65))::INT AS bit,
             coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::INT AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
