"""Join of texts with the shorter texts that they hold whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlink.session import broadcast_if_small

WORDS, CHARS = 5, 8  # widths of the longest keys


def _kind(parts: Column, chars: Column) -> Column:
    """How an item is found: by w of its inner words (w > 0), or by its first c characters (-1 - c)."""
    inner = F.size(parts) - 2
    return F.when(inner > 0, F.least(inner, F.lit(WORDS))).otherwise(-1 - F.least(F.size(chars), F.lit(CHARS)))


def _runs(units: Column, width: int, glue: str) -> Column:
    """Hashes of each ``width`` units in a row."""
    def of(u: Column) -> Column:
        last = F.size(u) - width + 1
        at = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(u, i, width), glue)))

    return F.array_distinct(F.flatten(F.transform(F.array(units), of)))  # the lambda binds the units once


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """(doc_id, item_id) of each document row and each item row whose text it holds whole.

    A text that holds an item holds the item's inner words, those with a space on either side, as whole
    words in a row. So up to five inner words are the key of a join; an item with no inner word is
    found by its first eight characters or fewer. Keys only find candidates: all are verified on whole texts.
    Texts don't ride along with keys. Keys of the items are broadcast if they measure little.

    Null texts hold nothing and are held by nothing; an empty item is held by all other texts; repeated
    rows and rows without an id count like others.
    """
    units = {"words": F.split(text, " "), "chars": F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))}
    kind = _kind(F.col("p"), F.col("c"))
    split = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("__item"), units["words"].alias("p"), F.when(F.size(F.split(text, " ")) < 3, units["chars"]).alias("c")).withColumn("__kind", kind)
    own = F.when(F.col("__kind") > 0, F.array_join(F.slice("p", 2, F.greatest("__kind", F.lit(1))), " ")).otherwise(F.array_join(F.slice("c", 1, F.greatest(-1 - F.col("__kind"), F.lit(0))), ""))
    keys = broadcast_if_small(split.select("__item", "__kind", F.xxhash64(own).alias("__key")).distinct())
    widths = [r["__kind"] for r in keys.select("__kind").distinct().collect()]  # 14 at most
    there = docs.where(F.col(text).isNotNull())
    found = None
    for w in widths:
        runs = _runs(units["words"], w, " ") if w > 0 else F.array(F.xxhash64(F.lit(""))) if w == -1 else _runs(units["chars"], -1 - w, "")
        some = there.select(F.col(doc_id).alias("__doc"), F.lit(w).alias("__kind"), F.explode(runs).alias("__key"))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.select(doc_id).join(items.select(item_id), F.lit(False))
    pairs = found.join(keys, ["__kind", "__key"]).select("__doc", "__item").distinct()
    whole = pairs.join(there.select(F.col(doc_id).alias("__d"), F.col(text).alias("__text")), F.col("__doc").eqNullSafe(F.col("__d")))
    whole = whole.join(items.select(F.col(item_id).alias("__i"), F.col(text).alias("__part")), F.col("__item").eqNullSafe(F.col("__i")))
    return whole.where(F.contains("__text", "__part")).select(F.col("__d").alias(doc_id), F.col("__i").alias(item_id))
