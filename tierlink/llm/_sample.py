"""Bounded samples of labelled rows, chosen without ordering all rows of a label in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.session import materialize

UNIT = float(1 << 31)


def least_hashes(labelled: DataFrame, most: int) -> DataFrame:
    """(i, l): the ``most`` ids of each label with the least hashes; ``labelled`` holds ids i and labels l, few of these.

    Rows of a label are counted, and only those whose hash leaves about twice as many as wanted are
    ordered, so a label with a third of all rows costs no more than another. An id of several labels
    takes the least.
    """
    rows = labelled.where("i is not null and l is not null").select("i", "l")
    counts = rows.groupBy("l").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("i"), F.lit(1 << 31)) / UNIT
    near = rows.join(F.broadcast(counts), "l").where(share * F.col("n") < 2 * most + 64).groupBy("i").agg(F.min("l").alias("l"))
    order = Window.partitionBy("l").orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 31)), "i")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("i", "l")


def sampled_texts(docs: DataFrame, id_col: str, text: str, chosen: DataFrame) -> DataFrame:
    """(l, t): label and text of each chosen id, one row an id, in a table; texts aren't shuffled but for the chosen ones."""
    own = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    found = own.join(F.broadcast(chosen), "i")  # bounded by the parameter of ``least_hashes`` and the number of labels
    return materialize(found.repartition(32, "i").groupBy("i").agg(F.min(F.struct("l", "t")).alias("x")).select("x.l", "x.t"))
