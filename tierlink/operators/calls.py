"""Model calls in rounds: what failed is tried again, every result is kept once, a lost run goes on."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.session import materialize
from tierlink.sources import sinks


def call_model(rows: DataFrame, key: str, prompt: str, path: str, kind: str = "generate", attempts: int = 3, wait: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(results, failures) of calling a hook on every row's ``prompt``.

    Results are (key, value, attempt); failures, (key, error, attempts), are rows that failed ``attempts`` times. Rows of
    one key are one call, that of the least prompt. Each round writes what it called in a folder of its own under ``path``, whole or not at all, and the next
    calls the rows that failed in it, after ``wait`` seconds times the round; a run that finds whole rounds there goes on behind them.
    A lost executor repeats its own calls of a round, and only one result of each is kept.
    """
    spark = rows.sparkSession
    todo = materialize(rows.groupBy(key).agg(F.min(prompt).alias("__prompt")))
    done: list[DataFrame] = []
    for n in range(1, attempts + 1):
        at = f"{path}/round-{n}"
        if not sinks.exists(spark, f"{at}/_SUCCESS"):
            pending = todo if not done else todo.join(done[-1].where("error is not null").select(key), key, "left_semi")
            if done and pending.isEmpty():
                break
            if n > 1 and wait:
                time.sleep(wait * (n - 1))
            called = pending.select(key, hooks.attempt(kind, "__prompt").alias("__x"))
            called.select(key, "__x.value", "__x.error", F.lit(n).alias("attempt")).write.mode("overwrite").parquet(at)
        done.append(spark.read.parquet(at))
    every = reduce(DataFrame.unionByName, done)
    failed = done[-1].where("error is not null").select(key, "error", F.col("attempt").alias("attempts"))
    return every.where("error is null").select(key, "value", "attempt"), failed
