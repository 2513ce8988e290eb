"""Session helpers shared by every operator: table loading and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path goes to Spark's reader untouched, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may run without the setting; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tierlink-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The copy survives the loss of any executor, unlike a local checkpoint or a cache.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """``df``, computed once, with a broadcast hint if its rows measure ``most_bytes`` at most.

    A larger one is left to a shuffled join.
    """
    fixed = materialize(df)
    size = fixed.agg(F.sum(F.octet_length(F.to_json(F.struct(*fixed.columns)))).alias("b")).first()["b"] or 0
    return F.broadcast(fixed) if size <= most_bytes else fixed


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver found it.

    On a cluster the package is distributed as usual (``--py-files``); the extra entry is then unused.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
