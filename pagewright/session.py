"""Session helpers: a builder with sensible defaults, and workers that can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shared folder of local sessions that name none (tests, laptops).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/pagewright"
ROOT = str(Path(__file__).resolve().parents[1])


def build_session(name: str = "pagewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE and UTC; on a cluster the master and sizes come from the submit command."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_importable(spark)
    return spark


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies.

    On a cluster ship it with ``--py-files``; the path is simply not there then.
    """
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (held, ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Unset, a local session uses a folder of this machine; a cluster has none that all
    executors see, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder: worked out once, a leaf of every later plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
