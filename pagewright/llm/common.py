"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

from ..session import settled, shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, read by Spark from any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder: replicated by the store, lineage cut."""
    return settled(df)


def no_reserved_names(df: DataFrame) -> DataFrame:
    """``df``, if it has no column of a name that the operators add for themselves."""
    wrong = [c for c in df.columns if c.lower().startswith("__pw_")]
    if wrong:
        raise ValueError(f"columns that begin with __pw_ are the operators' own: {', '.join(wrong)}")
    return df


def with_integer_ids(df: DataFrame, id_col: str) -> DataFrame:
    """``df``, if its ids are integers; classes are numbered by them."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{id_col} holds {kind.simpleString()}, not integers")
    return df


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
