"""An inverted-file index on storage: built once, searched by reading the cells near to a question.

``centres`` holds the cells' centres, ``lists/cell=N`` their unit vectors, ``config`` the
settings: key, length, rows, cells and how many cells a search visits.  Cells come from
hierarchical (bisecting) k-means over a sample and grow with the rows, as their square root.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import shared_dir
from . import blocks
from . import vectors as S

#: Rows that the cells are fitted on, for each cell; rows by which the number of visits is measured; visits of a cell that one task takes; tasks of a large search.
SAMPLE_PER_CELL, SAMPLE, VISITS, MOST_TASKS = 64, 500, 1 << 15, 512


def _cells_near(centres: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All cells of each question, the nearest first."""
    distance = (q * q).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (q @ centres.T)
    return np.argsort(distance, axis=1, kind="stable")


class IvfStore:
    """An index below ``path``; ``settings`` are what its ``config`` says."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path, settings
        self.centres = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres")

    @classmethod
    def build(cls, index: DataFrame, path: str | None = None, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, k: int = 5, recall: float = 0.95, seed: int = 1) -> IvfStore:
        """Write an index of the rows below ``path`` (default: a new folder in the shared one).

        Rows take part whose vectors are finite, not zero and of the commonest length.  Cells (default: the
        root of the rows) are fitted on at most ``SAMPLE_PER_CELL`` rows each, those of the least hashes.
        """
        spark = index.sparkSession
        path = path or f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
        finite = F.forall(V.doubles(F.col(vector)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = index.where(finite & (V.norm(F.col(vector)) > 0)).select(F.col(key).alias("key"), V.unit(F.col(vector)).alias("unit"))
        lengths = rows.groupBy(F.size("unit").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        dim, n = (lengths["dim"], lengths["n"]) if lengths else (0, 0)
        rows = rows.where(F.size("unit") == dim)
        wanted = cells or max(1, math.isqrt(n))
        centres, placed = np.zeros((1, dim)), rows.withColumn("cell", F.lit(0))
        if wanted > 1 and n:
            sample = min(n, wanted * SAMPLE_PER_CELL)
            part = rows if sample == n else rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)
            features = part.select(array_to_vector("unit").alias("features")).persist()
            model = BisectingKMeans(k=wanted, seed=seed, maxIter=2).fit(features)
            features.unpersist()
            centres = np.array(model.clusterCenters())
            placed = model.transform(rows.withColumn("features", array_to_vector("unit"))).select("key", "unit", F.col("prediction").alias("cell"))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
        settings = {"kind": "ivf", "key": key, "key_type": rows.schema["key"].dataType.simpleString(), "dim": dim, "rows": n, "cells": len(centres), "k": k, "recall": recall, "probes": 1}
        store = cls(spark, path, settings)
        settings["probes"] = store.probes_for(k, recall, seed)
        spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int | None = None) -> IvfStore:
        """An index that was built before; vectors of another length than ``dim`` are an error."""
        settings = json.loads(spark.read.text(f"{path}/config").first()[0])
        if dim is not None and settings["dim"] != dim:
            raise ValueError(f"the index at {path} holds vectors of length {settings['dim']}, not {dim}")
        return cls(spark, path, settings)

    def lists(self) -> DataFrame:
        """``(key, unit, cell)``, a folder a cell."""
        return self.spark.read.schema(f"key {self.settings['key_type']}, unit array<double>, cell int").parquet(f"{self.path}/lists")

    def _visits(self, questions: DataFrame, probes: int) -> DataFrame:
        """``(query_id, q, cell, rn)``: the ``probes`` cells nearest to each question, the nearest with ``rn`` 1."""
        asked = questions.select("query_id", V.unit(F.col("query_vec")).alias("q"))
        held = self.centres.orderBy("cell").collect()  # one row a cell, the root of the rows
        centres, dim = np.array([r["centre"] for r in held]), self.settings["dim"]
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>, cell int, rn int"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.array([len(x) if x is not None else 0 for x in batch.column("q")])
                rows = np.flatnonzero((sizes == dim) & (sizes > 0))
                for low in range(0, len(rows), S.BLOCK_QUESTIONS):
                    at = pa.array(rows[low : low + S.BLOCK_QUESTIONS])
                    q = batch.column("q").take(at)
                    near = _cells_near(centres, q.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))[:, :probes]
                    many = np.repeat(np.arange(len(at)), near.shape[1])
                    columns = [batch.column("query_id").take(at).take(many), q.take(many), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, near.shape[1] + 1), len(at)), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "q", "cell", "rn"])

        return asked.where("q is not null").mapInArrow(work, schema)

    def search(self, questions: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """``(query_id, key, score, rank)``: the k best rows by cosine in the cells nearest to each question.

        Only the files of cells that a question visits are read.  Few visits are broadcast in blocks by
        cell, so the lists stay where they are; many meet them by cell, those of a cell in parts of ``VISITS``
        at most, about.  A search of all cells is a search of all rows: each question goes with parts of the rows, not with each cell.
        """
        key, probes = self.settings["key"], probes or self.settings["probes"]
        if probes >= self.settings["cells"]:
            asked = questions.select("query_id", V.unit(F.col("query_vec")).alias("query_vec"))
            return S.knn(self.lists(), asked, k, "ip", key="key", vector="unit").select("query_id", F.col("key").alias(key), "score", "rank")
        visits = self._visits(questions, probes).select("query_id", F.col("q").alias("v"), "cell")
        asked_n = questions.count()
        small = asked_n * probes <= S.BROADCAST_QUESTIONS
        visited = [r["cell"] for r in visits.select("cell").distinct().collect()]  # cells at most
        lists = self.lists().where(F.col("cell").isin(visited)).select("key", F.col("unit").alias("v"), "cell")
        if small:
            rows = blocks.packed(lists, S.PART_ROWS, "rows", by="cell")
            ordered = visits.repartition("cell").sortWithinPartitions("cell")
            asked = blocks.packed(ordered, S.BLOCK_QUESTIONS, "asked", by="cell").select("cell", F.transform("asked", lambda x: F.struct(x["query_id"].alias("query_id"), x["v"].alias("q"))).alias("asked"))
            return S.top_k(blocks.searched(rows.join(F.broadcast(asked), "cell"), k, "ip", key, (), []), k, key)
        parts = 1 + asked_n * probes // (self.settings["cells"] * VISITS)
        left = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = visits.withColumnRenamed("v", "q").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        tasks = min(self.settings["cells"] * parts, MOST_TASKS)
        return S.top_k(blocks.searched_by(left, right, ["cell", "part"], tasks, k, "ip", key), k, key)

    def probes_for(self, k: int = 5, recall: float = 0.9, seed: int = 1, sample: int = SAMPLE) -> int:
        """The least number of cells that finds ``recall`` of the true ``k`` nearest of sampled rows.

        ``sample`` rows, those of the least hashes of their keys, are asked against all
        lists; a true neighbour is found by as many visits as the rank of its cell.
        """
        asked = self.lists().orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample).select(F.col("key").alias("query_id"), F.col("unit").alias("query_vec"))
        true = S.knn(self.lists(), asked, k, "ip", key="key", vector="unit", keep=("cell",)).select("query_id", "cell")
        ranks = true.join(self._visits(asked, self.settings["cells"]).select("query_id", "cell", "rn"), ["query_id", "cell"]).groupBy("rn").agg(F.count("*").alias("n")).orderBy("rn").collect()
        wanted, held = recall * sum(r["n"] for r in ranks), 0
        for r in ranks:
            held += r["n"]
            if held >= wanted:
                return r["rn"]
        return 1
