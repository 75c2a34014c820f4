"""Nearest-neighbour models: a stored index, votes or means of the neighbours, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frame import col, lookup, settle
from .neighbors import NeighborIndex


def vote(near: DataFrame, weights: str, task: str) -> DataFrame:
    """Combine neighbour values; with distance weights an exact match outvotes the rest."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"weights must be uniform or distance, not {weights!r}")
    if weights == "distance":
        hit = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))  # k rows each
        near = near.withColumn("hit", hit)
        w = F.when(F.col("hit") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    else:
        w = F.lit(1.0)
    near = near.withColumn("w", w)
    if task == "regression":
        return near.groupBy("query_id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("prediction"))
    sums = near.groupBy("query_id", "value").agg(F.sum("w").alias("w"))
    return sums.groupBy("query_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "value")).alias("best")).select("query_id", F.col("best.value").alias("prediction"))


@dataclass
class KnnModel:
    """``transform`` adds ``prediction`` (and ``score``, the share of the second of two classes) to raw rows.

    Rows are asked by their input vector, equal ones once, so they need no key.  Distinct vectors are searched
    in the stored index.
    """

    inputs: PipelineModel
    names: list[str]
    index: NeighborIndex
    values: DataFrame  # (neighbor_id, value), one row for each training row
    k: int
    weights: str
    task: str
    classes: int = 0

    @staticmethod
    def fit(inputs: PipelineModel, names: list[str], rows: DataFrame, key: str, task: str, classes: int, k: int = 5, weights: str = "uniform", metric: str = "euclidean") -> KnnModel:
        """``rows`` hold the key and ``label``; ``inputs`` makes the columns ``names`` of them."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        shaped = settle(inputs.transform(rows).select(col(key).alias("neighbor_id"), F.array(*[col(n) for n in names]).alias("v"), F.col("label").alias("value")))
        return KnnModel(inputs, names, NeighborIndex.build(shaped, "neighbor_id", "v", metric), shaped.select("neighbor_id", "value"), k, weights, task, classes)

    def _vectors(self, df: DataFrame) -> DataFrame:
        from .neighbors import vectors
        shaped = self.inputs.transform(df).withColumn("__x", F.array(*[col(n) for n in self.names]))
        return shaped.withColumn("__x", vectors(shaped, "__x", self.index.metric))

    def transform(self, df: DataFrame) -> DataFrame:
        shaped = self._vectors(df)
        asked = settle(shaped.select(F.col("__x").alias("v")).distinct().withColumn("row_id", F.monotonically_increasing_id()))
        near = self.index.search(asked, self.k)
        valued = settle(lookup(near, self.values, "neighbor_id"))
        found = vote(valued, self.weights, self.task)
        if self.classes == 2:
            share = vote(valued, self.weights, "regression").withColumnRenamed("prediction", "score")  # class codes 0 and 1
            found = found.join(share, "query_id")
        answers = settle(asked.join(found, F.col("row_id") == F.col("query_id")).drop("row_id", "query_id").withColumnRenamed("v", "__x"))
        return lookup(shaped, answers, "__x").drop("__x", *[n for n in self.names if n not in df.columns])

    def save(self, path: str) -> None:
        self.inputs.save(f"{path}/inputs")
        self.index.save(f"{path}/index")
        self.values.write.parquet(f"{path}/values")
        facts = {f: getattr(self, f) for f in ("names", "k", "weights", "task", "classes")}
        self.values.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KnnModel:
        facts = json.loads(spark.read.text(f"{path}/facts").head()[0])
        return KnnModel(inputs=PipelineModel.load(f"{path}/inputs"), index=NeighborIndex.load(spark, f"{path}/index"), values=spark.read.parquet(f"{path}/values"), **facts)
