"""Classifiers, calibration and blending by Spark ML."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit(pairs: DataFrame, features: tuple[str, ...], weighted: bool = False, trees: int = 30, depth: int = 5, rate: float = 0.1, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees over feature columns and label; weighted gives positives the weight negatives / positives."""
    rows = pairs
    if weighted:
        counts = pairs.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
        rows = pairs.withColumn("weight", F.when(F.col("label") == 1, F.lit(counts.n / max(1, counts.p))).otherwise(1.0))
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    trees_ = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **({"weightCol": "weight"} if weighted else {}))
    return Pipeline(stages=[assemble, trees_]).fit(rows.withColumn("label", F.col("label").cast("double")))


def score(model: PipelineModel, pairs: DataFrame, name: str = "p") -> DataFrame:
    """pairs with the probability of a match."""
    out = model.transform(pairs).withColumn(name, F.round(vector_to_array("probability")[1], 6))
    return out.drop("features", "rawPrediction", "probability", "prediction")


class Calibrator:
    """Isotonic or logistic calibration of a probability column."""

    def __init__(self, kind: str, model) -> None:
        self.kind, self.model = kind, model

    @classmethod
    def fit(cls, scored: DataFrame, kind: str = "isotonic", column: str = "p") -> Calibrator:
        rows = scored.select(F.col("label").cast("double").alias("label"), F.col(column).alias("x"))
        if kind == "isotonic":
            return cls(kind, IsotonicRegression(featuresCol="x", labelCol="label").fit(rows))
        vector = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
        return cls(kind, LogisticRegression(featuresCol="features", labelCol="label").fit(vector))

    def transform(self, scored: DataFrame, column: str = "p") -> DataFrame:
        if self.kind == "isotonic":
            rows = self.model.setFeaturesCol("__x").setPredictionCol("__y").transform(scored.withColumn("__x", F.col(column)))
            return rows.withColumn(column, F.round("__y", 6)).drop("__x", "__y")
        rows = VectorAssembler(inputCols=[column], outputCol="features").transform(scored)
        got = self.model.transform(rows)
        return got.withColumn(column, F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction")


def blend(pairs: DataFrame, columns: dict[str, float], meta: PipelineModel | None = None, name: str = "p") -> DataFrame:
    """One score of several: a fitted meta model's, else the weighted mean of the columns, else the only column's."""
    if meta is not None:
        return score(meta, pairs, name)
    total = sum(columns.values())
    mixed = sum((F.col(c) * w for c, w in columns.items()), F.lit(0.0)) / total
    return pairs.withColumn(name, mixed if len(columns) > 1 else F.col(next(iter(columns))))


def save(model: PipelineModel, folder: str, **thresholds) -> None:
    """The model and a JSON file of thresholds beside it, both through Spark's file systems."""
    model.write().overwrite().save(f"{folder}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(thresholds, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/thresholds")


def load(spark, folder: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{folder}/model"), json.loads(spark.read.text(f"{folder}/thresholds").first()[0])
