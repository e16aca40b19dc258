"""A classifier of embeddings: one hidden layer, trained with Spark's own learner."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, label: str = "label", vector: str = "embedding", hidden: int = 64, rounds: int = 60, seed: int = 7) -> MultilayerPerceptronClassificationModel:
    """Labels are numbers from 0 on; gradients are summed over the cluster, and the driver holds the weights alone."""
    shape = rows.agg(F.max(label).alias("k"), F.max(F.size(vector)).alias("n")).first()
    layers = [shape["n"], hidden, shape["k"] + 1]
    data = rows.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=layers, maxIter=rounds, seed=seed, blockSize=64).fit(data)


def predicted(rows: DataFrame, model: MultilayerPerceptronClassificationModel, vector: str = "embedding") -> DataFrame:
    """rows with `predicted`, and `confidence`: the share that the model gives it."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.withColumn("features", array_to_vector(vector)))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))
