"""Feature scaling and clustering with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.operators.sorting import arg_max
from provenor.session import materialise


def assemble_features(df: DataFrame, cols: Sequence[str], out: str = "features_raw") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def scale_features(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Columns as a vector of z-scores (sample standard deviation; a constant column gives 0)."""
    raw = assemble_features(df, cols)
    model = StandardScaler(inputCol="features_raw", outputCol=out, withMean=True, withStd=True).fit(raw)
    return model.transform(raw)


def silhouette(df: DataFrame, features: str, label: str) -> float:
    """Mean silhouette with squared Euclidean distance, from per-cluster sums, not from pairs."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=label, metricName="silhouette", distanceMeasure="squaredEuclidean"
    ).evaluate(df)


def _fit(df: DataFrame, k: int, seed: int, features: str) -> KMeansModel:
    return KMeans(featuresCol=features, predictionCol="cluster_id", k=k, seed=seed).fit(df)


def select_k(df: DataFrame, ks: Sequence[int] = range(K.K_RANGE[0], K.K_RANGE[1] + 1), seed: int = K.ML_SEED, features: str = "features") -> DataFrame:
    """Silhouette of a KMeans fit for every k; ``df`` should be a stored or cached table."""
    scores = [(k, float(silhouette(_fit(df, k, seed, features).transform(df), features, "cluster_id"))) for k in ks]
    return df.sparkSession.createDataFrame(scores, "k int, silhouette_score double")


def best_k(scores: DataFrame) -> int:
    return arg_max(scores, "silhouette_score", "k").first()["k"]


def cluster(df: DataFrame, k: int, seed: int = K.ML_SEED, features: str = "features") -> DataFrame:
    """KMeans assignment; clusters are numbered by their centres, not by fit order."""
    model = _fit(df, k, seed, features)
    order = sorted(range(k), key=lambda i: [float(v) for v in model.clusterCenters()[i]])
    number = F.array(*[F.lit(order.index(i)) for i in range(k)])
    return model.transform(df).withColumn("cluster_id", F.element_at(number, F.col("cluster_id") + 1))


def stored_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Scaled features written once, so that every fit scans the same table."""
    scaled = scale_features(df, cols).select(*keep, vector_to_array("features").alias("__f"))
    return materialise(scaled, "features").withColumn("features", array_to_vector("__f")).drop("__f")
