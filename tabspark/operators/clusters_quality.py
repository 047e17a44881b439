"""Quality of a clustering of vectors, in one pass per cluster and without pairs of rows."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.numeric import rounded


def as_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Turn an array column into the vector type of ``pyspark.ml``."""
    if df.schema[vector].dataType.typeName() == "array":
        return df.withColumn(vector, array_to_vector(col(vector).cast("array<double>")))
    return df


def silhouette(df: DataFrame, vector: str, cluster: str = "prediction") -> DataFrame:
    """``(metric, value)``: mean silhouette with *squared* Euclidean distance.

    That form needs per-cluster sums only; the plain-distance form would need all pairs.
    """
    data = as_vectors(df, vector).withColumn(cluster, col(cluster).cast("double"))
    value = ClusteringEvaluator(featuresCol=vector, predictionCol=cluster).evaluate(data)
    return df.sparkSession.createDataFrame(
        [("silhouette_score", round(float(value), 4))], "metric string, value double"
    )


def calinski_harabasz(df: DataFrame, vector: str, cluster: str = "prediction") -> DataFrame:
    """``(metric, value)``: between-cluster over within-cluster variance, each per degree of freedom."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(col(vector))
    clusters = (
        as_vectors(df, vector)
        .groupBy(col(cluster).alias("cluster"))
        .agg(summary.alias("s"))
        .select(
            "cluster",
            F.col("s.count").cast("double").alias("n"),
            F.posexplode(
                F.arrays_zip(
                    vector_to_array("s.mean").alias("mean"),
                    vector_to_array("s.variance").alias("variance"),
                )
            ).alias("dim", "v"),
        )
    )
    # clusters x dimensions rows from here on
    all_rows = Window.partitionBy("dim")
    centre = F.sum(F.col("n") * F.col("v.mean")).over(all_rows) / F.sum("n").over(all_rows)
    dims = clusters.withColumn("shift", F.col("v.mean") - centre).groupBy("dim").agg(
        F.sum(F.col("v.variance") * (F.col("n") - 1)).alias("within"),
        F.sum(F.col("n") * F.col("shift") * F.col("shift")).alias("between"),
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
    )
    between = F.sum("between")
    k, n = F.max("k"), F.max("n")
    value = F.try_divide(between * (n - k), F.sum("within") * (k - 1))
    return dims.agg(F.lit("calinski_harabasz").alias("metric"), rounded(value).alias("value"))
