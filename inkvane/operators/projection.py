"""Principal components of marker or embedding vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pca2(rows: DataFrame, vector: str = "v", group: str = "label") -> DataFrame:
    """For each group the centroid and spread of the first two components of the standardised vectors, and their explained variance.

    The components' signs are arbitrary, so centroids are given as absolute values.
    """
    x = rows.filter(F.col(vector).isNotNull()).select(group, array_to_vector(F.transform(vector, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))).alias("x"))
    scaler = StandardScaler(inputCol="x", outputCol="s", withMean=True, withStd=True).fit(x)
    model = PCA(k=2, inputCol="s", outputCol="c").fit(scaler.transform(x))
    shares = [float(v) for v in model.explainedVariance.toArray()]
    c = model.transform(scaler.transform(x)).select(group, vector_to_array("c").alias("c"))
    return c.groupBy(group).agg(
        F.count("*").alias("n"),
        F.abs(F.avg(F.col("c")[0])).alias("abs_centroid_1"),
        F.abs(F.avg(F.col("c")[1])).alias("abs_centroid_2"),
        ((F.stddev_pop(F.col("c")[0]) + F.stddev_pop(F.col("c")[1])) / 2).alias("spread"),
        F.lit(shares[0]).alias("explained_1"),
        F.lit(shares[1]).alias("explained_2"),
    )


def spread_reduction(projected: DataFrame, base: str, group: str = "label") -> DataFrame:
    """The rows of ``pca2`` with the percentage by which each group's spread is below that of the group ``base``."""
    of_base = F.max(F.when(F.col(group) == base, F.col("spread"))).over(W.partitionBy())  # one row for each group
    return projected.withColumn("reduction_pct", (1 - F.col("spread") / F.nullif(of_base, F.lit(0.0))) * 100)
