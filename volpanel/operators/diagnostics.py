"""Diagnostics of a feature matrix."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_corr_pairs(df: DataFrame, columns, threshold: float) -> DataFrame:
    """Column pairs with |r| above the threshold, over the rows where both are present.

    Each task adds up its own cross products, shifted by the column means, and
    emits one row per pair; the sums meet in one small aggregation.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = np.array([0.0 if means[c] is None else means[c] for c in columns])
    left, right = np.triu_indices(len(columns), k=1)
    names = np.array(columns)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(columns)
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64") - shift
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            seen = seen.astype("float64")
            n += seen.T @ seen
            sx += x.T @ seen
            sxx += (x * x).T @ seen
            sxy += x.T @ x
        yield pd.DataFrame({
            "feature_a": names[left], "feature_b": names[right], "n": n[left, right],
            "sa": sx[left, right], "sb": sx[right, left], "saa": sxx[left, right],
            "sbb": sxx[right, left], "sab": sxy[left, right]})

    sums = (df.select(*[F.col(c).cast("double").alias(c) for c in columns])
            .mapInPandas(products, "feature_a string, feature_b string, n double, sa double, "
                                   "sb double, saa double, sbb double, sab double")
            .groupBy("feature_a", "feature_b")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]))
    va = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), F.col("n"))
    vb = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), F.col("n"))
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    r = F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    return (sums.select("feature_a", "feature_b", r.alias("r")).filter(F.abs("r") > threshold)
            .orderBy(F.abs("r").desc(), "feature_a", "feature_b"))
