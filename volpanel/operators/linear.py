"""Least squares per series, horizon, fold and variant from additive moments.

The rows are read once: each bucket (see :mod:`folds`) gives counts, means and
centred products by ordinary aggregation with map-side combine. Fold moments are
running sums over buckets on that small table, and only the k x k systems are
solved in NumPy, a whole Arrow batch at a time.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pairs(k: int):
    return [(i, j) for i in range(k) for j in range(i, k)]


def fold_moments(rows: DataFrame, regressors, variants: dict, groups, test_years,
                 y: str = "y") -> DataFrame:
    """Moments of every fold and variant: ``n, y_min``, means ``m_i`` and products ``c_i_j``.

    ``rows`` are bucketed training rows; index k of the moments is ``y``. A row
    counts for a variant when all regressors of that variant are present. Means
    are taken against a reference mean of the group before they are combined,
    which keeps the products exact for regressors far from zero.
    """
    groups, xs = list(groups), list(regressors)
    k = len(xs)
    cols = [*xs, y]
    ids, pairs = range(k + 1), _pairs(k + 1)
    present = " + ".join(f"if({x} is not null, {1 << i}, 0)" for i, x in enumerate(xs))
    buckets = (rows.withColumn("_present", F.expr(present)).groupBy(*groups, "fit_from", "_present").agg(
        F.count(F.lit(1)).alias("n"), F.min(y).alias("y_min"),
        *[F.expr(f"avg({c}) as m_{i}") for i, c in enumerate(cols)],
        *[F.expr(f"covar_pop({cols[i]}, {cols[j]}) as c_{i}_{j}") for i, j in pairs]))
    whole = Window.partitionBy(*groups).orderBy("fit_from", "_present").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    refs = [f"r_{i}" for i in ids]
    buckets = buckets.withColumns({f"r_{i}": F.first(f"m_{i}", ignorenulls=True).over(whole) for i in ids})
    masks = ", ".join(f"named_struct('variant', '{name}', 'mask', {sum(1 << xs.index(x) for x in cs)})"
                      for name, cs in variants.items())
    parts = (buckets.selectExpr(*groups, "fit_from", "_present", "n", "y_min", *refs, f"inline(array({masks}))",
                                *[f"coalesce(m_{i} - r_{i}, 0D) as d_{i}" for i in ids],
                                *[f"coalesce(c_{i}_{j}, 0D) as c_{i}_{j}" for i, j in pairs])
             .filter("(_present & mask) = mask")
             .selectExpr(*groups, "variant", "fit_from", "n", "y_min", *refs,
                         *[f"n * d_{i} as s_{i}" for i in ids],
                         *[f"n * (c_{i}_{j} + d_{i} * d_{j}) as p_{i}_{j}" for i, j in pairs]))
    keys = [*groups, "variant"]
    sums = ["n", *[f"s_{i}" for i in ids], *[f"p_{i}_{j}" for i, j in pairs]]
    # on this small table a bucket simply joins every later fold
    years = ", ".join(str(int(t)) for t in sorted(test_years))
    merged = (parts.withColumn("test_year", F.expr(f"explode(array({years}))"))
              .filter("fit_from <= test_year")
              .groupBy(*keys, "test_year").agg(*[F.expr(f"sum({c}) as {c}") for c in sums],
                                               F.min("y_min").alias("y_min"),
                                               *[F.expr(f"first({r}) as {r}") for r in refs]))
    return merged.selectExpr(
        *keys, "test_year", "n", "y_min", *[f"r_{i} + s_{i} / n as m_{i}" for i in ids],
        *[f"p_{i}_{j} - s_{i} * s_{j} / n as c_{i}_{j}" for i, j in pairs])


def solve_batch(c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve stacked k x k systems, scaled to unit diagonal; minimum norm if singular."""
    scale = np.sqrt(np.einsum("nii->ni", c))
    safe = np.where(scale > 0, scale, 1.0)
    r = c / safe[:, :, None] / safe[:, None, :]
    q = b / safe
    eig = np.linalg.eigvalsh(r)
    good = eig[:, 0] > 1e-12 * np.maximum(eig[:, -1], 1e-300)
    out = np.zeros_like(b)
    if good.any():
        out[good] = np.linalg.solve(r[good], q[good][:, :, None])[:, :, 0] / safe[good]
    for i in np.flatnonzero(~good):
        out[i] = np.linalg.pinv(c[i], rcond=1e-12, hermitian=True) @ b[i]
    return out


def ols(moments: DataFrame, regressors, variants: dict, groups) -> DataFrame:
    """Coefficients from :func:`fold_moments`.

    ``beta`` and ``sd_x`` (population) are in the order of ``regressors``; unused
    regressors have beta 0.
    """
    groups, xs = list(groups), list(regressors)
    k = len(xs)
    used = {name: [xs.index(x) for x in cs] for name, cs in variants.items()}
    keep = [*groups, "variant", "test_year", "n", "y_min"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = len(pdf)
            c = np.zeros((size, k + 1, k + 1))
            for i, j in _pairs(k + 1):
                c[:, i, j] = c[:, j, i] = pdf[f"c_{i}_{j}"].to_numpy("float64")
            m = pdf[[f"m_{i}" for i in range(k + 1)]].to_numpy("float64")
            c, m = np.nan_to_num(c), np.nan_to_num(m)
            beta = np.zeros((size, k))
            for name, idx in used.items():
                at = np.flatnonzero((pdf["variant"] == name).to_numpy())
                if len(at):
                    rows = np.ix_(at, idx)
                    beta[rows] = solve_batch(c[at][:, idx][:, :, idx], c[at][:, idx, k])
            n = pdf["n"].to_numpy("float64")
            out = pdf[keep].copy()
            out["y_mean"] = m[:, k]
            out["intercept"] = m[:, k] - (beta * m[:, :k]).sum(axis=1)
            out["beta"] = list(beta)
            out["x_mean"] = list(m[:, :k])
            var = np.maximum(np.einsum("nii->ni", c) / n[:, None], 0)
            out["sd_x"] = list(np.sqrt(var[:, :k]))
            out["sd_y"] = np.sqrt(var[:, k])
            yield out

    schema = T.StructType([f for f in moments.schema.fields if f.name in keep])
    schema = T.StructType([schema[c] for c in keep])
    for name in ("y_mean", "intercept"):
        schema = schema.add(name, T.DoubleType())
    for name in ("beta", "x_mean", "sd_x"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    schema = schema.add("sd_y", T.DoubleType())
    return moments.mapInPandas(solve, schema)


def linear_predictor(regressors):
    """intercept + sum of beta*x as one plain expression."""
    out = F.col("intercept")
    for i, x in enumerate(regressors):
        out = out + F.when(F.col("beta")[i] == 0, F.lit(0.0)).otherwise(F.col("beta")[i] * F.col(x))
    return out


def standardized_betas(coefs: DataFrame, regressors, variants: dict) -> DataFrame:
    """beta * sd(x) / sd(y) with population deviations of the training rows, one row per regressor."""
    xs = list(regressors)
    rows = coefs.withColumn("r", F.explode(F.arrays_zip(
        F.array(*[F.lit(x) for x in xs]).alias("regressor"), "beta", "sd_x", "x_mean")))
    is_used = F.lit(False)
    for name, cs in variants.items():
        is_used = is_used | ((F.col("variant") == name) & F.col("r.regressor").isin(list(cs)))
    keep = [c for c in coefs.columns if c not in ("beta", "sd_x", "x_mean")]
    return (rows.filter(is_used).select(
        *keep, F.col("r.regressor").alias("regressor"), F.col("r.beta").alias("beta"),
        F.col("r.x_mean").alias("x_mean"), F.col("r.sd_x").alias("sd_x"))
        .withColumn("std_beta", F.try_divide(F.col("beta") * F.col("sd_x"), F.col("sd_y"))))
