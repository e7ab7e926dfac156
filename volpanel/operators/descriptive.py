"""Descriptive statistics of long value tables (keys, ``i``, ``x``)."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions import tails
from volpanel.operators.panel import CHUNK_ROWS, add_chunks, chunk_window, core_rows
from volpanel.operators.stattests import acf
from volpanel.sources.stage import stage

# Asymptotic critical values of the test with a constant (MacKinnon).
ADF_CRITICAL = {"1": -3.43035, "5": -2.86154, "10": -2.56677}
# P-values with a constant (MacKinnon 1994): polynomials below and above a point, and where they hold.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_RANGE = -1.61, (-18.83, 2.74)


def descriptive_stats(values: DataFrame, x: str, keys) -> DataFrame:
    """N, mean, deviation, range, and bias-corrected skewness and excess kurtosis."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    return values.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2).alias("skew"),
        (F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("excess_kurtosis"))


def dense_index(values: DataFrame, keys, order: str = "i") -> DataFrame:
    """Renumber the rows that are left 1..n, in two levels of ``CHUNK_ROWS`` positions."""
    keys = list(keys)
    v = values.withColumn("_b", F.floor(F.col(order) / CHUNK_ROWS))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = v.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    return (v.join(off, [*keys, "_b"]).withColumn("_i", F.col("_o") + F.row_number().over(w))
            .drop("_b", "_o", order).withColumnRenamed("_i", order))


def ljung_box(values: DataFrame, x: str, lags: int, keys) -> DataFrame:
    """Q = n(n+2) sum rho_k^2 / (n-k) and its chi-squared tail."""
    r = acf(values, x, F.sequence(F.lit(1), F.lit(lags)), keys)
    q = r.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(
        F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"), F.first("n").alias("n"))
    return q.withColumn("p", tails.chi2_sf(F.col("q"), F.lit(float(lags))))


def adf_top(n: int) -> int:
    """Highest lag order for n values."""
    return min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)


def adf_p(stat: float) -> float:
    """Approximate p-value of the statistic with a constant, from the response surface."""
    if stat > ADF_RANGE[1]:
        return 1.0
    if stat < ADF_RANGE[0]:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(ADF_SMALL if stat <= ADF_STAR else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_moments(r: dict, q: int) -> tuple[int, np.ndarray]:
    """(rows, centred products) of level, d1..dq and d0 over the rows that have q lagged differences.

    Row t pairs d(t - i) with d(t - j): the sum over all t is the product sum at distance j - i, less its first and last
    terms, which the first and last q + 1 values give."""
    first, last, a, b = r["first"][:q + 1], r["last"][len(r["last"]) - q - 1:], r["a"], r["b"]
    df, dl, n = np.diff(first), np.diff(last), r["n"] - 1 - q
    s = np.zeros((q + 2, q + 2))  # level, d0, d1, ...
    for k in range(q + 1):
        early = np.append(0.0, np.cumsum(df[k:] * df[:q - k]))
        late = np.append(0.0, np.cumsum((dl[k:] * dl[:q - k])[::-1]))
        for i in range(q + 1 - k):
            s[1 + i, 1 + i + k] = s[1 + i + k, 1 + i] = a[k] - early[q - i - k] - late[i]
        s[0, 1 + k] = s[1 + k, 0] = b[k] - first[k:q] @ df[:q - k]
    s[0, 0] = r["xx"] - last[-1] ** 2 - first[:q] @ first[:q]
    one = np.concatenate([[r["x"] - last[-1] - first[:q].sum()], last[::-1][:q + 1] - first[::-1][:q + 1]])
    s -= np.outer(one, one) / n
    order = [0, *range(2, q + 2), 1]
    return n, s[np.ix_(order, order)]


def adf_fit(r: dict, top: int) -> tuple[float, int, int] | None:
    """(statistic, lag order, rows used): orders are compared on the rows that all can use, the best one is refitted."""
    try:
        n, c = adf_moments(r, top)
        low = np.linalg.cholesky(c)  # nested: the first columns serve the lower orders
        rss = c[-1, -1] - np.cumsum(low[-1, :-1] ** 2)
        q = int(np.argmin(n * np.log(rss / n) + 2 * (np.arange(top + 1) + 2)))
        n, c = adf_moments(r, q)
        order = [*range(1, q + 1), 0, q + 1]
        low = np.linalg.cholesky(c[np.ix_(order, order)])
    except np.linalg.LinAlgError:
        return None
    return float(low[-1, -2] / np.sqrt(low[-1, -1] ** 2 / (n - q - 2))), q, n


def adf(frame: DataFrame, variables, max_lag: int | None = None, keys=("series_id",)) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant, lag order by AIC up to a bound that follows each series' length.

    One pass over the rows leaves, per series and variable, the product sums at distances 0, 1, ... and the first and
    last few values; every moment matrix follows from these, so the width is linear in the lag bound, which
    may differ by series. A series that is too short or whose moments are singular has no row.
    """
    by = [*keys, "variable"]
    long = frame.select(*keys, "row_no", F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])))
    long = dense_index(long.filter("x is not null"), by, "row_no")
    n = F.col("n")
    rule = F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")
    sizes = long.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    sizes = stage(sizes.withColumn("top", rule if max_lag is None else F.least(rule, F.lit(max_lag))).filter("top >= 0"), "adf_sizes")
    top = sizes.agg(F.max("top")).first()[0] or 0
    w = chunk_window(by)
    df = add_chunks(long.join(sizes, by).withColumn("x", F.col("x") - F.col("mean")), back=top + 2)
    df = df.withColumns({"level": F.lag("x", 1).over(w), "d": F.col("x") - F.lag("x", 1).over(w)})
    df = core_rows(df.withColumns({f"d{k}": F.lag("d", k).over(w) for k in range(1, top + 1)}).withColumn("d0", F.col("d")))
    edge = F.struct("row_no", "x")
    sums = df.groupBy(*by, "n", "top").agg(
        F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.array(*[F.sum(F.col("d0") * F.col(f"d{k}")) for k in range(top + 1)]).alias("a"),
        F.array(*[F.sum(F.col("level") * F.col(f"d{k}")) for k in range(top + 1)]).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("row_no") <= F.col("top") + 1, edge))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("row_no") >= n - F.col("top"), edge))).alias("last"))
    sums = sums.withColumns({c: F.transform(c, lambda e: e["x"]) for c in ("first", "last")})
    names = [*by, "adf_stat", "adf_lag", "n_used", "p", "rejects_at_pct"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                r |= {c: np.array([np.nan if v is None else v for v in r[c]], float) for c in ("a", "b", "first", "last")}
                if (got := adf_fit(r, r["top"])) is not None and np.isfinite(got[0]):
                    verdict = next((lv for lv in ("1", "5", "10") if got[0] < ADF_CRITICAL[lv]), "none")
                    rows.append((*[r[c] for c in by], *got, adf_p(got[0]), verdict))
            yield pd.DataFrame(rows, columns=names)

    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name in keys)
    return sums.mapInPandas(choose, f"{key_types}, variable string, adf_stat double, adf_lag int, n_used long, p double, rejects_at_pct string")
