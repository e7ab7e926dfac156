"""Exact quantiles of many columns and nested training sets, by narrowing bands instead of keeping values.

One pass counts values per band of the range of a column; counts of a fold are running sums over its buckets, so
no row is copied per fold. The band that holds a wanted rank becomes the next range, until its values are all
equal. What is shuffled and kept are counts: bands times buckets of a series and column, whatever its number of rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.folds import replicate_to_folds
from volpanel.sources.stage import stage

BANDS = 2048


def _log(c) -> Column:
    """Order-preserving: the logarithm on both sides of 0, moved so that all doubles stay on their side."""
    return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))


def _band() -> Column:
    """Number of the band of ``v`` in [lo, hi]; bands are even in logarithms while hi is far from lo, so that the number of
    rounds is bounded for any spread."""
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    far = (F.signum("lo") != F.signum("hi")) | (F.greatest(F.abs(lo), F.abs(hi)) > 16 * F.least(F.abs(lo), F.abs(hi)))
    part = F.when(far, (_log("v") - _log("lo")) / (_log("hi") - _log("lo"))).otherwise((v - lo) / (hi - lo))
    return F.when(hi > lo, F.least(F.floor(part * BANDS), F.lit(BANDS - 1))).otherwise(F.lit(0))


def fold_quantiles(rows: DataFrame, columns, qs, test_years, keys) -> DataFrame:
    """``*keys, test_year, feature, n, lo, hi, q``: size, range and interpolated quantiles of the values that are not NULL.

    ``rows`` are training rows with their bucket ``fit_from`` (see :func:`folds.bucketed`). The quantile of rank p = (n - 1) q lies between the
    values at floor(p) and ceil(p). Columns without values have no row.
    """
    by = [*keys, "feature"]
    long = rows.select(*keys, "fit_from", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))
    long = long.filter("v is not null")
    sizes = stage(long.groupBy(*by, "fit_from").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile_sizes")
    folds_of = stage(replicate_to_folds(sizes, test_years).groupBy(*by, "test_year").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "quantile_folds")
    p = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("k"), fn(x).cast("long").alias("rank")) for i, x in enumerate(p) for up, fn in ((0, F.floor), (1, F.ceil))])
    wanted = folds_of.select(*by, "test_year", F.inline(ranks), F.lit("").alias("node"), F.lit(0).cast("long").alias("below"))
    nodes = sizes.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("node", F.lit(""))
    found, open_ones = None, True
    while open_ones:
        inside = long.join(nodes, by).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = stage(inside.groupBy(*by, "node", _band().cast("int").alias("band"), "fit_from").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile_bands")
        fold = replicate_to_folds(counts, test_years).groupBy(*by, "node", "test_year", "band").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, "node", "test_year").orderBy("band"))
        ends = counts.groupBy(*by, "node", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hit = (wanted.join(fold.withColumn("upto", upto), [*by, "node", "test_year"])
               .filter((F.col("below") + F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("upto")))
               .join(ends, [*by, "node", "band"]))
        hit = stage(hit.select(*by, "test_year", "k", "rank", F.concat_ws(".", "node", F.col("band").cast("string")).alias("node"),
                               (F.col("below") + F.col("upto") - F.col("n")).alias("below"), "lo", "hi"), "quantile_hits")
        done = hit.filter("lo = hi").select(*by, "test_year", "k", F.col("lo").alias("value"))
        found = done if found is None else found.unionByName(done)
        wanted = hit.filter("hi > lo").drop("lo", "hi")
        nodes = hit.filter("hi > lo").select(*by, "node", "lo", "hi").distinct()
        open_ones = bool(wanted.limit(1).count())
    wide = found.groupBy(*by, "test_year").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"v{k}") for k in range(2 * len(qs))])

    def quantile(i):
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        return low + (high - low) * (p[i] - F.floor(p[i]))

    return folds_of.join(wide, [*by, "test_year"]).select(*by, "test_year", "n", "lo", "hi", F.array(*[quantile(i) for i in range(len(qs))]).alias("q"))
