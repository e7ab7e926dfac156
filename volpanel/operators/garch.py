"""GARCH(1,1) by likelihood grid with variance targeting.

For fixed (alpha, beta) the variance is a linear recursion, so it is read off
decayed sums of returns and squared returns. Those depend on beta alone and are
computed once per series; the folds' means and variances enter as plain
arithmetic afterwards. Declared differences: Gaussian likelihood on a grid in
place of a Student-t optimum.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.panel import add_chunks, core_rows, decay_block, decayed_sums

# The grid: persistence is kept below one.
ALPHAS = (0.03, 0.06, 0.1, 0.15)
BETAS = (0.7, 0.8, 0.87, 0.92)


def _tag(b: float) -> str:
    return str(b).replace(".", "_")


def decay_table(returns: DataFrame, betas=BETAS, keys=("series_id",)) -> DataFrame:
    """Per row and beta the decayed sums over returns of rows before it: of r^2, r and 1."""
    keys = list(keys)
    df = add_chunks(returns.filter("ret is not null").withColumn("row_no", F.col("row_no") - 1),
                    back=2 * max(decay_block(b) for b in betas) + 1)
    r = F.col("ret")
    w = Window.partitionBy(*keys, "_chunk").orderBy("row_no")
    sums = {f"s{k}_{_tag(b)}": (x, b) for b in betas for k, x in ((2, r * r), (1, r))}
    df = decayed_sums(df, sums, keys)
    # the value before this row's own return
    df = df.withColumns({c: F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)) for c in sums})
    return core_rows(df)


def fold_parameters(returns: DataFrame, test_years, keys=("series_id",)) -> DataFrame:
    """Mean and variance of the training returns of each fold: running moments over years, no embargo."""
    keys = list(keys)
    years = (returns.filter("ret is not null").groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")))
    y = F.array(*[F.lit(int(t)) for t in test_years])
    cum = (years.withColumn("test_year", F.explode(F.filter(y, lambda t: t > F.col("year"))))
           .groupBy(*keys, "test_year").agg(F.sum("n").alias("n_train"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    mu = F.col("s") / F.col("n_train")
    return cum.select(*keys, "test_year", "n_train", mu.alias("mu"), (F.col("q") / F.col("n_train") - mu * mu).alias("var"))


def variance(beta: float, alpha) -> "F.Column":
    """sigma^2 of the row from the decayed sums, the fold's mean and long-run variance.

    sigma^2_t = omega (1-b^t)/(1-b) + b^t var + alpha sum_i b^i (r_(t-1-i) - mu)^2
    """
    b = float(beta)
    t = F.col("row_no")
    geo = (1 - F.pow(F.lit(b), t)) / (1 - b)
    s2, s1, mu, var = F.col(f"s2_{_tag(b)}"), F.col(f"s1_{_tag(b)}"), F.col("mu"), F.col("var")
    omega = (1 - alpha - b) * var
    shock = s2 - 2 * mu * s1 + mu * mu * geo
    return omega * geo + F.pow(F.lit(b), t) * var + alpha * shock


def fit_grid(table: DataFrame, params: DataFrame, alphas=ALPHAS, betas=BETAS, keys=("series_id",)) -> DataFrame:
    """Best (alpha, beta) of each series and fold by Gaussian likelihood over its training returns."""
    keys = list(keys)
    packed = params.groupBy(*keys).agg(F.collect_list(F.struct("test_year", "mu", "var")).alias("_p"))
    rows = table.join(packed, keys).select("*", F.inline("_p")).filter("year < test_year and var > 0")
    e2 = F.pow(F.col("ret") - F.col("mu"), 2)
    cells = [(a, b) for a in alphas for b in betas if a + b < 0.999]
    sums = []
    for i, (a, b) in enumerate(cells):
        s = variance(b, a)
        sums.append(F.sum(-0.5 * (F.log(s) + e2 / s)).alias(f"ll{i}"))
    ll = rows.groupBy(*keys, "test_year").agg(*sums)
    grid = F.array(*[F.struct(F.col(f"ll{i}").alias("loglik"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"))
                     for i, (a, b) in enumerate(cells)])
    return ll.select(*keys, "test_year", F.array_max(grid).alias("g")).select(*keys, "test_year", "g.*")


def forecast(table: DataFrame, fits: DataFrame, params: DataFrame, targets: DataFrame, betas=BETAS,
             keys=("series_id",)) -> DataFrame:
    """Volatility of days t+1..t+h with information up to t-1: steps 2..h+1 averaged, then the root.

    ``targets`` holds ``row_no, horizon, test_year`` of the rows to forecast. The
    variance of row t from returns up to t-1 is the one-step forecast of origin t-1.
    """
    keys = list(keys)
    chosen = fits.join(params, [*keys, "test_year"])
    j = table.drop("ret", "year").join(targets.withColumn("row_no", F.col("row_no") - 1), [*keys, "row_no"]).join(
        chosen, [*keys, "test_year"])
    s = F.lit(None).cast("double")
    for b in betas:
        s = F.when(F.col("beta") == b, variance(b, F.col("alpha"))).otherwise(s)
    p, h = F.col("alpha") + F.col("beta"), F.col("horizon")
    # mean of p^(j-1), j = 2..h+1
    weight = p * (1 - F.pow(p, h)) / (1 - p) / h
    # the variance reads row_no, so it goes first
    return (j.withColumn("pred", F.sqrt(F.col("var") + weight * (s - F.col("var"))))
            .withColumn("row_no", F.col("row_no") + 1))
