"""Forecast comparison tests over long prediction tables.

One row of a loss table is one day of one (series, horizon, pair). The
long-run variance with Bartlett weights is the mean squared rolling block sum,
so it needs one running sum and one lag instead of one column per lag:
sum over t of (P_t - P_(t-L-1))^2 / (n (L+1)), P being the running sum of the
demeaned series, zero before it starts and after it ends.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.functions import tails
from volpanel.operators.folds import finite
from volpanel.operators.panel import running_sum

KEYS = ("series_id", "horizon", "pair")


def loss_diff(preds: DataFrame, pairs, keys=("series_id", "horizon")) -> DataFrame:
    """d = e1^2 - e2^2 per pair and day on included rows, numbered by date.

    The models of a day meet in one aggregation (as many values as models);
    pairs are unfolded from that row, so no table is joined with itself.
    """
    models = sorted({m for p in pairs for m in p})
    keys = list(keys)
    wide = (preds.filter(F.col("include_in_main") & F.col("model").isin(models))
            .groupBy(*keys, "test_year", "obs_date", "row_no")
            .agg(F.first("y_true").alias("y_true"),
                 *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"p_{m}") for m in models]))
    unfolded = wide.select(*keys, "test_year", "obs_date", "row_no", "y_true", F.inline(F.array(*[
        F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"p_{a}").alias("p1"), F.col(f"p_{b}").alias("p2"))
        for a, b in pairs])))
    e1, e2 = F.col("y_true") - F.col("p1"), F.col("y_true") - F.col("p2")
    return (unfolded.filter(finite(F.col("p1")) & finite(F.col("p2")))
            .withColumns({"e1": e1, "e2": e2, "d": e1 * e1 - e2 * e2,
                          "adjustment": F.pow(F.col("p1") - F.col("p2"), 2)})
            .withColumn("f", F.col("d") + F.col("adjustment")))


def number_days(losses: DataFrame, keys=KEYS) -> DataFrame:
    """Add ``i`` = 1..n by date, in two levels (days of a year, then years)."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)
    offset = (losses.groupBy(*keys, "test_year").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "test_year", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    w = Window.partitionBy(*keys, "test_year").orderBy("obs_date")
    return (losses.join(offset, [*keys, "test_year"])
            .withColumn("i", F.col("_before") + F.row_number().over(w)).drop("_before"))


def yearly_losses(losses: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """Per key and test year: size, mean and variance of the value, and both models' MSE.

    All tests start from this small table; only the long-run variance needs the
    days again.
    """
    return losses.groupBy(*keys, "test_year").agg(
        F.count(F.lit(1)).alias("n_year"), F.avg(value).alias("m_year"), F.var_pop(value).alias("v_year"),
        F.avg(F.col("e1") * F.col("e1")).alias("mse1_year"), F.avg(F.col("e2") * F.col("e2")).alias("mse2_year"),
        F.avg("adjustment").alias("adjustment_year"))


def long_run_variance(losses: DataFrame, value: str = "d", keys=KEYS, lag: Column | None = None) -> DataFrame:
    """Per key: n, mean, gamma0, both MSEs and the Bartlett long-run variance with L = horizon - 1.

    Days are numbered and summed inside their year; earlier years enter as one
    carried sum. Each day then adds its running sum to the block that ends on it
    and takes it from the one that starts after it.
    """
    keys = list(keys)
    lag = lag if lag is not None else F.col("horizon") - 1
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("test_year").rowsBetween(Window.unboundedPreceding, -1)
    n_year = F.col("n_year")

    def mean_of(c):
        return F.sum(n_year * F.col(c)).over(whole) / F.sum("n_year").over(whole)

    y = yearly_losses(losses, value, keys).withColumns({
        "n": F.sum("n_year").over(whole), "mean": mean_of("m_year"), "mse1": mean_of("mse1_year"),
        "mse2": mean_of("mse2_year"), "mean_adjustment": mean_of("adjustment_year")})
    off = F.col("m_year") - F.col("mean")
    y = y.withColumns({
        "gamma0": F.sum(n_year * (F.col("v_year") + off * off)).over(whole) / F.col("n"),
        "_i0": F.coalesce(F.sum("n_year").over(before), F.lit(0)),
        "_p0": F.coalesce(F.sum(n_year * off).over(before), F.lit(0.0))})
    facts = ["n", "mean", "gamma0", "mse1", "mse2", "mean_adjustment"]
    w = Window.partitionBy(*keys, "test_year").orderBy("obs_date")
    days = (losses.select(*keys, "test_year", "obs_date", F.col(value).alias("_v"))
            .join(y.select(*keys, "test_year", "_i0", "_p0", *facts), [*keys, "test_year"])
            .withColumns({"i": F.col("_i0") + F.row_number().over(w), "lag": lag,
                          "P": F.col("_p0") + F.sum(F.col("_v") - F.col("mean")).over(
                              w.rowsBetween(Window.unboundedPreceding, 0))}))
    blocks = (days.select(*keys, *facts, "lag", F.inline(F.array(
        F.struct(F.col("i").alias("t"), F.col("P").alias("b")),
        F.struct((F.col("i") + F.col("lag") + 1).alias("t"), (-F.col("P")).alias("b")))))
        .groupBy(*keys, "t").agg(F.sum("b").alias("b"), *[F.first(c).alias(c) for c in (*facts, "lag")]))
    # rows with t > n hold only -P of the start, as the sum over all days is zero
    inside = F.when(F.col("t") <= F.col("n") + F.col("lag"), F.col("b") * F.col("b"))
    return (blocks.groupBy(*keys).agg(
        (F.sum(inside) / (F.first("n") * (F.first("lag") + 1))).alias("omega"), *[F.first(c).alias(c) for c in facts]))


def hln_factor(n: str = "n", h: str = "horizon") -> Column:
    n, h = F.col(n), F.col(h)
    return F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12)))


def diebold_mariano(losses: DataFrame, keys=KEYS) -> DataFrame:
    """DM, its version without autocorrelation, HLN correction and p-values per pair."""
    keys = list(keys)
    v = long_run_variance(losses, "d", keys).withColumns({"rmse1": F.sqrt("mse1"), "rmse2": F.sqrt("mse2")})
    v = v.drop("mse1", "mse2", "mean_adjustment").withColumns({
        "dm": F.col("mean") / F.sqrt(F.greatest("omega", F.lit(1e-300)) / F.col("n")),
        "dm_naive": F.try_divide(F.col("mean"), F.sqrt(F.col("gamma0") / F.col("n"))),
        "inflation": F.try_divide(F.col("omega"), F.col("gamma0")),
        "hln": hln_factor(), "rmse_ratio": F.try_divide(F.col("rmse1"), F.col("rmse2"))})
    v = v.withColumn("dm_hln", F.col("dm") * F.col("hln"))
    return v.withColumns({
        "p_normal": 2 * tails.norm_cdf(-F.abs("dm")), "p_naive": 2 * tails.norm_cdf(-F.abs("dm_naive")),
        "p_hln": tails.t_two_sided(F.col("dm_hln"), (F.col("n") - 1).cast("double"))})


def clark_west(losses: DataFrame, keys=KEYS) -> DataFrame:
    """One-sided test of a nested pair on f = e1^2 - (e2^2 - (p1 - p2)^2)."""
    keys = list(keys)
    folds = (losses.groupBy(*keys, "test_year").agg(F.avg("f").alias("m")).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n_folds"), F.avg("m").alias("f_fold_mean"),
                  F.count_if(F.col("m") > 0).alias("folds_f_positive")))
    v = long_run_variance(losses, "f", keys).join(folds, keys)
    v = v.withColumns({"cw": F.col("mean") / F.sqrt(F.greatest("omega", F.lit(1e-300)) / F.col("n")),
                       "hln": hln_factor()})
    v = v.withColumn("cw_hln", F.col("cw") * F.col("hln"))
    return v.withColumns({"p_normal": tails.norm_cdf(-F.col("cw")),
                          "p_hln": tails.t_one_sided(F.col("cw_hln"), (F.col("n") - 1).cast("double"))})


def acf(values: DataFrame, x: str, lags: Column, keys, order: str = "i") -> DataFrame:
    """Autocorrelations at the listed lags: rows meet their lagged partner by key.

    Each row is sent to the few positions it is needed at; the sums combine
    before the shuffle and nothing is gathered per series.
    """
    keys = list(keys)
    stats = values.groupBy(*keys).agg(F.avg(x).alias("_m"), F.var_pop(x).alias("_v"), F.count(x).alias("_n"))
    v = values.filter(F.col(x).isNotNull()).join(stats, keys).withColumn("_x", F.col(x) - F.col("_m"))
    late = v.select(*keys, F.col(order).alias("_at"), "_x", "_v", "_n", F.explode(lags).alias("lag"))
    early = v.select(*keys, F.col("_x").alias("_y"), F.explode(lags).alias("lag"), F.col(order).alias("_o")).select(
        *keys, "lag", (F.col("_o") + F.col("lag")).alias("_at"), "_y")
    j = late.filter(F.col("lag") < F.col("_n")).join(early, [*keys, "lag", "_at"], "left")
    return j.groupBy(*keys, "lag").agg(
        F.try_divide(F.coalesce(F.sum(F.col("_x") * F.col("_y")), F.lit(0.0)),
                     F.first("_n") * F.first("_v")).alias("acf"), F.first("_n").alias("n"))


def mean_acf(days: DataFrame, x: str, first: Column, last: Column, keys=KEYS) -> DataFrame:
    """Mean autocorrelation over the lags ``first`` to ``last`` (at most n - 1), from one running sum.

    The products of a day with all its partners are the day times a difference of running sums;
    ``days`` are numbered by ``i`` from 1 (see :func:`number_days`).
    """
    keys = list(keys)
    stats = days.groupBy(*keys).agg(F.avg(x).alias("_m"), F.var_pop(x).alias("_v"), F.count(F.lit(1)).alias("_n"))
    v = days.join(stats, keys).withColumns({"_x": F.col(x) - F.col("_m"), "_from": first, "_to": F.least(last, F.col("_n") - 1)})
    v = running_sum(v.select(*keys, "i", "_x", "_v", "_n", "_from", "_to"), {"_s": F.col("_x")}, keys, "i")
    # day i meets the days from i - to up to i - from
    ends = v.select(*keys, F.explode(F.array(F.struct((F.col("i") + F.col("_from")).alias("i"), F.col("_s").alias("s")),
                                             F.struct((F.col("i") + F.col("_to") + 1).alias("i"), (-F.col("_s")).alias("s")))).alias("e"))
    ends = ends.select(*keys, "e.i", "e.s").groupBy(*keys, "i").agg(F.sum("s").alias("_p"))
    j = v.join(ends, [*keys, "i"], "left")
    lags = F.col("_to") - F.col("_from") + 1
    return j.groupBy(*keys).agg(F.first("_n").alias("n"), F.max(F.when(lags > 0, lags)).alias("n_lags"),
                                F.try_divide(F.sum(F.col("_x") * F.coalesce("_p", F.lit(0.0))),
                                             F.first("_n") * F.first("_v") * F.max(F.when(lags > 0, lags))).alias("acf_mean"))


def binomial_two_sided(wins: Column, trials: Column) -> Column:
    """Exact p of the sign test at p = 1/2: twice the smaller tail, at most 1."""
    k = F.least(wins, trials - wins)
    # terms C(n, i) / 2^n grow by (n - i + 1) / i; the list is empty for k = 0
    idx = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    init = F.struct(F.pow(F.lit(0.5), trials).alias("term"), F.pow(F.lit(0.5), trials).alias("total"))

    def grow(a, i):
        term = a["term"] * (trials - i + 1) / i
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    tail = F.aggregate(idx, init, grow, lambda a: a["total"])
    return F.when(trials > 0, F.least(F.lit(1.0), 2 * tail))


def sign_test(losses: DataFrame, ties: str = "loss", keys=KEYS) -> DataFrame:
    """Folds model 1 wins by RMSE and the exact p.

    ``ties='loss'`` counts a tied fold against model 1; ``'drop'`` leaves it out.
    """
    keys = list(keys)
    folds = losses.groupBy(*keys, "test_year").agg(
        F.sqrt(F.avg(F.col("e1") * F.col("e1"))).alias("a"), F.sqrt(F.avg(F.col("e2") * F.col("e2"))).alias("b"))
    t = folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("a") < F.col("b")).alias("wins"),
                                 F.count_if(F.col("a") == F.col("b")).alias("ties"))
    trials = F.col("n_folds") if ties == "loss" else F.col("n_folds") - F.col("ties")
    return t.withColumn("p_sign", binomial_two_sided(F.col("wins"), trials))


def adjust(tests: DataFrame, p: str, family) -> DataFrame:
    """Holm, Benjamini-Hochberg and Benjamini-Yekutieli p-values inside each family.

    A family is a declared list of tests, so its size is small by construction.
    """
    family = list(family)
    ids = [c for c in ("series_id", "horizon", "pair", "variant") if c in tests.columns]
    order = Window.partitionBy(*family).orderBy(p, *ids)
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*family).orderBy(F.col(p).desc(), *[F.col(i).desc() for i in ids]).rowsBetween(
        Window.unboundedPreceding, 0)
    df = tests.withColumns({"_r": F.row_number().over(order), "_m": F.count(F.lit(1)).over(Window.partitionBy(*family))})
    df = df.withColumn("_c", F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0),
                                         lambda a, i: a + 1.0 / i))
    df = df.withColumns({
        f"{p}_holm": F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(up)),
        "_bh": F.min(F.col("_m") / F.col("_r") * F.col(p)).over(down)})
    return df.withColumns({f"{p}_bh": F.least(F.lit(1.0), F.col("_bh")),
                           f"{p}_by": F.least(F.lit(1.0), F.col("_bh") * F.col("_c"))}).drop("_r", "_m", "_bh", "_c")


def family_label(primary) -> Column:
    return F.when(F.col("pair").isin([f"{a}|{b}" for a, b in primary]), "primary").otherwise("secondary")


def stars(p: str) -> Column:
    return F.when(F.col(p) < 0.01, "***").when(F.col(p) < 0.05, "**").when(F.col(p) < 0.10, "*").otherwise("")


def direction_agreement(tests: DataFrame) -> DataFrame:
    """Whether the DM sign and the majority of fold wins point to the same model."""
    dm = F.when(F.col("dm_hln") < 0, 1).otherwise(2)
    sign = F.when(F.col("wins") > F.col("n_folds") / 2, 1).otherwise(2)
    return tests.withColumns({"dm_side": dm, "sign_side": sign, "agree": (dm == sign).cast("int"),
                              "both_significant": ((F.col("p_hln") < C.ALPHA) & (F.col("p_sign") < C.ALPHA)).cast("int")})


def carrying_years(losses: DataFrame, keys=KEYS, top: int = 3) -> DataFrame:
    """Years whose fold RMSE difference has the sign of the mean difference, largest first."""
    keys = list(keys)
    folds = losses.groupBy(*keys, "test_year").agg(
        (F.sqrt(F.avg(F.col("e1") * F.col("e1"))) - F.sqrt(F.avg(F.col("e2") * F.col("e2")))).alias("delta"))
    whole = Window.partitionBy(*keys)
    rank = Window.partitionBy(*keys).orderBy(F.abs("delta").desc(), "test_year")
    return (folds.withColumn("mean_delta", F.avg("delta").over(whole))
            .filter(F.signum("delta") == F.signum("mean_delta"))
            .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top))


def dm_power(ncp: Column) -> Column:
    """Power of the two-sided 5% z test at a non-centrality."""
    z = F.lit(1.959963984540054)
    return tails.norm_cdf(-z + ncp) + tails.norm_cdf(-z - ncp)


def required_sample(tests: DataFrame, rows_per_year: DataFrame | Column) -> DataFrame:
    """Blocks, rows and years that would give 80% power at the observed effect."""
    need = 1.959963984540054 + 0.8416212335729143
    blocks = F.col("n") / F.col("horizon")
    dm = F.abs("dm_hln")
    delta = dm / F.sqrt(blocks)
    req = F.pow(F.try_divide(F.lit(need), delta), 2)
    return tests.withColumns({
        "blocks": blocks, "effect_per_block": delta, "achieved_power": dm_power(dm),
        "required_blocks": req, "required_rows": req * F.col("horizon"),
        "required_years": req * F.col("horizon") / rows_per_year, "times_more": req / blocks})


def sign_power(tests: DataFrame) -> DataFrame:
    """Rejection region, achieved power and required folds of each sign test."""
    min_wins, power, required = tails.sign_tools(C.ALPHA, C.TARGET_POWER, C.MAX_POWER_FOLDS)
    n, rate = F.col("n_folds").cast("int"), F.col("wins") / F.col("n_folds")
    cases = tests.select(n.alias("_n"), rate.alias("_p")).distinct().withColumns({
        "min_wins": min_wins("_n"), "achieved_power": power("_n", "_p"), "required_folds": required("_n", "_p")})
    out = tests.join(cases, (n == F.col("_n")) & (rate == F.col("_p"))).drop("_n", "_p")
    m = F.col("min_wins").cast("long")
    return out.withColumns({"p_at_min": binomial_two_sided(m, F.col("n_folds")),
                            "p_one_below": binomial_two_sided(m - 1, F.col("n_folds"))})


def power_calibration(tests: DataFrame, effects=(0.05, 0.10, 0.20), keys=("series_id", "horizon")) -> DataFrame:
    """Power at hypothetical RMSE differences, calibrated by the family's noise level."""
    keys = list(keys)
    k = F.try_divide(F.col("dm_hln") / F.sqrt(F.col("n") / F.col("horizon")), F.pow("rmse_ratio", 2) - 1)
    cal = tests.withColumn("k", k).groupBy(*keys).agg(
        F.avg("k").alias("k_mean"), F.min("k").alias("k_min"), F.max("k").alias("k_max"),
        F.avg(F.col("n") / F.col("horizon")).alias("blocks"))
    cal = cal.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    size = F.sqrt("blocks") * F.abs(F.pow(1 - F.col("effect"), 2) - 1)
    return cal.withColumns({f"power_{s}": dm_power(size * F.col(f"k_{s}")) for s in ("mean", "min", "max")})


def average_rank(x: str, w_keys, descending: bool = False) -> Column:
    """Rank with ties averaged. Groups are lists of models or features, small by design."""
    col = F.col(x).desc() if descending else F.col(x)
    return (F.rank().over(Window.partitionBy(*w_keys).orderBy(col))
            + (F.count(F.lit(1)).over(Window.partitionBy(*w_keys, x)) - 1) / 2)


def rank_correlation(table: DataFrame, a: str, b: str, keys) -> DataFrame:
    """Spearman's rho by average ranks and Kendall's tau-b per key."""
    keys = list(keys)
    rows = table.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({
        "_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    rho = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    # pairs of models inside one key: each row meets the list of its (few) peers
    packed = rows.groupBy(*keys).agg(rho.alias("spearman"), F.count(F.lit(1)).alias("n"),
                                     F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("_v"))

    def over_pairs(f):
        return F.aggregate("_v", F.lit(0.0), lambda s, u: s + F.aggregate(
            "_v", F.lit(0.0), lambda t, v: t + f(u, v)))

    sa = lambda u, v: F.signum(u["a"] - v["a"])
    sb = lambda u, v: F.signum(u["b"] - v["b"])
    s = over_pairs(lambda u, v: sa(u, v) * sb(u, v))
    ta = over_pairs(lambda u, v: F.abs(sa(u, v)))
    tb = over_pairs(lambda u, v: F.abs(sb(u, v)))
    return packed.withColumn("kendall_tau", F.try_divide(s, F.sqrt(ta * tb))).drop("_v")


def fold_diff_dependence(folds: DataFrame, a: str, b: str, keys) -> DataFrame:
    """Pearson, Spearman and sign agreement of two fold-difference columns."""
    keys = list(keys)
    rows = folds.withColumns({"_ra": average_rank(a, keys), "_rb": average_rank(b, keys)})
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("pearson"),
        F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("spearman"),
        F.count_if(F.signum(a) == F.signum(b)).alias("same_sign"))


def fold_delta_summary(metrics: DataFrame, a: str, b: str, measures=("rmse", "mae"),
                       keys=("series_id", "horizon")) -> DataFrame:
    """Per measure: wins each way, ties, mean and median of b - a, and the mean without the worst fold."""
    keys = list(keys)
    rows = (metrics.filter(F.col("include_in_main") & F.col("model").isin(a, b))
            .select(*keys, "test_year", "model", F.inline(F.array(*[
                F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures]))))
    d = (rows.groupBy(*keys, "measure", "test_year")
         .agg((F.max(F.when(F.col("model") == b, F.col("v"))) - F.max(F.when(F.col("model") == a, F.col("v")))).alias("d")))
    n = F.count(F.lit(1))
    out = d.groupBy(*keys, "measure").agg(
        n.alias("n_folds"), F.count_if(F.col("d") > 0).alias("wins_a"), F.count_if(F.col("d") < 0).alias("wins_b"),
        F.count_if(F.col("d") == 0).alias("ties"), F.avg("d").alias("mean_delta"), F.median("d").alias("median_delta"),
        F.max("d").alias("max_delta"), F.max_by("test_year", F.struct("d", -F.col("test_year"))).alias("year_of_max"),
        F.try_divide(F.sum("d") - F.max("d"), n - 1).alias("mean_without_worst"))
    return out.withColumn("p_sign", binomial_two_sided(F.col("wins_a"), F.col("wins_a") + F.col("wins_b")))


def fold_winners(metrics: DataFrame, a: str, b: str, keys=("series_id", "horizon")) -> DataFrame:
    keys = list(keys)
    d = (metrics.filter(F.col("include_in_main") & F.col("model").isin(a, b)).groupBy(*keys, "test_year")
         .agg(F.max(F.when(F.col("model") == a, F.col("rmse"))).alias("rmse_a"),
              F.max(F.when(F.col("model") == b, F.col("rmse"))).alias("rmse_b")))
    delta = F.col("rmse_b") - F.col("rmse_a")
    return d.withColumns({"delta": delta, "winner": F.when(delta > 0, a).when(delta < 0, b).otherwise("tie")})
