"""Attribution of linear forecasts and the stability of importance rankings.

Attribution rows: ``series_id, horizon, fold, test_year, feature, mean_abs``.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.stattests import average_rank

# Which group a regressor belongs to.
GROUPS = {"har_daily": "volatility", "price_vol5": "volatility", "price_vol20": "volatility",
          "implied_lag1": "implied", "idx_a_lag1": "index", "idx_b_lag1": "index"}


def beta_summary(std_betas: DataFrame, keys=("series_id", "horizon", "variant", "regressor")) -> DataFrame:
    """Spread of standardised betas over the folds of the main average and over all estimated folds."""
    sets = std_betas.withColumn("fold_set", F.explode(F.array_compact(F.array(
        F.when(F.col("include_in_main"), F.lit("main")), F.lit("all_estimated")))))
    return sets.groupBy("fold_set", *keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("std_beta").alias("mean"), F.median("std_beta").alias("median"),
        F.min("std_beta").alias("min"), F.max("std_beta").alias("max"),
        F.count_if(F.col("std_beta") > 0).alias("n_positive"), F.count_if(F.col("std_beta") < 0).alias("n_negative"))


def linear_attribution(test: DataFrame, coefs: DataFrame, regressors, keys) -> DataFrame:
    """Per row and regressor: beta * (x - training mean). The parts and the mean target add up to the forecast."""
    keys = list(keys)
    j = test.join(coefs.select(*keys, "y_mean", "beta", "x_mean"), keys)
    parts = [F.struct(F.lit(x).alias("feature"), F.col(x).alias("x"), F.col("beta")[i].alias("beta"),
                      (F.col("beta")[i] * (F.col(x) - F.col("x_mean")[i])).alias("attribution"))
             for i, x in enumerate(regressors)]
    keep = [c for c in test.columns if c not in regressors]
    return j.select(*keep, "y_mean", F.inline(F.array(*parts)))


def feature_importance(attributions: DataFrame, keys=("series_id", "horizon", "test_year")) -> DataFrame:
    return attributions.groupBy(*keys, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def importance_shares(importance: DataFrame, keys=("series_id", "horizon"), top: int = 10) -> DataFrame:
    """Fold mean of the importance, its share in %, rank and cumulative share."""
    m = importance.groupBy(*keys, "feature").agg(F.avg("mean_abs").alias("mean_abs"))
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col("mean_abs").desc(), "feature")
    tot = F.sum("mean_abs").over(whole)
    return m.withColumns({
        "share_pct": 100 * F.try_divide(F.col("mean_abs"), tot), "rank": F.row_number().over(down),
        "cumulative_pct": 100 * F.try_divide(F.sum("mean_abs").over(
            down.rowsBetween(Window.unboundedPreceding, 0)), tot)}).filter(F.col("rank") <= top)


def with_group(df: DataFrame, feature: str = "feature", groups: dict = GROUPS) -> DataFrame:
    names = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("group", names[F.col(feature)])


def group_shares(importance: DataFrame, value: str = "mean_abs", shared=("volatility", "implied"),
                 keys=("series_id", "horizon")) -> DataFrame:
    """Share of each feature group, and the share outside the groups two models have in common."""
    g = with_group(importance).groupBy(*keys, "group").agg(F.sum(value).alias("total"))
    whole = Window.partitionBy(*keys)
    share = 100 * F.try_divide(F.col("total"), F.sum("total").over(whole))
    g = g.withColumn("share_pct", share)
    return g.withColumn("outside_pct", F.sum(F.when(~F.col("group").isin(list(shared)), F.col("share_pct")).otherwise(0.0)).over(whole))


def sign_agreement(attributions: DataFrame, std_betas: DataFrame, confounded=(),
                   keys=("series_id", "horizon", "test_year")) -> DataFrame:
    """Direction corr(x, attribution) against the sign of the reference beta, per fold and feature.

    A feature with all-zero attribution is unused: it has no direction and is
    not counted as a disagreement.
    """
    keys = list(keys)
    a = attributions.groupBy(*keys, "feature").agg(
        F.try_divide(F.covar_pop("x", "attribution"), F.stddev_pop("x") * F.stddev_pop("attribution")).alias("direction"),
        (F.max(F.abs("attribution")) == 0).cast("int").alias("unused"))
    b = std_betas.select(*keys, F.col("regressor").alias("feature"), "std_beta")
    j = a.join(b, [*keys, "feature"])
    agree = F.when((F.col("unused") == 0) & F.col("direction").isNotNull(),
                   (F.signum("direction") == F.signum("std_beta")).cast("int"))
    return j.withColumns({"agrees": agree, "confounded": F.col("feature").isin(list(confounded)).cast("int")})


def agreement_summary(signs: DataFrame, *by: str) -> DataFrame:
    used = signs.filter("confounded = 0 and unused = 0")
    return used.groupBy(*by).agg(F.count("agrees").alias("n_compared"), F.sum("agrees").alias("n_agree"),
                                 (100.0 * F.try_divide(F.sum("agrees"), F.count("agrees"))).alias("agree_pct"))


def rank_stability_pairs(importance: DataFrame, sizes: DataFrame, keys=("series_id", "horizon")) -> DataFrame:
    """Spearman of the importance of every two folds, their distance and the overlap of their training sets.

    Each feature meets itself in later folds: the join key holds the feature, so
    a key is at most one row per fold.
    """
    keys = list(keys)
    r = importance.withColumn("r", average_rank("mean_abs", [*keys, "test_year"]))
    a = r.select(*keys, "feature", F.col("test_year").alias("y1"), F.col("r").alias("r1"))
    b = r.select(*keys, "feature", F.col("test_year").alias("y2"), F.col("r").alias("r2"))
    j = a.join(b, [*keys, "feature"]).filter("y1 < y2")
    rho = j.groupBy(*keys, "y1", "y2").agg(
        F.try_divide(F.covar_pop("r1", "r2"), F.stddev_pop("r1") * F.stddev_pop("r2")).alias("rho"))
    s1 = sizes.select(*keys, F.col("test_year").alias("y1"), F.col("n_train").alias("n1"))
    s2 = sizes.select(*keys, F.col("test_year").alias("y2"), F.col("n_train").alias("n2"))
    return (rho.join(s1, [*keys, "y1"]).join(s2, [*keys, "y2"])
            .withColumns({"distance": F.col("y2") - F.col("y1"), "overlap_pct": 100.0 * F.col("n1") / F.col("n2")}))


def stability_by_distance(pairs: DataFrame, keys=("series_id", "horizon")) -> DataFrame:
    return pairs.groupBy(*keys, "distance").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("rho").alias("rho_mean"),
                                                F.avg("overlap_pct").alias("overlap_mean_pct"))


def stability_summary(pairs: DataFrame, importance: DataFrame, k: int = 2, keys=("series_id", "horizon")) -> DataFrame:
    """Consecutive and first-last correlations, top-k union and the feature that leads most often."""
    keys = list(keys)
    span = pairs.groupBy(*keys).agg(
        F.avg(F.when(F.col("distance") == 1, F.col("rho"))).alias("consecutive_mean"),
        F.min(F.when(F.col("distance") == 1, F.col("rho"))).alias("consecutive_min"),
        F.max_by("rho", "distance").alias("first_last_rho"), F.max_by("overlap_pct", "distance").alias("first_last_overlap_pct"))
    down = Window.partitionBy(*keys, "test_year").orderBy(F.col("mean_abs").desc(), "feature")
    r = importance.withColumn("_k", F.row_number().over(down))
    tops = r.groupBy(*keys).agg(F.count_distinct(F.when(F.col("_k") <= k, F.col("feature"))).alias("n_in_top"),
                                F.count_distinct("test_year").alias("n_folds"))
    lead = (r.filter("_k = 1").groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
            .agg(F.max_by("feature", F.struct("n", "feature")).alias("usual_leader"), F.max("n").alias("folds_led")))
    pooled = importance.groupBy(*keys, "feature").agg(F.avg("mean_abs").alias("mean_abs"))
    pr = Window.partitionBy(*keys).orderBy(F.col("mean_abs").desc(), "feature")
    conc = (pooled.withColumn("_k", F.row_number().over(pr)).groupBy(*keys).agg(
        (100 * F.sum(F.when(F.col("_k") <= k, F.col("mean_abs"))) / F.sum("mean_abs")).alias("top_concentration_pct")))
    return span.join(tops, keys).join(lead, keys).join(conc, keys)
