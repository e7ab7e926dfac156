"""Error measures of long prediction tables.

Long table: ``series_id, model, horizon, fold, test_year, obs_date,
include_in_main, y_true, pred`` (+ ``train_mean`` where R2 needs it).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.folds import finite

FOLD = ("series_id", "model", "horizon", "fold", "test_year", "include_in_main")


def _error() -> Column:
    return F.col("y_true") - F.col("pred")


def fold_metrics(preds: DataFrame, groups=FOLD) -> DataFrame:
    """n, RMSE, MAE, R2 against the training mean and against the fold's own mean."""
    e = _error()
    agg = preds.filter(finite("pred")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        F.sum(F.pow(F.col("y_true") - F.col("train_mean"), 2)).alias("sst_train"),
        (F.var_pop("y_true") * F.count(F.lit(1))).alias("sst_own"))
    return agg.select(
        *groups, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae",
        F.when(F.col("sst_train") > 0, 1 - F.col("sse") / F.col("sst_train")).alias("r2_oos"),
        F.when(F.col("sst_own") > 0, 1 - F.col("sse") / F.col("sst_own")).alias("r2"),
        "sst_own")


def fold_mean(metrics: DataFrame, groups=("series_id", "model", "horizon"),
              columns=("rmse", "mae", "r2_oos")) -> DataFrame:
    return metrics.filter("include_in_main").groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(c).alias(f"{c}_fold_mean") for c in columns])


def pooled_metrics(preds: DataFrame, groups=("series_id", "model", "horizon")) -> DataFrame:
    """Metrics over all included rows at once; R2 against their own mean."""
    e = _error()
    return (preds.filter(F.col("include_in_main") & finite("pred")).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_pooled"), F.sqrt(F.avg(e * e)).alias("rmse_pooled"),
        F.avg(F.abs(e)).alias("mae_pooled"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("y_true") * F.count(F.lit(1)))).alias("r2_pooled")))


def reference_forecast(preds: DataFrame, model: str = "train_mean",
                       groups=("series_id", "horizon", "test_year")) -> DataFrame:
    """The reference forecast of each fold; ``constant`` says it does not vary in the fold."""
    return (preds.filter(F.col("model") == model).groupBy(*groups)
            .agg(F.min("pred").alias("reference"),
                 (F.min("pred") == F.max("pred")).alias("constant")))


def common_r2_oos(preds: DataFrame, model: str = "train_mean") -> DataFrame:
    """R2 of every model against one reference forecast per fold, and the sums behind it."""
    on = ["series_id", "horizon", "test_year"]
    j = preds.join(reference_forecast(preds, model), on)
    e = _error()
    return (j.groupBy("series_id", "model", "horizon", "test_year", "include_in_main")
            .agg(F.sum(e * e).alias("sse"),
                 F.sum(F.pow(F.col("y_true") - F.col("reference"), 2)).alias("sst"))
            .withColumn("r2_oos_common", 1 - F.try_divide(F.col("sse"), F.col("sst"))))


def pooled_r2_oos(common: DataFrame, groups=("series_id", "model", "horizon")) -> DataFrame:
    """Fold-mean and pooled R2 on the common reference, and whether their signs differ."""
    out = common.filter("include_in_main").groupBy(*groups).agg(
        F.avg("r2_oos_common").alias("r2_oos_common"),
        (1 - F.try_divide(F.sum("sse"), F.sum("sst"))).alias("r2_oos_pooled"))
    return out.withColumn("sign_differs", (
        F.signum("r2_oos_common") != F.signum("r2_oos_pooled")).cast("int"))


def qlike(y="y_true", p="pred") -> Column:
    """r - ln r - 1 with r = (y/p)^2."""
    r = F.pow(F.try_divide(F.col(y), F.col(p)), 2)
    return r - F.log(r) - 1


def qlike_table(preds: DataFrame) -> DataFrame:
    rows = preds.filter(F.col("include_in_main") & (F.col("pred") > 0) & (F.col("y_true") > 0))
    folds = rows.groupBy("series_id", "model", "horizon", "test_year").agg(
        F.avg(qlike()).alias("q"), F.count(F.lit(1)).alias("n"))
    return folds.groupBy("series_id", "model", "horizon").agg(
        F.avg("q").alias("qlike_fold_mean"),
        (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("qlike_pooled"))


def relative_to(table: DataFrame, reference: str, column: str,
                groups=("series_id", "horizon")) -> DataFrame:
    """100 * (m / m_reference - 1) beside each model's value."""
    ref = table.filter(F.col("model") == reference).select(*groups, F.col(column).alias("_ref"))
    return (table.join(ref, list(groups))
            .withColumn(f"{column}_vs_{reference}_pct", 100 * (F.try_divide(F.col(column), F.col("_ref")) - 1))
            .drop("_ref"))


def pivot_models(table: DataFrame, models, column: str, groups) -> DataFrame:
    """One column per model; the list is given, so no extra pass finds it."""
    return table.groupBy(*groups).pivot("model", list(models)).agg(F.first(column))


def decomposition(means: DataFrame, steps, column: str = "rmse_fold_mean",
                  groups=("series_id", "horizon")) -> DataFrame:
    """Percentage change along a chain of models, and from its first to its last."""
    wide = pivot_models(means, steps, column, groups)
    cols = [(100 * (F.try_divide(F.col(b), F.col(a)) - 1)).alias(f"pct_{a}_to_{b}")
            for a, b in zip(steps, steps[1:])]
    if len(steps) > 2:
        cols.append((100 * (F.try_divide(F.col(steps[-1]), F.col(steps[0])) - 1)).alias("pct_total"))
    return wide.select(*groups, *cols)


def model_errors(preds: DataFrame, models, groups=("series_id", "horizon", "test_year", "obs_date")) -> DataFrame:
    """Errors side by side, one column ``e_{model}`` per model, on included rows."""
    wide = (preds.filter("include_in_main").withColumn("e", _error())
            .groupBy(*groups).pivot("model", list(models)).agg(F.first("e")))
    return wide.select(*groups, *[F.col(m).alias(f"e_{m}") for m in models])


def error_correlation(errors: DataFrame, a: str, b: str, groups=("series_id", "horizon")) -> DataFrame:
    return errors.groupBy(*groups).agg(
        F.try_divide(F.covar_pop(f"e_{a}", f"e_{b}"),
                     F.stddev_pop(f"e_{a}") * F.stddev_pop(f"e_{b}")).alias("error_corr"),
        F.count(F.lit(1)).alias("n"))


def residual_stage_r2(errors: DataFrame, base: str, final: str,
                      groups=("series_id", "horizon", "test_year")) -> DataFrame:
    """1 - sum (e - e_hat)^2 / sum e^2: what a second stage explains of the first's errors."""
    return errors.groupBy(*groups).agg(
        (1 - F.try_divide(F.sum(F.pow(f"e_{final}", 2)), F.sum(F.pow(f"e_{base}", 2)))).alias("resid_r2"))


def floor_frequency(preds: DataFrame) -> DataFrame:
    """Rows held at the training floor, their share, and the year with most of them."""
    hit = (F.col("pred") == F.col("floor")).cast("long")
    years = preds.filter("include_in_main").groupBy("series_id", "model", "horizon", "test_year").agg(
        F.sum(hit).alias("k"), F.count(F.lit(1)).alias("m"))
    return years.groupBy("series_id", "model", "horizon").agg(
        F.sum("k").alias("n_floored"), F.sum("m").alias("n"),
        (100.0 * F.sum("k") / F.sum("m")).alias("pct_floored"),
        F.expr("max_by(test_year, struct(k / m, -test_year)) filter (where k > 0)").alias("densest_year"))


def loss_concentration(preds: DataFrame, loss: Column, share: float = 0.01,
                       groups=("series_id", "model", "horizon")) -> DataFrame:
    """Share of the total loss in the largest ``share`` of rows, and the largest row.

    Ranks are exact and two-level: losses are counted per value band first, and
    only the band that holds the cut is ranked, so no group meets in one task.
    """
    groups = list(groups)
    rows = preds.filter("include_in_main").withColumn("_loss", loss)
    # bands: binary exponent and four mantissa steps, monotone in the loss
    band = F.when(F.col("_loss") > 0, F.floor(F.log2("_loss") * 16)).otherwise(F.lit(-20000)).cast("long")
    rows = rows.withColumn("_band", band)
    bands = rows.groupBy(*groups, "_band").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_loss").alias("_s"),
        F.max_by(F.struct("obs_date", (F.col("y_true") / F.col("pred")).alias("ratio")),
                 F.struct("_loss", "obs_date")).alias("_top"), F.max("_loss").alias("_max"))
    above = Window.partitionBy(*groups).orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    bands = bands.withColumns({
        "_above": F.coalesce(F.sum("_n").over(above), F.lit(0)),
        "_k": F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) * share))})
    full = bands.groupBy(*groups).agg(
        F.first("_k").alias("k"), F.sum("_n").alias("n"), F.sum("_s").alias("_total"),
        F.max_by("_top", "_band").alias("_top"),
        F.coalesce(F.sum(F.when(F.col("_above") + F.col("_n") <= F.col("_k"), F.col("_s"))), F.lit(0.0)).alias("_whole"))
    cut = bands.filter((F.col("_above") < F.col("_k")) & (F.col("_above") + F.col("_n") > F.col("_k")))
    order = Window.partitionBy(*groups).orderBy(F.col("_loss").desc(), "obs_date")
    part = (rows.join(cut.select(*groups, "_band", "_above", "_k"), [*groups, "_band"])
            .withColumn("_r", F.row_number().over(order) + F.col("_above"))
            .filter(F.col("_r") <= F.col("_k")).groupBy(*groups).agg(F.sum("_loss").alias("_part")))
    return full.join(part, groups, "left").select(
        *groups, "n", "k",
        (100 * (F.col("_whole") + F.coalesce("_part", F.lit(0.0))) / F.col("_total")).alias("top_share_pct"),
        F.col("_top.obs_date").alias("top_date"), F.col("_top.ratio").alias("top_ratio"))


def smearing_summary(folds: DataFrame, groups=("series_id", "model", "horizon")) -> DataFrame:
    """Spread of the smearing factor over folds and how many are weak."""
    from volpanel import config as C
    return folds.groupBy(*groups).agg(
        F.median("smearing").alias("smearing_median"), F.min("smearing").alias("smearing_min"),
        F.max("smearing").alias("smearing_max"),
        F.count_if(F.col("smearing") < C.SMEARING_WEAK).alias("n_weak"),
        F.avg(F.abs(F.col("smearing") - 1)).alias("raw_deviation"),
        F.avg(F.abs(F.col("smearing_shrunk") - 1)).alias("shrunk_deviation"))


def degenerate_forecast(preds: DataFrame, groups=FOLD, limit: float = 0.10) -> DataFrame:
    """Forecasts that barely move: population sd(pred) / sd(y) below the limit."""
    ratio = F.try_divide(F.stddev_pop("pred"), F.stddev_pop("y_true"))
    return preds.groupBy(*groups).agg(ratio.alias("sd_ratio")).withColumn(
        "degenerate", (F.col("sd_ratio") < limit).cast("int"))


def best_of(means: DataFrame, column: str = "rmse_fold_mean", groups=("series_id", "horizon")) -> DataFrame:
    return means.groupBy(*groups).agg(
        F.min_by("model", F.struct(column, "model")).alias("best_model"), F.min(column).alias("best"))


def partial_year_footnote(metrics: DataFrame) -> DataFrame:
    return metrics.filter(~F.col("include_in_main"))


def by_procedure(metrics: DataFrame, procedure: str = "procedure") -> DataFrame:
    """Fold means per procedure and over all of them: the one grouping-sets shape."""
    return (metrics.filter("include_in_main")
            .groupingSets([["horizon", "model", procedure], ["horizon", "model"]],
                          "horizon", "model", procedure)
            .agg(F.count(F.lit(1)).alias("n_folds"), F.avg("rmse").alias("rmse_fold_mean"),
                 F.avg("mae").alias("mae_fold_mean"), F.grouping(procedure).cast("int").alias("all_procedures")))


def best_in_family(means: DataFrame, family, reference, column: str = "rmse_fold_mean", groups=("series_id", "horizon")) -> DataFrame:
    """The best model of ``family`` against the best of ``reference``, in percent of the latter."""
    groups, top = list(groups), {}
    for name, models in (("family", family), ("reference", reference)):
        one = means.filter(F.col("model").isin(list(models))).groupBy(*groups).agg(F.min(F.struct(column, "model")).alias("b"))
        top[name] = one.select(*groups, F.col("b.model").alias(f"best_{name}"), F.col(f"b.{column}").alias(f"{name}_value"))
    pct = 100 * (F.try_divide(F.col("family_value"), F.col("reference_value")) - 1)
    return top["family"].join(top["reference"], groups).withColumn("pct", pct)


def fold_correlation(metrics: DataFrame, a: str, b: str, reference: str, groups=("series_id", "horizon")) -> DataFrame:
    """Correlation over included folds of two models' errors: as they are, and relative to ``reference``."""
    wide = (metrics.filter("include_in_main").groupBy(*groups, "test_year").pivot("model", list(dict.fromkeys([a, b, reference])))
            .agg(F.first("rmse")))
    wide = wide.withColumns({"_a": F.try_divide(a, reference), "_b": F.try_divide(b, reference)})

    def corr(x, y):
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    return wide.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_folds"), corr(a, b).alias("fold_corr"), corr("_a", "_b").alias("relative_corr"))


def near_floor(preds: DataFrame, loss: Column, factor: float = 1.25, groups=("series_id", "model", "horizon")) -> DataFrame:
    """Rows whose forecast is at most ``factor`` times its training floor, and their part in the loss."""
    ratio = F.try_divide("pred", "floor")
    rows = preds.filter("include_in_main").withColumns({"_l": loss, "_k": ratio, "_near": ratio <= factor})
    rest = F.when(~F.col("_near"), F.col("_l"))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_near").alias("n_near"), F.min("_k").alias("ratio_min"), F.max("_k").alias("ratio_max"),
        (100 * F.try_divide(F.coalesce(F.sum(F.when(F.col("_near"), F.col("_l"))), F.lit(0.0)), F.sum("_l"))).alias("near_share_pct"),
        F.avg("_l").alias("loss_all"), F.avg(rest).alias("loss_without"))


def markedly_low(losses: DataFrame, factor: float = 0.5, groups=("series_id", "horizon")) -> DataFrame:
    """The rule ``pred_a < factor * pred_b``: its rows, their years, and what the losses are without them.

    ``losses``: pred_a, pred_b, loss_a, loss_b and test_year per row. Sums are taken per fold first.
    """
    groups = list(groups)
    rule, d = F.col("pred_a") < factor * F.col("pred_b"), F.col("loss_a") - F.col("loss_b")
    folds = losses.withColumns({"_r": rule, "_d": d}).groupBy(*groups, "test_year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_r").alias("k"), F.sum("_d").alias("d"),
        F.coalesce(F.sum(F.when(F.col("_r"), F.col("_d"))), F.lit(0.0)).alias("dk"),
        *[F.sum(F.when(~F.col("_r"), F.col(f"loss_{x}"))).alias(x) for x in "ab"])
    left = F.sum(F.col("n") - F.col("k"))
    years = F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.concat(F.col("test_year").cast("string"), F.lit(" ("), F.col("k").cast("string"), F.lit(")")))))
    return folds.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum("k").alias("n_low"), F.array_join(years, ", ").alias("low_years"), F.sum("d").alias("difference"),
        F.sum("dk").alias("low_difference"), (100 * F.try_divide(F.sum("dk"), F.sum("d"))).alias("low_share_pct"),
        *[F.try_divide(F.sum(x), left).alias(f"pooled_{x}") for x in "ab"],
        *[F.avg(F.try_divide(F.col(x), F.col("n") - F.col("k"))).alias(f"fold_mean_{x}") for x in "ab"])
