"""Observations to walk-forward predictions: one plan for every series, horizon and fold."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import folds, linear
from volpanel.sources.stage import stage

XS = C.HAR_VARIANTS["har_x"]


def level_rows(frame: DataFrame, horizons, keys) -> DataFrame:
    return folds.by_horizon(frame, horizons, [*keys, "obs_date", "year", "row_no", *XS])


def log_rows(rows: DataFrame) -> DataFrame:
    """Both sides in logs; regressors are floored first."""
    floor = F.lit(C.LOG_FLOOR)
    return rows.withColumns({
        **{x: F.when(F.col(x).isNotNull(), F.log(F.greatest(F.col(x), floor))) for x in XS},
        "y_level": F.col("y"), "y": F.when(F.col("y") > 0, F.log("y"))})


def coefficients(rows: DataFrame, variants, test_years, keys) -> DataFrame:
    groups = [*keys, "horizon"]
    train = folds.bucketed(rows, test_years).filter(folds.complete(C.HAR))
    moments = linear.fold_moments(train, XS, variants, groups, test_years)
    return linear.ols(moments, XS, variants, groups)


def _out(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, "model", "horizon", "fold", "test_year", "obs_date", "row_no",
                     "include_in_main", "y_true", "pred", "train_mean", "floor", "n_train")


def level_predictions(frame: DataFrame, horizons, test_years, partial_year,
                      keys=("series_id",), variants=None, naive: bool = True) -> DataFrame:
    """Level variants held at the training floor, and the two naive baselines.

    Training mean and floor come from the plain HAR rows, the widest set.
    """
    keys = list(keys)
    variants = variants or C.HAR_VARIANTS
    rows = level_rows(frame, horizons, keys)
    coefs = coefficients(rows, variants, test_years, keys)
    test = folds.test_rows(rows, test_years, partial_year).filter(folds.complete(C.HAR))
    j = test.join(coefs, [*keys, "horizon", "test_year"])
    pred = linear.linear_predictor(XS)
    models = [F.struct(F.col("variant").alias("model"), F.greatest(pred, F.col("y_min")).alias("pred"))]
    if naive:
        models += [F.when(F.col("variant") == "har", F.struct(F.lit("train_mean").alias("model"), F.col("y_mean").alias("pred"))),
                   F.when(F.col("variant") == "har", F.struct(F.lit("past_vol").alias("model"), F.col("past_vol").alias("pred")))]
    j = j.withColumns({"train_mean": F.col("y_mean"), "floor": F.col("y_min"), "n_train": F.col("n")})
    j = j.select("*", F.inline(F.array_compact(F.array(*models)))).withColumn("y_true", F.col("y"))
    return _out(j, keys)


def log_predictions(frame: DataFrame, horizons, test_years, partial_year, keys=("series_id",)) -> DataFrame:
    """Log-log variants: OLS in logs, back through exp and the smearing factor."""
    keys = list(keys)
    variants = {"har_log": C.HAR_VARIANTS["har"], "har_x_log": C.HAR_VARIANTS["har_x"]}
    rows = log_rows(level_rows(frame, horizons, keys))
    coefs = stage(coefficients(rows, variants, test_years, keys), "log_coefficients")  # read twice below
    smear = smearing(rows, coefs, test_years, keys)
    groups = [*keys, "horizon", "variant", "test_year"]
    test = folds.test_rows(rows, test_years, partial_year).filter(folds.complete(C.HAR))
    level = (folds.bucketed(rows, test_years).filter(folds.complete(C.HAR))
             .groupBy(*keys, "horizon", "fit_from").agg(F.sum("y_level").alias("s"), F.count(F.lit(1)).alias("c"),
                                                        F.min("y_level").alias("m")))
    level = (folds.replicate_to_folds(level, test_years).groupBy(*keys, "horizon", "test_year")
             .agg((F.sum("s") / F.sum("c")).alias("train_mean"), F.min("m").alias("floor")))
    j = (test.join(coefs, [*keys, "horizon", "test_year"]).join(smear, groups)
         .join(level, [*keys, "horizon", "test_year"]))
    j = j.withColumns({"model": F.col("variant"), "n_train": F.col("n"), "y_true": F.col("y_level"),
                       "pred": F.exp(linear.linear_predictor(XS)) * F.col("smearing")})
    return _out(j, keys)


def smearing(rows: DataFrame, coefs: DataFrame, test_years, keys) -> DataFrame:
    """Mean of exp(residual) over the training rows of each fold, and the residual deviation.

    Residuals depend on the fold's coefficients, so here each training row does
    meet every fold that holds it; the copies only live inside the pipeline of
    one join and its map-side aggregation.
    """
    keys = list(keys)
    train = (folds.bucketed(rows, test_years).filter(folds.complete(C.HAR))
             .select(*keys, "horizon", "fit_from", "y", *XS))
    packed = coefs.groupBy(*keys, "horizon").agg(F.collect_list(F.struct(
        "variant", "test_year", "intercept", "beta")).alias("_fits"))
    j = train.join(packed, [*keys, "horizon"])
    j = j.select(*keys, "horizon", "fit_from", "y", *XS, F.inline("_fits")).filter("fit_from <= test_year")
    resid = F.col("y") - linear.linear_predictor(XS)
    return (j.withColumn("resid", resid).groupBy(*keys, "horizon", "variant", "test_year")
            .agg(folds.duan_smearing("resid").alias("smearing"), F.stddev_samp("resid").alias("resid_log_std")))
