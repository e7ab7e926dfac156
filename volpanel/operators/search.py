"""Search over candidate models on an embargoed validation slice, and whether its choice is above noise.

The candidates are regressions. Train-proper of fold Y is the training set of the pseudo-fold
``first_val``, the first validation year, so all fits come from one set of additive moments.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import folds, linear


def linear_trials(rows: DataFrame, spans: DataFrame, regressors, variants: dict, test_years, keys=("series_id",)) -> DataFrame:
    """One row per fold and variant: rows of train-proper and validation, and the validation error.

    ``rows`` as from :func:`folds.by_horizon`; ``spans`` from :func:`folds.validation_span`.
    Folds with fewer than 200 rows on the training side are left out.
    """
    groups = [*keys, "horizon"]
    cuts = spans.select(*groups, "test_year", (F.col("test_year") - F.col("n_val_years")).alias("first_val"))
    pseudo = range(min(test_years) - C.MAX_VAL_YEARS, max(test_years))
    ready = rows.filter(folds.complete(C.HAR))
    moments = linear.fold_moments(folds.bucketed(ready, pseudo), regressors, variants, groups, pseudo)
    fits = (linear.ols(moments, regressors, variants, groups).filter(F.col("n") >= C.MIN_TRAIN_ROWS)
            .withColumnRenamed("test_year", "first_val"))
    val = (ready.filter(F.col("y").isNotNull() & (F.col("fit_from") <= max(test_years))).join(cuts, groups)
           .filter("year >= first_val and fit_from <= test_year"))
    e = F.col("y") - F.greatest(linear.linear_predictor(regressors), F.col("y_min"))
    return (val.join(fits, [*groups, "first_val"]).groupBy(*groups, "test_year", F.col("variant").alias("trial"))
            .agg(F.first("n").cast("long").alias("n_train"), F.count(F.lit(1)).alias("n_val"), F.sqrt(F.avg(e * e)).alias("val_rmse")))


def searched(preds: DataFrame, trials: DataFrame, keys=("series_id",)) -> DataFrame:
    """Of ``preds`` (refitted on the whole training set) those of each fold's best trial; ties go to the smaller name."""
    best = trials.groupBy(*keys, "horizon", "test_year").agg(F.min(F.struct("val_rmse", "trial")).alias("b"))
    best = best.select(*keys, "horizon", "test_year", F.col("b.trial").alias("model"))
    return preds.join(best, [*keys, "horizon", "test_year", "model"])


def selection_signal(trials: DataFrame, keys=()) -> DataFrame:
    """Best, median and worst validation error of each search, and whether the choice is above noise."""
    t = trials.groupBy(*keys, "horizon", "test_year").agg(
        F.count(F.lit(1)).alias("n_trials"), F.min("val_rmse").alias("best"), F.median("val_rmse").alias("median"),
        F.max("val_rmse").alias("worst"), F.min(F.struct("val_rmse", "trial")).alias("b"))
    pct = 100 * F.try_divide(F.col("median") - F.col("best"), F.col("median"))
    return (t.withColumn("best_trial", F.col("b.trial")).drop("b")
            .withColumn("signal_pct", pct).withColumn("weak", (pct < C.SIGNAL_WEAK_PCT).cast("int")))
