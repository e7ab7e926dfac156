"""Many releases of one series: what was known when, and how it was revised."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_values(vintages: DataFrame, keys=("series_id",)) -> DataFrame:
    """The newest value of each observation day."""
    return vintages.groupBy(*keys, "obs_date").agg(F.max_by("value", "vintage_date").alias("current"))


def vintage_meta(vintages: DataFrame, keys=("series_id",)) -> DataFrame:
    """Per release: last day, delay, new days, distance to the release before, difference to today."""
    keys = list(keys)
    cur = vintages.join(current_values(vintages, keys), [*keys, "obs_date"])
    per = cur.groupBy(*keys, "vintage_date").agg(
        F.max("obs_date").alias("last_obs"), F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.try_divide(F.abs(F.col("value") - F.col("current")), F.col("current"))).alias("mean_abs_rel_diff"))
    w = Window.partitionBy(*keys).orderBy("vintage_date")
    per = per.withColumns({"_prev_last": F.lag("last_obs").over(w),
                           "days_since_prev": F.datediff("vintage_date", F.lag("vintage_date").over(w)),
                           "lag_days": F.datediff("vintage_date", "last_obs")})
    new = (vintages.join(per.filter(F.col("_prev_last").isNotNull()).select(*keys, "vintage_date", "_prev_last"),
                         [*keys, "vintage_date"])
           .groupBy(*keys, "vintage_date").agg(F.count_if(F.col("obs_date") > F.col("_prev_last")).alias("n_new_obs")))
    return per.join(new, [*keys, "vintage_date"], "left").drop("_prev_last")


def first_release(vintages: DataFrame, keys=("series_id",)) -> DataFrame:
    """Earliest release that contains each day (from the first release on), and its revision since.

    One aggregation per day: a day first missing and added later gets the
    release that added it.
    """
    keys = list(keys)
    start = vintages.groupBy(*keys).agg(F.min("vintage_date").alias("_start"))
    fr = vintages.groupBy(*keys, "obs_date").agg(
        F.min("vintage_date").alias("vintage_date"), F.min_by("value", "vintage_date").alias("first_value"),
        F.max_by("value", "vintage_date").alias("current"))
    return (fr.join(start, keys).filter(F.col("obs_date") >= F.col("_start")).drop("_start")
            .withColumns({"lag_days": F.datediff("vintage_date", "obs_date"),
                          "weekday": F.date_format("obs_date", "EEEE"),
                          "revision": F.col("current") - F.col("first_value")}))


def revision_summary(fr: DataFrame, *by: str) -> DataFrame:
    """Relative revision and publication lag, grouped as asked."""
    r = F.try_divide(F.col("revision"), F.col("current"))
    return fr.withColumn("_r", r).groupBy(*by).agg(
        F.count("_r").alias("n"), F.avg("_r").alias("mean"), F.median("_r").alias("median"),
        F.avg(F.abs("_r")).alias("mean_abs"), F.median(F.abs("_r")).alias("median_abs"),
        F.max(F.abs("_r")).alias("max_abs"), F.min("lag_days").alias("lag_min"),
        F.median("lag_days").alias("lag_median"), F.max("lag_days").alias("lag_max"))


def release_exceptions(fr: DataFrame, usual_from: int = 0, usual_to: int = 6) -> DataFrame:
    """Days whose release was not the usual one of their week, by kind."""
    lag = F.col("lag_days")
    return fr.withColumn("kind", F.when(lag > usual_to, "late").when(
        F.weekday("vintage_date") != 0, "extra").when(lag < usual_from, "early").otherwise("usual"))
