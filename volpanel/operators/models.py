"""Small model operators: blends, transforms, fold sizes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import folds


def blend(preds: DataFrame, a: str, b: str, weight: float = C.BLEND_WEIGHT,
          keys=("series_id", "horizon", "fold", "test_year", "obs_date", "include_in_main")) -> DataFrame:
    """Fixed-weight average of two models; rows that lack one of them are left out."""
    wide = (preds.filter(F.col("model").isin(a, b)).groupBy(*keys)
            .agg(F.first("y_true").alias("y_true"), F.first("train_mean").alias("train_mean"),
                 F.max(F.when(F.col("model") == a, F.col("pred"))).alias("_a"),
                 F.max(F.when(F.col("model") == b, F.col("pred"))).alias("_b")))
    return (wide.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
            .withColumn("pred", weight * F.col("_a") + (1 - weight) * F.col("_b"))
            .withColumn("model", F.lit(f"blend_{a}_{b}")).drop("_a", "_b"))


def fit_target(mode: str, y: str = "y", past: str = "past_vol") -> Column:
    """Target in logs, alone or against past volatility; NULL where a log has no argument."""
    ly = F.when(F.col(y) > 0, F.log(y))
    if mode == "log":
        return ly
    if mode == "ratio":
        return ly - F.when(F.col(past) > 0, F.log(past))
    raise ValueError(f"unknown target mode {mode!r}")


def back_transform(raw: Column, smearing: Column, mode: str, past: str = "past_vol") -> Column:
    out = F.exp(raw) * smearing
    return out * F.col(past) if mode == "ratio" else out


def fold_sizes(rows: DataFrame, test_years, keys=("series_id",)) -> DataFrame:
    """Rows before each test year and in it: running sums over yearly counts."""
    keys = [*keys, "horizon"]
    per_year = rows.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n_test"))
    before = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return (per_year.withColumn("n_train_years", F.coalesce(F.sum("n_test").over(before), F.lit(0)))
            .filter(F.col("year").isin([int(y) for y in test_years]))
            .select(*keys, F.col("year").alias("test_year"), "n_train_years", "n_test"))


def size_asymmetry(frame: DataFrame, horizons, test_years, keys=("series_id",)) -> DataFrame:
    """Training rows of a model without labels beyond those of one with labels and warm-up."""
    keys = list(keys)
    usable = folds.complete(C.HAR)
    rows = frame.select(*keys, "year", F.col("ret").isNotNull().cast("long").alias("free"), F.inline(F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"), F.when(usable, F.col(f"fit_from_{h}")).alias("fit_from"))
        for h in horizons])))
    yearly = rows.groupBy(*keys, "horizon", "year").agg(F.sum("free").alias("a"))
    labelled = rows.filter("fit_from is not null").groupBy(*keys, "horizon", F.col("fit_from").alias("year")).agg(
        F.count(F.lit(1)).alias("b"))
    w = Window.partitionBy(*keys, "horizon").orderBy("year")
    out = (yearly.join(labelled, [*keys, "horizon", "year"], "full_outer").withColumns({
        "n_unlabelled": F.coalesce(F.sum("a").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n_labelled": F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
        .filter(F.col("year").isin([int(y) for y in test_years]) & F.col("a").isNotNull()))
    return out.select(*keys, "horizon", F.col("year").alias("test_year"), "n_unlabelled", "n_labelled",
                      F.col("horizon").cast("long").alias("extra_from_embargo"),
                      (F.col("n_unlabelled") - F.col("n_labelled") - F.col("horizon")).alias("extra_from_warmup"))


def align_start(frame: DataFrame, first_row: int) -> DataFrame:
    """Give every model the same first usable row."""
    return frame.filter(F.col("row_no") >= first_row)
