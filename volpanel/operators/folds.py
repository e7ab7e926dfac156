"""Expanding-window folds: train on years before the test year, less an embargo.

The embargo drops the last h rows of the training years, so that no training
target reaches the test year. A row is in the training set of test year Y
exactly when the row h positions later lies in a year before Y; ``fit_from`` is
the first such Y. Training sets are nested, so ``fit_from`` doubles as a bucket:
additive statistics of fold Y are running sums over buckets up to Y, and no row
is copied per fold.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import features as ft
from volpanel.operators.panel import add_chunks, chunk_window, core_rows


def include_in_main(partial_year: int, long_from: int = min(C.LONG_HORIZONS),
                    year: str = "test_year", horizon: str = "horizon") -> Column:
    """The partial final year is left out of the averages at long horizons."""
    return ~((F.col(year) == partial_year) & (F.col(horizon) >= long_from))


def fold_number(test_years) -> Column:
    years = F.array(*[F.lit(int(y)) for y in test_years])
    return F.array_position(years, F.col("test_year").cast("int")).cast("int")


def complete(columns) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def model_frame(numbered: DataFrame, horizons, keys=("series_id",)) -> DataFrame:
    """Regressors, targets and bucket keys in one pass over the chunks."""
    top = max(max(horizons), 21)
    w = chunk_window(keys)
    df = add_chunks(numbered, back=top + 1, ahead=max(horizons))
    df = df.withColumn("ret", ft.log_return("price", w))
    df = df.withColumns({
        "har_daily": F.abs(F.lag("ret", 1).over(w)),
        "price_vol5": ft.past_vol("ret", w, 5), "price_vol20": ft.past_vol("ret", w, 20),
        **{f"{x}_lag1": F.lag(x, 1).over(w) for x in ("implied", *ft.INDEXES)},
        **{f"target_vol_{h}": ft.forward_vol("ret", w, h) for h in horizons},
        **{f"past_vol_{h}": ft.past_vol("ret", w, h) for h in horizons},
        **{f"fit_from_{h}": F.lead("year", h).over(w) + 1 for h in horizons}})
    return core_rows(df)


def by_horizon(frame: DataFrame, horizons, keep=()) -> DataFrame:
    """One row per horizon: ``horizon, y, past_vol, fit_from`` next to the kept columns."""
    return frame.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"), F.col(f"target_vol_{h}").alias("y"),
                 F.col(f"past_vol_{h}").alias("past_vol"), F.col(f"fit_from_{h}").alias("fit_from"))
        for h in horizons])))


def bucketed(rows: DataFrame, test_years) -> DataFrame:
    """Training rows with ``fit_from`` clamped to the first fold."""
    first, last = min(test_years), max(test_years)
    return (rows.filter(F.col("y").isNotNull() & (F.col("fit_from") <= last))
            .withColumn("fit_from", F.greatest("fit_from", F.lit(first))))


def test_rows(rows: DataFrame, test_years, partial_year: int) -> DataFrame:
    return (rows.filter(F.col("year").between(min(test_years), max(test_years)) & F.col("y").isNotNull())
            .withColumn("test_year", F.col("year")).withColumn("fold", fold_number(test_years))
            .withColumn("include_in_main", include_in_main(partial_year)))


def replicate_to_folds(rows: DataFrame, test_years) -> DataFrame:
    """One copy of a training row per fold that holds it.

    Only for statistics that do not add up over buckets (quantiles, trees).
    """
    years = F.array(*[F.lit(int(y)) for y in sorted(test_years)])
    return rows.withColumn("test_year", F.explode(
        F.filter(years, lambda y: y >= F.col("fit_from"))))


def fold_leakage(rows: DataFrame, test_years, keys=("series_id",)) -> DataFrame:
    """Per fold: last training row, first test row, and whether a target reaches the test.

    A fold without training rows counts 0 of them, has no last one and does not leak.
    ``rows`` is the output of :func:`by_horizon` with ``row_no`` and ``year`` kept.
    """
    keys = [*keys, "horizon"]
    train = (bucketed(rows, test_years).groupBy(*keys, F.col("fit_from").alias("test_year"))
             .agg(F.max("row_no").alias("m"), F.count(F.lit(1)).alias("c")))
    test = (rows.filter(F.col("year").between(min(test_years), max(test_years)))
            .groupBy(*keys, F.col("year").alias("test_year"))
            .agg(F.min("row_no").alias("first_test_row"), F.count("y").alias("n_test")))
    w = Window.partitionBy(*keys).orderBy("test_year").rowsBetween(Window.unboundedPreceding, 0)
    return (test.join(train, [*keys, "test_year"], "full_outer")
            .withColumns({"last_train_row": F.max("m").over(w), "n_train": F.coalesce(F.sum("c").over(w), F.lit(0))})
            .filter(F.col("first_test_row").isNotNull())
            .withColumn("leaks", F.coalesce(F.col("last_train_row") + F.col("horizon")
                                            >= F.col("first_test_row"), F.lit(False)).cast("int"))
            .select(*keys, "test_year", "last_train_row", "first_test_row", "n_train", "n_test", "leaks"))


def effective_n(n, horizon="horizon") -> Column:
    return F.col(n) / F.col(horizon)


def capacity_tier(n_effective: Column) -> Column:
    out = F.lit(C.TIERS[-1][1])
    for least, name, _ in reversed(C.TIERS[:-1]):
        out = F.when(n_effective >= least, F.lit(name)).otherwise(out)
    return out


def validation_span(rows: DataFrame, test_years, keys=("series_id",)) -> DataFrame:
    """Years of validation per fold: grown back from the test year until n >= 3h, at most 6.

    ``rows`` are the embargoed training rows before NULL cleanup (``year``,
    ``fit_from``, ``horizon``). Counts are taken per bucket and year, then
    combined on the small table.
    """
    keys = [*keys, "horizon"]
    first, last = min(test_years), max(test_years)
    counts = (rows.filter(F.col("fit_from") <= last)
              .groupBy(*keys, "year", F.greatest("fit_from", F.lit(first)).alias("fit_from"))
              .agg(F.count(F.lit(1)).alias("n")))
    back = F.sequence(F.lit(1), F.lit(C.MAX_VAL_YEARS))
    spans = (replicate_to_folds(counts, test_years).filter(F.col("year") < F.col("test_year"))
             .withColumn("n_years", F.explode(F.filter(
                 back, lambda k: k >= F.col("test_year") - F.col("year"))))
             .groupBy(*keys, "test_year", "n_years").agg(F.sum("n").alias("n_val")))
    enough = F.col("n_val") >= C.VAL_MIN_EFFECTIVE * F.col("horizon")
    return (spans.groupBy(*keys, "test_year").agg(
        F.coalesce(F.min(F.when(enough, F.col("n_years"))), F.max("n_years")).alias("n_val_years"),
        F.coalesce(F.expr(f"min_by(n_val, n_years) filter (where n_val >= {C.VAL_MIN_EFFECTIVE} * horizon)"),
                   F.max_by("n_val", "n_years")).alias("n_val")))


def duan_smearing(residual: str) -> Column:
    return F.avg(F.exp(residual))


def shrink_smearing(raw: Column, n_effective: Column, k: float = C.SMEARING_K) -> Column:
    """1 + n/(n+K) * (S-1)."""
    return 1 + n_effective / (n_effective + k) * (raw - 1)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    """Scale by training minimum and maximum; a constant column is only shifted."""
    return (x - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))


def fit_preprocess(rows: DataFrame, columns, log_columns, test_years, keys) -> DataFrame:
    """Per fold and column: winsor bounds and range of the (logged) training values, as rows of ``feature``.

    ``rows`` are training rows by bucket. The smallest clipped value is max(min, lower bound), so bounds and
    scale come from the same passes.
    """
    from volpanel.operators.quantiles import fold_quantiles

    rows = rows.select(*keys, "fit_from", *[(F.log1p(c) if c in log_columns else F.col(c)).alias(c) for c in columns])
    return fold_quantiles(rows, columns, C.WINSOR, test_years, keys)


def apply_preprocess(rows: DataFrame, fits: DataFrame, columns, log_columns, keys) -> DataFrame:
    """log1p, clip and min-max scale by the fitted values; test rows may leave [0, 1]. A column without fit is NULL."""
    packed = fits.groupBy(*keys, "test_year").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("q", "lo", "hi")))).alias("_fits"))
    out = rows.join(packed, [*keys, "test_year"])
    scaled = {}
    for c in columns:
        fit = F.col("_fits")[F.lit(c)]

        def clipped(x, fit=fit):
            return F.least(F.greatest(x, fit["q"][0]), fit["q"][1])

        x = F.log1p(c) if c in log_columns else F.col(c).cast("double")
        scaled[c] = F.when(F.col(c).isNotNull() & fit.isNotNull(), minmax(clipped(x), clipped(fit["lo"]), clipped(fit["hi"])))
    return out.withColumns(scaled).drop("_fits")
