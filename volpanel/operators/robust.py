"""Robustness: the same forecasts on other samples, targets and variants."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators import features as ft
from volpanel.operators.alignment import features_as_published, release_monday
from volpanel.operators.panel import add_chunks, chunk_window, core_rows
from volpanel.operators.asof import asof_join
from volpanel.operators.stattests import average_rank
from volpanel.sources.stage import stage

INDEX_COLUMNS = [c for c in ft.FEATURES if "idx_" in c or c == "index_ratio"]


#: Rows on both sides of a spoiled day that a variant holds; the longest window meets 127 rows.
REACH = 160


def availability_sensitivity(numbered: DataFrame, sampled: Column, keys=("series_id",)) -> DataFrame:
    """Spoil what was not yet published at row t; rows up to t must not change.

    Each sampled row is a variant of its series, so all run as one plan. A variant holds the REACH rows on both sides
    of its own, renumbered from 0: the longest window ends inside, and a look-ahead of that length would show. The
    control uses the plain one-row lag and must change at row t. ``n_perturbed`` counts all of the series' rows that were
    not published, from the number published by each date.
    """
    keys = list(keys)
    w = chunk_window(keys)
    prev = core_rows(add_chunks(numbered, back=1).withColumn("cut", F.lag("obs_date", 1).over(w)))
    cuts = stage(prev.filter(sampled & F.col("cut").isNotNull()).select(*keys, F.col("row_no").alias("t"), "cut"), "cuts")
    base = numbered.withColumn("publication_date", release_monday(F.col("obs_date")))
    # publication dates ascend with the rows, which are numbered from 0
    by_date = base.groupBy(*keys, "publication_date").agg((F.max("row_no") + 1).alias("upto"))
    known = asof_join(cuts, by_date, keys, "cut", "publication_date", ["upto"], tie=("upto",))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    vkeys = [*keys, "t"]
    n_hidden = known.join(sizes, keys).select(*vkeys, (F.col("n") - F.coalesce("upto", F.lit(0))).alias("n_perturbed"))
    first = F.greatest(F.col("t") - REACH, F.lit(0))
    near = cuts.withColumn("row_no", F.explode(F.sequence(first, F.col("t") + REACH)))
    rows = base.join(near, [*keys, "row_no"]).withColumn("row_no", F.col("row_no") - first)
    hidden = F.col("publication_date") > F.col("cut")
    spoiled = rows.withColumns({x: F.when(hidden, F.col(x) * 3.0 + 50.0).otherwise(F.col(x)) for x in ft.INDEXES})

    def compare(build):
        a, b = build(rows), build(spoiled)
        x = a.filter(F.col("row_no") <= F.col("t") - first).select(*vkeys, "row_no", F.struct(*INDEX_COLUMNS).alias("_a"))
        y = b.select(*vkeys, "row_no", F.struct(*INDEX_COLUMNS).alias("_b"))
        j = x.join(y, [*vkeys, "row_no"])
        changed = ~F.col("_a").eqNullSafe(F.col("_b"))
        return j.groupBy(*vkeys).agg(F.count_if(changed).alias("n"), F.max(
            (changed & (F.col("row_no") == F.col("t") - first)).cast("int")).alias("at_t"))

    pub = compare(lambda d: features_as_published(d, "publication_date", vkeys))
    lag = compare(lambda d: ft.build_features(d, vkeys))
    return (n_hidden.join(pub.select(*vkeys, F.col("n").alias("n_changed_published")), vkeys)
            .join(lag.select(*vkeys, F.col("at_t").alias("control_changed")), vkeys))


def subsample_ranking(metrics: DataFrame, samples: dict[str, tuple[int, int]], keys=("series_id", "horizon")) -> DataFrame:
    """Fold-mean RMSE and MAE with ranks on several year ranges, and rank change against the first."""
    keys = list(keys)
    rows = metrics.filter("include_in_main").select(*keys, "model", "test_year", "rmse", "mae", F.explode(F.array_compact(F.array(*[
        F.when(F.col("test_year").between(a, b), F.lit(name)) for name, (a, b) in samples.items()]))).alias("sample"))
    agg = rows.groupBy(*keys, "model", "sample").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    w = Window.partitionBy(*keys, "sample")
    agg = agg.withColumns({"rank_rmse": F.rank().over(w.orderBy("rmse")), "rank_mae": F.rank().over(w.orderBy("mae"))})
    first = next(iter(samples))
    base = agg.filter(F.col("sample") == first).select(*keys, "model", F.col("rank_rmse").alias("_r"))
    return agg.join(base, [*keys, "model"], "left").withColumn("rank_change", F.col("rank_rmse") - F.col("_r")).drop("_r")


def ranking_stability(ranked: DataFrame, first: str, keys=("series_id", "horizon")) -> DataFrame:
    """Spearman of each sample's ranks with the first sample's, models that moved, spread of the top five."""
    keys = list(keys)
    base = ranked.filter(F.col("sample") == first).select(*keys, "model", F.col("rmse").alias("_b"))
    j = ranked.join(base, [*keys, "model"])
    g = [*keys, "sample"]
    j = j.withColumns({"_x": average_rank("rmse", g), "_y": average_rank("_b", g)})
    return j.groupBy(*g).agg(
        F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("spearman"),
        F.count_if(F.col("rank_change") != 0).alias("n_moved"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("rmse", "model"))), 1, 3),
                                 lambda s: s["model"]), ",").alias("top3"),
        (100 * (F.try_divide(F.max(F.when(F.col("rank_rmse") <= 5, F.col("rmse"))), F.min("rmse")) - 1)).alias("top5_spread_pct"))


def below_baseline(means: DataFrame, baseline: str, column: str = "rmse_fold_mean", keys=("series_id", "horizon")) -> DataFrame:
    b = means.filter(F.col("model") == baseline).select(*keys, F.col(column).alias("_b"))
    return means.join(b, list(keys)).groupBy(*keys).agg(
        F.count_if((F.col(column) > F.col("_b")) & (F.col("model") != baseline)).alias("n_worse"))


def rescore(preds: DataFrame, targets: DataFrame, keys=("series_id",)) -> DataFrame:
    """Fixed predictions scored on another target: fold metrics of both, side by side."""
    j = preds.filter("include_in_main").join(targets, [*keys, "horizon", "row_no"])
    a, b = F.col("y_true") - F.col("pred"), F.col("y_new") - F.col("pred")
    changed = ~(F.abs(F.col("y_new") - F.col("y_true")) <= 1e-12 * F.abs(F.col("y_true")))
    return j.groupBy(*keys, "model", "horizon", "test_year").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(a * a)).alias("rmse"), F.sqrt(F.avg(b * b)).alias("rmse_new"),
        F.avg(F.abs(a)).alias("mae"), F.avg(F.abs(b)).alias("mae_new"), F.count_if(changed).alias("n_changed"))


def rescore_ranks(rescored: DataFrame, keys=("series_id", "horizon")) -> DataFrame:
    m = rescored.groupBy(*keys, "model").agg(
        F.avg("rmse").alias("rmse"), F.avg("rmse_new").alias("rmse_new"), F.sum("n_changed").alias("n_changed"))
    w = Window.partitionBy(*keys)
    return m.withColumns({"change_pct": 100 * (F.col("rmse_new") / F.col("rmse") - 1),
                          "rank": F.rank().over(w.orderBy("rmse")), "rank_new": F.rank().over(w.orderBy("rmse_new"))})


def regime_years(preds: DataFrame, keys=("series_id", "horizon"), model: str = "har") -> DataFrame:
    """Test years split at the median of their mean realized volatility."""
    y = (preds.filter((F.col("model") == model) & F.col("include_in_main")).groupBy(*keys, "test_year")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("y_true").alias("mean_vol")))
    med = y.groupBy(*keys).agg(F.median("mean_vol").alias("threshold"))
    return y.join(med, list(keys)).withColumn("regime", F.when(F.col("mean_vol") > F.col("threshold"), "high").otherwise("low"))


def regime_split(preds: DataFrame, a: str, b: str, keys=("series_id", "horizon")) -> DataFrame:
    """Per regime: fold-mean and pooled RMSE of two models, wins of b, and the share of a's squared error."""
    keys = list(keys)
    years = regime_years(preds, keys, a)
    sq = F.pow(F.col("y_true") - F.col("pred"), 2)
    f = (preds.filter(F.col("include_in_main") & F.col("model").isin(a, b)).groupBy(*keys, "test_year").agg(
        F.sum(F.when(F.col("model") == a, sq)).alias("sa"), F.sum(F.when(F.col("model") == b, sq)).alias("sb"),
        F.count_if(F.col("model") == a).alias("m")))
    j = f.join(years, [*keys, "test_year"])
    ra, rb = F.sqrt(F.col("sa") / F.col("m")), F.sqrt(F.col("sb") / F.col("m"))
    g = j.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("mean_vol").alias("mean_vol"), F.avg(ra).alias("fold_a"), F.avg(rb).alias("fold_b"),
        F.sqrt(F.sum("sa") / F.sum("m")).alias("pooled_a"), F.sqrt(F.sum("sb") / F.sum("m")).alias("pooled_b"),
        F.count_if(rb < ra).alias("wins_b"), F.sum("sa").alias("_s"))
    share = 100 * F.col("_s") / F.sum("_s").over(Window.partitionBy(*keys))
    return g.withColumn("squared_error_share_pct", share).drop("_s")


def tail_robustness(preds: DataFrame, a: str, b: str, without_year: int, q: float = 0.99,
                    keys=("series_id", "horizon")) -> DataFrame:
    """Largest losses of model a: their share, and b against a inside and outside, with and without one year."""
    keys = list(keys)
    sq = F.pow(F.col("y_true") - F.col("pred"), 2)
    e = (preds.filter(F.col("include_in_main") & F.col("model").isin(a, b)).groupBy(*keys, "test_year", "obs_date").agg(
        F.max(F.when(F.col("model") == a, sq)).alias("ea"), F.max(F.when(F.col("model") == b, sq)).alias("eb")))
    e = e.withColumn("sample", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("test_year") != without_year, F.lit("without_year"))))))
    g = [*keys, "sample"]
    thr = e.groupBy(*g).agg(F.percentile("ea", F.lit(q)).alias("thr"))
    j = e.join(thr, g)
    top = F.col("ea") >= F.col("thr")

    def ratio(cond):
        return 100 * (F.sqrt(F.try_divide(F.avg(F.when(cond, F.col("eb"))), F.avg(F.when(cond, F.col("ea"))))) - 1)

    return j.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(top).alias("n_tail"),
        (100 * F.sum(F.when(top, F.col("ea"))) / F.sum("ea")).alias("tail_share_pct"),
        ratio(top).alias("tail_pct"), ratio(~top).alias("rest_pct"), ratio(F.lit(True)).alias("pooled_pct"))


def year_contribution(preds: DataFrame, a: str, b: str, keys=("series_id", "horizon")) -> DataFrame:
    """Sum of e_a^2 - e_b^2 per year, its share of the total, and the running share from the largest down."""
    keys = list(keys)
    sq = F.pow(F.col("y_true") - F.col("pred"), 2)
    y = (preds.filter(F.col("include_in_main") & F.col("model").isin(a, b)).groupBy(*keys, "test_year").agg(
        F.count_if(F.col("model") == a).alias("n"),
        F.sum(F.when(F.col("model") == a, sq).otherwise(-sq)).alias("contribution")))
    whole = Window.partitionBy(*keys)
    down = whole.orderBy(F.col("contribution").desc(), "test_year").rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum("contribution").over(whole)
    return y.withColumns({"share_pct": 100 * F.try_divide(F.col("contribution"), tot),
                          "cumulative_pct": 100 * F.try_divide(F.sum("contribution").over(down), tot)})


def alignment_comparison(metrics: DataFrame, a: str, b: str, keys=("series_id", "model", "horizon")) -> DataFrame:
    """Two alignment versions of the fold metrics: change in %, fold wins, ties and the sign test."""
    from volpanel.operators.stattests import binomial_two_sided

    keys = list(keys)
    f = (metrics.filter("include_in_main").groupBy(*keys, "test_year").agg(
        *[F.max(F.when(F.col("alignment") == v, F.col(m))).alias(f"{m}_{t}") for t, v in (("a", a), ("b", b)) for m in ("rmse", "mae", "r2_oos")]))
    d = F.col("rmse_a") - F.col("rmse_b")
    g = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), *[F.avg(c).alias(c) for c in ("rmse_a", "rmse_b", "mae_a", "mae_b")],
        (F.avg("r2_oos_b") - F.avg("r2_oos_a")).alias("r2_oos_diff"),
        F.count_if(d > 0).alias("wins_b"), F.count_if(d < 0).alias("wins_a"), F.count_if(d == 0).alias("ties"))
    return g.withColumns({"rmse_pct": 100 * (F.col("rmse_b") / F.col("rmse_a") - 1), "mae_pct": 100 * (F.col("mae_b") / F.col("mae_a") - 1),
                          "p_sign": binomial_two_sided(F.col("wins_b"), F.col("wins_a") + F.col("wins_b"))})


def rmse_ratio_by_year(metrics: DataFrame, reference: str, keys=("series_id", "horizon")) -> DataFrame:
    r = metrics.filter(F.col("model") == reference).select(*keys, "test_year", F.col("rmse").alias("_r"))
    return metrics.join(r, [*keys, "test_year"]).withColumn("ratio", F.try_divide(F.col("rmse"), F.col("_r"))).drop("_r")
