"""Boosted-tree forecasts: rows and labels of each kind, and what the node tables of :mod:`boosting` give."""

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import boosting, folds
from volpanel.operators.boosting import KEYS, tier_params  # noqa: F401 - part of this module's interface
from volpanel.operators.features import FEATURES
from volpanel.operators.models import back_transform, fit_target
from volpanel.operators.search import selection_signal  # noqa: F401 - part of this module's interface
from volpanel.sources.stage import stage


def usable(features, mode: str) -> Column:
    """Rows a mode can learn from: logs need a positive target, ratios positive past volatility too."""
    ok = folds.complete(features) & F.col("y").isNotNull()
    if mode != "level":
        ok = ok & (F.col("y") > 0)
    return ok & F.col("past_vol").isNotNull() & (F.col("past_vol") > 0) if mode == "ratio" else ok


def tree_rows(rows: DataFrame, features, mode: str = "ratio", keys=KEYS) -> DataFrame:
    """Stored rows with packed features; ``rows`` is long (one row per horizon) with ``y``, ``past_vol``, ``fit_from``."""
    label = F.col("y") if mode == "level" else fit_target(mode)
    return boosting.stored(rows.filter(usable(features, mode)), features, F.array(label), keys=keys)


def full_rows(features: DataFrame, frame: DataFrame, horizons) -> DataFrame:
    """The 65 features next to targets, one row per horizon."""
    t = frame.select("series_id", "row_no", *[f"{c}_{h}" for h in horizons for c in ("target_vol", "past_vol", "fit_from")])
    return folds.by_horizon(features.join(t, ["series_id", "row_no"]), horizons,
                            ["series_id", "obs_date", "year", "row_no", *dict.fromkeys([*FEATURES, "har_daily"])])


def gbt_by_fold(rows: DataFrame, nodes: DataFrame, test_years, partial_year, mode: str = "ratio", name: str = "gbt",
                keys=KEYS, smearings: DataFrame | None = None) -> DataFrame:
    """Predictions of the test rows.

    Modes ``ratio`` and ``log`` return through exp and the smearing of the training residuals; ``level`` is held at
    the training floor. ``smearings`` (keys, test_year, smearing) replace those of the training residuals; folds
    without one keep theirs, shrunk by the effective training size.
    """
    scored = stage(boosting.score(rows, nodes, test_years, keys), "tree_scores")
    back = boosting.smearing(scored, rows, keys)
    if smearings is not None:
        own = smearings.select(*keys, "test_year", F.col("smearing").alias("_s"))
        shrunk = folds.shrink_smearing(F.col("smearing"), F.col("n_train") / F.col("horizon"))
        back = back.join(own, [*keys, "test_year"], "left").withColumn("smearing", F.coalesce("_s", shrunk)).drop("_s")
    out = (scored.filter("not in_train").drop("label", "in_train")
           .join(rows.select(*keys, "row_no", "obs_date", "y", "past_vol"), [*keys, "row_no"]).join(back, [*keys, "test_year"]))
    pred = F.greatest("raw", "floor") if mode == "level" else back_transform(F.col("raw"), F.col("smearing"), mode)
    n_eff = folds.effective_n("n_train")
    return out.select(*keys, F.lit(name).alias("model"), folds.fold_number(test_years).alias("fold"), "test_year", "obs_date", "row_no",
                      folds.include_in_main(partial_year).alias("include_in_main"), F.col("y").alias("y_true"), pred.alias("pred"), "raw",
                      "past_vol", "train_mean", "floor", "n_train", "smearing", folds.capacity_tier(n_eff).alias("tier"))


def residual_rows(rows: DataFrame, coefs: DataFrame, regressors, features, test_years, variant: str = "har_x") -> DataFrame:
    """Stored rows whose labels are, fold by fold, the errors of the linear base forecast held at its floor (``bases``)."""
    fit = F.struct("intercept", "beta", F.col("y_min").alias("floor"))
    c = coefs.filter(F.col("variant") == variant).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("test_year", fit))).alias("fits"))
    rows = rows.filter(usable([*features, *regressors], "level")).join(c, list(KEYS))

    def base(year):
        f = F.col("fits")[F.lit(int(year))]
        value = f["intercept"]
        for i, x in enumerate(regressors):
            value = value + f["beta"][i] * F.col(x)
        return F.greatest(value, f["floor"])

    rows = rows.withColumn("bases", F.array(*[base(y) for y in test_years]))
    return boosting.stored(rows, features, F.transform("bases", lambda b: F.col("y") - b), "bases")


def residual_chain(rows: DataFrame, nodes: DataFrame, test_years) -> DataFrame:
    """Training and test rows of every fold: base forecast, its error ``label``, the trees' forecast ``raw`` of that error."""
    years = F.array(*[F.lit(int(y)) for y in test_years])
    scored = boosting.score(rows, nodes, test_years).join(rows.select(*KEYS, "row_no", "obs_date", "y", "bases"), [*KEYS, "row_no"])
    return stage(scored.withColumn("base", F.col("bases")[F.array_position(years, F.col("test_year")).cast("int") - 1]).drop("bases"), "residual_chain")


def residual_hybrid(chain: DataFrame, test_years, partial_year, floors: DataFrame | None = None) -> DataFrame:
    """Base forecast plus the trees' forecast of its error, held at the training floor, or that of ``floors`` (keys, test_year, floor)."""
    train = chain.filter("in_train").groupBy(*KEYS, "test_year").agg(F.min("y").alias("floor"), F.avg("y").alias("train_mean"))
    if floors is not None:
        train = train.drop("floor").join(floors, [*KEYS, "test_year"])
    out = chain.filter("not in_train").join(train, [*KEYS, "test_year"])
    return out.select("series_id", F.lit("har_x_residual").alias("model"), "horizon", folds.fold_number(test_years).alias("fold"), "test_year", "obs_date",
                      "row_no", folds.include_in_main(partial_year).alias("include_in_main"), F.col("y").alias("y_true"),
                      F.greatest(F.col("base") + F.col("raw"), F.col("floor")).alias("pred"), "base", F.col("raw").alias("residual_forecast"),
                      "train_mean", "floor")


def chain_r2(chain: DataFrame) -> DataFrame:
    """1 - sum (e - e_hat)^2 / sum e^2 of the second stage per fold, in and out of sample."""
    def r2(inside):
        own = F.col("in_train") if inside else ~F.col("in_train")
        return 1 - F.try_divide(F.sum(F.when(own, F.pow(F.col("label") - F.col("raw"), 2))), F.sum(F.when(own, F.pow("label", F.lit(2)))))

    return chain.groupBy(*KEYS, "test_year").agg(r2(True).alias("r2_in"), r2(False).alias("r2_out"))


def chain_summary(r2: DataFrame, keys=KEYS) -> DataFrame:
    """Over folds: mean, median, folds above zero, least and greatest of both."""
    both = r2.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("sample"), F.col(c).alias("r2")) for n, c in (("in", "r2_in"), ("out", "r2_out"))])))
    return both.groupBy(*keys, "sample").agg(
        F.count("r2").alias("n_folds"), F.avg("r2").alias("mean"), F.median("r2").alias("median"),
        F.count_if(F.col("r2") > 0).alias("n_positive"), F.min("r2").alias("least"), F.max("r2").alias("greatest"))


def candidates(tier: str, n: int, seed: int = 42) -> list[dict]:
    """Seeded random parameter sets inside the tier's declared bounds; ``share``: drawn rows in thousandths."""
    rng, b = random.Random(f"{seed}-{tier}"), C.SEARCH_BOUNDS[tier]

    def log_between(lo, hi):
        return lo * (hi / lo) ** rng.random()

    return [{"trees": rng.randint(*b["trees"]), "depth": rng.randint(*b["depth"]), "step": log_between(*b["step"]),
             "min_rows": round(log_between(*b["min_rows"])), "share": round(1000 * rng.uniform(*b["subsample"]))} for _ in range(n)]


def validated_search(rows: DataFrame, spans: DataFrame, test_years, partial_year, n_candidates: int, mode: str = "ratio",
                     name: str = "gbt_searched") -> tuple[DataFrame, DataFrame]:
    """(predictions, trials): candidates scored on an embargoed validation slice by halving rounds, the best one refitted on
    the whole training set with its smearing; folds with too little data keep their tier's parameters."""
    trials = stage(boosting.search_trials(rows, spans, test_years, lambda tier: candidates(tier, n_candidates), mode), "tree_trials")
    picks = stage(boosting.chosen(trials), "tree_picks")
    nodes = stage(boosting.refit(rows, picks, test_years), "tree_nodes")
    return gbt_by_fold(rows, nodes, test_years, partial_year, mode, name, smearings=None if mode == "level" else picks), trials
