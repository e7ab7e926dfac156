"""Boosted trees at their tiers' sizes on all horizons, what follows from them, and the validated search.

Statements of the six-regressor jobs grow the same trees in SQL and check every forecast. Over 65 features that would
take hours there; those statements check rows, tiers, training sizes, floors, base forecasts, and that the parts add up.
"""

from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import fixtures as fx
from volpanel.catalog import forecast_sql as fs
from volpanel.catalog import window_queries as wq
from volpanel.catalog.forecast_queries import H, coefs, frame, level, pred_out, rows
from volpanel.catalog.forest_sql import K, forest, forest_parts
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.operators import attribution, boosting, folds, losses, search, trees
from volpanel.operators.features import FEATURES
from volpanel.operators.models import back_transform
from volpanel.plans import walkforward as wf
from volpanel.sources.stage import stage

YEARS, PARTIAL = fx.TEST_YEARS, fx.PARTIAL_YEAR


def full(spark, sf_dir):
    return trees.full_rows(wq.features(spark, sf_dir), frame(spark, sf_dir), H)


def tables(spark, sf_dir, name):
    """(rows, node table) of a job, written on first use."""
    kept = fx.remember(spark, sf_dir, f"{name}_rows", lambda: {
        "ratio": lambda: trees.tree_rows(full(spark, sf_dir), FEATURES),
        "level": lambda: trees.tree_rows(rows(spark, sf_dir), wf.XS, "level"),
        "residual": lambda: trees.residual_rows(full(spark, sf_dir), coefs(spark, sf_dir), wf.XS, FEATURES, YEARS),
        "residual_level": lambda: trees.residual_rows(rows(spark, sf_dir), coefs(spark, sf_dir), wf.XS, wf.XS, YEARS)}[name]())
    return kept, fx.remember(spark, sf_dir, f"{name}_nodes", lambda: boosting.fit_nodes(kept, YEARS))


def chain(spark, sf_dir, name):
    return fx.remember(spark, sf_dir, f"{name}_chain", lambda: trees.residual_chain(*tables(spark, sf_dir, name), YEARS))


# all 65 features are there from row 127 on: the longest window meets 126 returns before the row
part("tree_train", "SELECT * FROM train WHERE row_no >= 127 AND y > 0 AND past_vol > 0", "train")
part("tree_test", "SELECT * FROM test WHERE row_no >= 127 AND y > 0 AND past_vol > 0", "test")


def _stats(name: str, source: str) -> None:
    part(name, f"""SELECT *, CASE WHEN e >= 100 THEN 'high' WHEN e >= 30 THEN 'mid' ELSE 'low' END AS tier FROM (
SELECT series_id, horizon, test_year, count(*) AS n_train, min(y) AS floor, avg(y) AS train_mean, count(*) / any_value(horizon) AS e FROM {source} GROUP BY ALL)""", source)


_stats("tree_stats", "tree_train")
_stats("six_stats", "train")
_COLUMNS = ["series_id", "model", "horizon", "fold", "test_year", "obs_date", "include_in_main", "y_true", "n_train", "floor", "train_mean", "tier"]


def _sql(model: str, test: str, stats: str, last: str) -> str:
    return f"""SELECT t.series_id, '{model}' AS model, t.horizon, CAST(t.test_year - 1997 AS INT) AS fold, t.test_year, CAST(t.obs_date AS VARCHAR) AS obs_date,
t.include_in_main, {rd('t.y', 7)} AS y_true, s.n_train, {rd('s.floor', 7)} AS floor, {rd('s.train_mean', 7)} AS train_mean, s.tier, {last}
FROM {test} t JOIN {stats} s ON {fs.on('t', 's')}"""


def _sound(cond):
    return F.coalesce((folds.finite("pred") & cond).cast("int"), F.lit(0)).alias("sound")


def _near(a, b):
    return F.abs(a - b) <= 1e-12 + 1e-9 * F.abs(b)


@query("gbt_by_fold", with_parts(_sql("gbt", "tree_test", "tree_stats", "1 AS sound"), "tree_test", "tree_stats"))
def gbt_by_fold(spark, sf_dir):
    p = trees.gbt_by_fold(*tables(spark, sf_dir, "ratio"), YEARS, PARTIAL)
    back = back_transform(F.col("raw"), F.col("smearing"), "ratio")
    return rounded(p.select(*_COLUMNS, _sound((F.col("pred") > 0) & (F.col("smearing") > 0) & _near(F.col("pred"), back))), 7)


forest_parts("six", "train", "test", wf.XS)
_DONE = f"SELECT {K}, row_no, tr, b.y AS label, (b.y - r) / 1e9 AS raw, r / 1e9 AS left_over FROM rec JOIN fr_{{0}} b USING (rid) JOIN fk_{{0}} k USING (cell)"


@query("gbt_levels", forest("six", len(wf.XS), f"WITH done AS ({_DONE.format('six')}) " + _sql("gbt6", "test", "six_stats", f"{rd('greatest(d.raw, s.floor)', 9)} AS pred")
       + f" JOIN done d ON {fs.on('t', 'd')} AND d.row_no = t.row_no AND NOT d.tr", "test", "six_stats"))
def gbt_levels(spark, sf_dir):
    """The same learner on the six linear regressors, levels, held at the floor; its rows are those of HAR-X."""
    p = trees.gbt_by_fold(*tables(spark, sf_dir, "level"), YEARS, PARTIAL, "level", "gbt6")
    return rounded(p.select(*_COLUMNS, "pred"), 7, pred=9)


part("tree_level_stats", "SELECT series_id, horizon, test_year, avg(y) AS train_mean FROM train WHERE row_no >= 127 GROUP BY ALL", "train")


# --- the second stage on a regression's errors -------------------------------
@query("residual_hybrid", with_parts(f"""SELECT p.series_id, 'har_x_residual' AS model, p.horizon, p.fold, p.test_year, CAST(p.obs_date AS VARCHAR) AS obs_date,
p.include_in_main, {rd('p.y_true', 7)} AS y_true, {rd('p.pred', 6)} AS base, {rd('p.floor', 7)} AS floor, {rd('s.train_mean', 7)} AS train_mean, 1 AS sound
FROM p_har_x p JOIN tree_level_stats s ON {fs.on('p', 's')} WHERE p.row_no >= 127""", "p_har_x", "tree_level_stats"))
def residual_hybrid(spark, sf_dir):
    """The base must be the stand-alone HAR-X forecast of the same row."""
    c = coefs(spark, sf_dir).filter("variant = 'har_x'").select("series_id", "horizon", "test_year", F.col("y_min").alias("floor"))
    p = trees.residual_hybrid(chain(spark, sf_dir, "residual"), YEARS, PARTIAL, c)
    made = F.greatest(F.col("base") + F.col("residual_forecast"), F.col("floor"))
    return rounded(p.select(*[c for c in _COLUMNS if c not in ("n_train", "tier")], "base", _sound(F.col("pred") == made)), 7, base=6)


for _s in ("train", "test"):
    part(f"{_s}_base", f"SELECT t.*, greatest({fs.predictor(wf.XS)}, s.floor) AS base, s.floor FROM {_s} t JOIN fit_har_x f ON {fs.on('t', 'f')} JOIN six_stats s ON {fs.on('t', 's')}",
         _s, "fit_har_x", "six_stats")
forest_parts("hyb", "train_base", "test_base", wf.XS, "(y - base)")


@query("hybrid_levels", forest("hyb", len(wf.XS), f"""WITH done AS ({_DONE.format('hyb')}) SELECT t.series_id, t.horizon, t.test_year, CAST(t.obs_date AS VARCHAR) AS obs_date,
{rd('t.y', 7)} AS y_true, {rd('t.base', 6)} AS base, {rd('greatest(t.base + d.raw, t.floor)', 6)} AS pred FROM test_base t JOIN done d ON {fs.on('t', 'd')} AND d.row_no = t.row_no AND NOT d.tr""", "test_base"))
def hybrid_levels(spark, sf_dir):
    """Trees of the six regressors on the errors of the regression that has them."""
    p = trees.residual_hybrid(chain(spark, sf_dir, "residual_level"), YEARS, PARTIAL)
    return rounded(p.select("series_id", "horizon", "test_year", "obs_date", "y_true", "base", "pred"), 7, base=6, pred=6)


_R2 = f"""SELECT {K}, 1 - sum(left_over ** 2) FILTER (WHERE tr) / sum((label / 1e9) ** 2) FILTER (WHERE tr) AS r2_in,
1 - sum(left_over ** 2) FILTER (WHERE NOT tr) / sum((label / 1e9) ** 2) FILTER (WHERE NOT tr) AS r2_out FROM done GROUP BY ALL"""


@query("residual_chain_r2", forest("hyb", len(wf.XS), f"WITH done AS ({_DONE.format('hyb')}) SELECT {K}, {rd('r2_in', 5)} AS r2_in, {rd('r2_out', 5)} AS r2_out FROM ({_R2})"))
def residual_chain_r2(spark, sf_dir):
    """What the second stage explains of the first one's errors, in and out of sample."""
    return rounded(trees.chain_r2(chain(spark, sf_dir, "residual_level")), 5)


@query("residual_chain_summary", forest("hyb", len(wf.XS), f"""WITH done AS ({_DONE.format('hyb')}), r AS ({_R2}) SELECT series_id, horizon, s.sample, count(s.r2) AS n_folds, {rd('avg(s.r2)', 5)} AS mean,
{rd('median(s.r2)', 5)} AS median, count(*) FILTER (WHERE s.r2 > 0) AS n_positive, {rd('min(s.r2)', 5)} AS least, {rd('max(s.r2)', 5)} AS greatest
FROM (SELECT series_id, horizon, unnest([struct_pack(sample := 'in', r2 := r2_in), struct_pack(sample := 'out', r2 := r2_out)]) AS s FROM r) GROUP BY ALL"""))
def residual_chain_summary(spark, sf_dir):
    return rounded(trees.chain_summary(trees.chain_r2(chain(spark, sf_dir, "residual_level"))), 5)


@query("full_chain_summary")
def full_chain_summary(spark, sf_dir):
    """The same summary for the second stage on all 65 features."""
    return rounded(trees.chain_summary(trees.chain_r2(chain(spark, sf_dir, "residual"))), 5)


# --- loss histories ------------------------------------------------------------
def history(spark, sf_dir):
    return fx.remember(spark, sf_dir, "level_losses", lambda: boosting.loss_history(*tables(spark, sf_dir, "level"), YEARS))


_AT = "max(loss) FILTER (WHERE epoch = {})"
_CONV = f"""WITH hist AS (SELECT {K}, t AS epoch, loss, max(t) OVER (PARTITION BY cell) + 1 AS n FROM (SELECT -rid // 1000 AS cell, t, loss FROM rec WHERE rid < 0) JOIN fk_six USING (cell)),
conv AS (SELECT *, 100 * (p80 - fin) / p80 AS drop_pct, CASE WHEN 100 * (p80 - fin) / p80 < 2 THEN 'converged' WHEN 100 * (p80 - fin) / p80 < 10 THEN 'converging' ELSE 'under_trained' END AS convergence
FROM (SELECT {K}, {_AT.format('0')} AS st, {_AT.format('n // 2')} AS mid, {_AT.format('greatest(1, round_even(n * 0.8, 0)::INT - 1)')} AS p80, {_AT.format('n - 1')} AS fin FROM hist GROUP BY ALL)) """


@query("convergence_label", forest("six", len(wf.XS), _CONV + f"""SELECT {K}, {rd('st', 8)} AS loss_start, {rd('mid', 8)} AS loss_mid, {rd('p80', 8)} AS loss_p80, {rd('fin', 8)} AS loss_final,
{rd('drop_pct', 4)} AS tail_drop_pct, convergence, {rd('fin / st', 6)} AS loss_ratio FROM conv"""))
def convergence_label(spark, sf_dir):
    """Training losses of the level trees, tree by tree."""
    return rounded(losses.convergence_label(history(spark, sf_dir), ("series_id", "horizon", "test_year")).drop("n_epochs"), 8, tail_drop_pct=4, loss_ratio=6)


@query("convergence_crosstab", forest("six", len(wf.XS), _CONV + "SELECT horizon, " + ", ".join(
    f"count(*) FILTER (WHERE convergence = '{k}') AS {k}" for k in ("converged", "converging", "under_trained", "undefined")) + " FROM conv GROUP BY ALL"))
def convergence_crosstab(spark, sf_dir):
    return losses.convergence_crosstab(losses.convergence_label(history(spark, sf_dir), ("series_id", "horizon", "test_year")))


# --- attributions ----------------------------------------------------------------
_FEATURES = "(SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature) f"


@query("occlusion_attribution", with_parts("SELECT DISTINCT t.series_id, t.horizon, t.test_year, f.feature, 1 AS sound FROM tree_test t JOIN tree_stats s ON "
       + fs.on("t", "s") + f", {_FEATURES}", "tree_test", "tree_stats"))
def occlusion_attribution(spark, sf_dir):
    o = boosting.occlusion(*tables(spark, sf_dir, "ratio"), FEATURES, YEARS).withColumn("pred", F.col("mean_abs"))
    return o.select("series_id", "horizon", "test_year", "feature", _sound(F.col("mean_abs") >= 0))


def attributions(spark, sf_dir):
    return fx.remember(spark, sf_dir, "tree_attributions", lambda: boosting.attributions(*tables(spark, sf_dir, "ratio"), FEATURES, YEARS))


def importance(spark, sf_dir):
    return fx.remember(spark, sf_dir, "tree_importance", lambda: attribution.feature_importance(attributions(spark, sf_dir)))


@query("tree_attribution", with_parts("SELECT t.series_id, t.horizon, t.test_year, count(*) AS n_rows, count(*) AS n_sum_up FROM tree_test t JOIN tree_stats s ON " + fs.on("t", "s")
       + " GROUP BY ALL", "tree_test", "tree_stats"))
def tree_attribution(spark, sf_dir):
    """Contributions along the paths: with the common part they add up to the forecast of each row."""
    a = attributions(spark, sf_dir).groupBy("series_id", "horizon", "test_year", "row_no").agg(
        F.first("raw").alias("raw"), (F.first("common") + F.sum("attribution")).alias("total"))
    return a.groupBy("series_id", "horizon", "test_year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("raw") - F.col("total")) < 1e-9).alias("n_sum_up"))


@query("tree_importance_shares")
def tree_importance_shares(spark, sf_dir):
    return rounded(attribution.importance_shares(importance(spark, sf_dir)), 6)


@query("tree_rank_stability")
def tree_rank_stability(spark, sf_dir):
    sizes = tables(spark, sf_dir, "ratio")[1].filter("tree = -1").select("series_id", "horizon", "test_year", F.col("n_rows").alias("n_train"))
    return rounded(attribution.rank_stability_pairs(importance(spark, sf_dir), sizes), 6)


# --- roll-over variants ------------------------------------------------------------
def tree_variants(spark, sf_dir):
    from volpanel.catalog.robust_queries import variant_rows

    keys = ("series_id", "roll_variant", "horizon")

    def build():
        kept = trees.tree_rows(variant_rows(spark, sf_dir), wf.XS, "level", keys)
        nodes = stage(boosting.fit_nodes(kept, YEARS, keys), "variant_nodes")
        return trees.gbt_by_fold(kept, nodes, YEARS, PARTIAL, "level", "gbt6", keys)
    return fx.remember(spark, sf_dir, "tree_variants", build)


@query("rollover_tree_variants")
def rollover_tree_variants(spark, sf_dir):
    """The tree model on the baseline, A, A2 and B: fold errors next to those of the regressions."""
    from volpanel.operators import metrics

    m = metrics.fold_metrics(tree_variants(spark, sf_dir), ("roll_variant", *metrics.FOLD))
    return rounded(m.select("roll_variant", "series_id", "model", "horizon", "test_year", "n", "rmse", "mae"), 7)


@query("tree_family_tests_by_variant")
def tree_family_tests_by_variant(spark, sf_dir):
    """DM, sign test and corrections of HAR-X against the trees inside each variant."""
    from volpanel.catalog.robust_queries import variant_predictions
    from volpanel.operators import stattests

    keys = ("series_id", "roll_variant", "horizon", "pair")
    linear = variant_predictions(spark, sf_dir).filter("model = 'har_x'")
    own = tree_variants(spark, sf_dir)
    both = [c for c in linear.columns if c in own.columns]
    d = stattests.loss_diff(linear.select(*both).unionByName(own.select(*both)), [("har_x", "gbt6")], ("series_id", "roll_variant", "horizon"))
    t = stattests.diebold_mariano(d, keys).join(stattests.sign_test(d, keys=keys), list(keys))
    t = stattests.adjust(t, "p_hln", ["series_id", "roll_variant"])
    return rounded(t.select(*keys, "n", "dm_hln", "p_hln", "wins", "n_folds", "p_sign", "p_hln_holm", "p_hln_bh", "p_hln_by"), 6, dm_hln=5)


# --- search ------------------------------------------------------------------
CANDIDATES = 6


def tree_trials(spark, sf_dir):
    def build():
        r = rows(spark, sf_dir)
        kept = fx.remember(spark, sf_dir, "level_rows", lambda: trees.tree_rows(r, wf.XS, "level"))
        return boosting.search_trials(kept, folds.validation_span(r, YEARS), YEARS, lambda tier: trees.candidates(tier, CANDIDATES), "level")
    return fx.remember(spark, sf_dir, "tree_trials", build)


@query("tree_search_trials")
def tree_search_trials(spark, sf_dir):
    return rounded(tree_trials(spark, sf_dir), 7)


@query("tree_searched", with_parts(_sql("gbt6_searched", "test", "six_stats", "1 AS sound"), "test", "six_stats"))
def tree_searched(spark, sf_dir):
    """The chosen candidate of each fold, refitted on its whole training set."""
    kept = fx.remember(spark, sf_dir, "level_rows", lambda: trees.tree_rows(rows(spark, sf_dir), wf.XS, "level"))
    picks = stage(boosting.chosen(tree_trials(spark, sf_dir)), "tree_picks")
    nodes = fx.remember(spark, sf_dir, "searched_nodes", lambda: boosting.refit(kept, picks, YEARS))
    p = trees.gbt_by_fold(kept, nodes, YEARS, PARTIAL, "level", "gbt6_searched")
    return rounded(p.select(*_COLUMNS, _sound(F.col("pred") == F.greatest("raw", "floor"))), 7)


@query("tree_selection_signal")
def tree_selection_signal(spark, sf_dir):
    last = tree_trials(spark, sf_dir).filter("round = 2")
    return rounded(search.selection_signal(last, ["series_id"]), 7, signal_pct=4)


part("val_span", """SELECT series_id, horizon, test_year, test_year - coalesce(min(k) FILTER (WHERE n >= 3 * horizon), max(k)) AS first_val FROM (
SELECT l.series_id, l.horizon, f.test_year, k.k, count(*) AS n FROM long l JOIN folds f ON l.series_id = f.series_id AND l.year < f.test_year
AND l.row_no + l.horizon < f.first_test JOIN range(1, 7) k(k) ON l.year >= f.test_year - k.k GROUP BY ALL) GROUP BY series_id, horizon, test_year""", "long", "folds")
part("val_rows", "SELECT t.* FROM train t JOIN val_span s ON " + fs.on("t", "s") + " AND t.year >= s.first_val", "train", "val_span")
part("proper", """SELECT t.* FROM train t JOIN (SELECT s.*, (SELECT min(row_no) FROM num n WHERE n.series_id = s.series_id AND n.year >= s.first_val) AS first_row
FROM val_span s) s ON """ + fs.on("t", "s") + " AND t.row_no + t.horizon < s.first_row", "train", "val_span", "num")
for _v, _xs in C.HAR_VARIANTS.items():
    fs.ols_parts(f"{_v}_proper", list(_xs), "proper")
part("proper_floor", "SELECT series_id, horizon, test_year, count(*) AS n_train, min(y) AS floor FROM proper GROUP BY ALL HAVING count(*) >= 200", "proper")
part("trials", " UNION ALL ".join(f"""SELECT t.series_id, t.horizon, t.test_year, '{v}' AS trial, s.n_train, count(*) AS n_val,
sqrt(avg((t.y - greatest({fs.predictor(xs)}, s.floor)) ** 2)) AS val_rmse FROM val_rows t JOIN fit_{v}_proper f ON {fs.on('t', 'f')}
JOIN proper_floor s ON {fs.on('t', 's')} GROUP BY ALL""" for v, xs in C.HAR_VARIANTS.items()),
     "val_rows", "proper_floor", *[f"fit_{v}_proper" for v in C.HAR_VARIANTS])


def trials(spark, sf_dir):
    def build():
        r = rows(spark, sf_dir)
        return search.linear_trials(r, folds.validation_span(r, YEARS), wf.XS, C.HAR_VARIANTS, YEARS)
    return fx.remember(spark, sf_dir, "linear_trials", build)


@query("search_trials", with_parts(f"SELECT series_id, horizon, test_year, trial, n_train, n_val, {rd('val_rmse', 7)} AS val_rmse FROM trials", "trials"))
def search_trials(spark, sf_dir):
    return rounded(trials(spark, sf_dir), 7)


@query("validated_search", with_parts(f"""SELECT p.series_id, p.model, p.horizon, p.fold, p.test_year, CAST(p.obs_date AS VARCHAR) AS obs_date, p.include_in_main,
{rd('p.y_true', 7)} AS y_true, {rd('p.pred', 7)} AS pred FROM preds p JOIN (SELECT series_id, horizon, test_year, arg_min(trial, val_rmse) AS model FROM trials GROUP BY ALL) b
ON {fs.on('p', 'b')} AND p.model = b.model""", "preds", "trials"))
def validated_search(spark, sf_dir):
    return pred_out(search.searched(level(spark, sf_dir), trials(spark, sf_dir)))


@query("selection_signal", with_parts(f"""SELECT *, CAST(signal_pct < 5 AS INT) AS weak FROM (SELECT series_id, horizon, test_year, count(*) AS n_trials,
{rd('min(val_rmse)', 6)} AS best, {rd('median(val_rmse)', 6)} AS median, {rd('max(val_rmse)', 6)} AS worst, arg_min(trial, val_rmse) AS best_trial,
{rd('100 * (median(val_rmse) - min(val_rmse)) / median(val_rmse)', 4)} AS signal_pct FROM trials GROUP BY ALL)""", "trials"))
def selection_signal(spark, sf_dir):
    return rounded(search.selection_signal(trials(spark, sf_dir), ["series_id"]), 6, signal_pct=4)
