"""Folds, linear forecasts and their metrics."""

from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import fixtures as fx
from volpanel.catalog import forecast_sql as fs  # noqa: F401 - registers the SQL parts
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.operators import folds, linear, metrics
from volpanel.operators.features import FEATURES, LOG_FEATURES
from volpanel.plans import walkforward as wf

H, YEARS, PARTIAL = fx.HORIZONS, fx.TEST_YEARS, fx.PARTIAL_YEAR


def frame(spark, sf_dir):
    return fx.remember(spark, sf_dir, "model_frame", lambda: folds.model_frame(fx.panel(spark, sf_dir), H))


def rows(spark, sf_dir):
    return wf.level_rows(frame(spark, sf_dir), H, ["series_id"])


def level(spark, sf_dir):
    return fx.remember(spark, sf_dir, "level_predictions", lambda: wf.level_predictions(
        frame(spark, sf_dir), H, YEARS, PARTIAL))


def logs(spark, sf_dir):
    return fx.remember(spark, sf_dir, "log_predictions", lambda: wf.log_predictions(
        frame(spark, sf_dir), H, YEARS, PARTIAL))


def fold_table(spark, sf_dir):
    return fx.remember(spark, sf_dir, "fold_metrics", lambda: metrics.fold_metrics(level(spark, sf_dir)))


def coefs(spark, sf_dir):
    return fx.remember(spark, sf_dir, "coefficients", lambda: wf.coefficients(
        rows(spark, sf_dir), C.HAR_VARIANTS, YEARS, ["series_id"]))


PRED_SQL = ("SELECT series_id, model, horizon, fold, test_year, CAST(obs_date AS VARCHAR) AS obs_date, include_in_main, "
            + rd("y_true", 7) + " AS y_true, " + rd("pred", 7) + " AS pred FROM {}")


def pred_out(df):
    return rounded(df.select("series_id", "model", "horizon", "fold", "test_year", "obs_date", "include_in_main",
                             "y_true", "pred"), 7)


for _name, _models in (("train_mean_forecast", ["train_mean"]), ("past_vol_forecast", ["past_vol"]),
                       ("har_forecast", ["har"]),
                       ("har_variants", ["har", "har_implied", "har_index", "har_x"])):
    def _run(spark, sf_dir, models=tuple(_models)):
        return pred_out(level(spark, sf_dir).filter(F.col("model").isin(list(models))))
    _in = ", ".join(f"'{m}'" for m in _models)
    query(_name, with_parts(PRED_SQL.format("preds") + f" WHERE model IN ({_in})", "preds"))(_run)


@query("log_har_variants", with_parts(PRED_SQL.format("preds_log"), "preds_log"))
def log_har_variants(spark, sf_dir):
    return pred_out(logs(spark, sf_dir))


@query("stacked_predictions", with_parts("SELECT * FROM (" + PRED_SQL.format("preds") + " UNION ALL "
                                         + PRED_SQL.format("preds_log") + ")", "preds", "preds_log"))
def stacked_predictions(spark, sf_dir):
    return pred_out(level(spark, sf_dir).unionByName(logs(spark, sf_dir)))


@query("ols_by_group", with_parts(" UNION ALL ".join(
    f"SELECT series_id, horizon, '{v}' AS variant, test_year, n, '{x}' AS regressor, {rd(f'z_{x}', 6)} AS std_beta FROM fit_{v}"
    for v, xs in C.HAR_VARIANTS.items() for x in xs), *[f"fit_{v}" for v in C.HAR_VARIANTS]))
def ols_by_group(spark, sf_dir):
    out = linear.standardized_betas(coefs(spark, sf_dir), wf.XS, C.HAR_VARIANTS)
    return rounded(out.select("series_id", "horizon", "variant", "test_year", F.col("n").cast("long").alias("n"),
                              "regressor", "std_beta"), 6)


@query("fold_metrics", with_parts(
    "SELECT series_id, model, horizon, fold, test_year, include_in_main, n, " + ", ".join(
        f"{rd(c, d)} AS {c}" for c, d in (("rmse", 7), ("mae", 7), ("r2_oos", 6), ("r2", 6), ("sst_own", 6))) + " FROM fm", "fm"))
def fold_metrics(spark, sf_dir):
    return rounded(fold_table(spark, sf_dir), 7, r2_oos=6, r2=6, sst_own=6)


MEANS_SQL = "SELECT series_id, model, horizon, n_folds, " + ", ".join(
    f"{rd(c, 6)} AS {c}" for c in ("rmse_fold_mean", "mae_fold_mean", "r2_oos_fold_mean")) + " FROM means"


def means(spark, sf_dir):
    return metrics.fold_mean(fold_table(spark, sf_dir))


@query("fold_mean", with_parts(MEANS_SQL, "means"))
def fold_mean(spark, sf_dir):
    return rounded(means(spark, sf_dir), 6)


@query("walk_forward_comparison", with_parts(MEANS_SQL + " WHERE model IN ('har', 'past_vol', 'train_mean')", "means"))
def walk_forward_comparison(spark, sf_dir):
    """The flagship: observations to fold-mean errors in one plan, no stage of another query used."""
    from volpanel.operators.panel import number_rows
    from volpanel.sources.stage import stage

    obs = stage(fx.observations(spark, sf_dir), "observations")
    f = stage(folds.model_frame(number_rows(obs), H), "model_frame")
    preds = wf.level_predictions(f, H, YEARS, PARTIAL, variants={"har": C.HAR_VARIANTS["har"]})
    return rounded(metrics.fold_mean(metrics.fold_metrics(preds)), 6)


@query("pooled_metrics", with_parts(f"""SELECT series_id, model, horizon, count(*) AS n_pooled,
{rd('sqrt(avg((y_true - pred) ** 2))', 7)} AS rmse_pooled, {rd('avg(abs(y_true - pred))', 7)} AS mae_pooled,
{rd('1 - sum((y_true - pred) ** 2) / (var_pop(y_true) * count(*))', 6)} AS r2_pooled
FROM preds WHERE include_in_main GROUP BY ALL""", "preds"))
def pooled_metrics(spark, sf_dir):
    return rounded(metrics.pooled_metrics(level(spark, sf_dir)), 7, r2_pooled=6)


part("common", """SELECT p.series_id, p.model, p.horizon, p.test_year, p.include_in_main,
sum((p.y_true - p.pred) ** 2) AS sse, sum((p.y_true - r.pred) ** 2) AS sst
FROM preds p JOIN p_train_mean r USING (series_id, horizon, obs_date) GROUP BY ALL""", "preds", "p_train_mean")


@query("common_r2_oos", with_parts(f"SELECT series_id, model, horizon, test_year, include_in_main, {rd('1 - sse / sst', 6)} AS r2_oos_common FROM common", "common"))
def common_r2_oos(spark, sf_dir):
    return rounded(metrics.common_r2_oos(level(spark, sf_dir)).drop("sse", "sst"), 6)


@query("pooled_r2_oos", with_parts(f"""SELECT series_id, model, horizon, {rd('a', 6)} AS r2_oos_common, {rd('b', 6)} AS r2_oos_pooled,
CAST(sign(a) != sign(b) AS INT) AS sign_differs FROM (SELECT series_id, model, horizon, avg(1 - sse / sst) AS a,
1 - sum(sse) / sum(sst) AS b FROM common WHERE include_in_main AND model != 'train_mean' GROUP BY ALL)""", "common"))
def pooled_r2_oos(spark, sf_dir):
    common = metrics.common_r2_oos(level(spark, sf_dir)).filter("model != 'train_mean'")
    return rounded(metrics.pooled_r2_oos(common), 6)


@query("qlike", with_parts(f"""SELECT series_id, model, horizon, {rd('avg(q)', 6)} AS qlike_fold_mean, {rd('sum(q * n) / sum(n)', 6)} AS qlike_pooled
FROM (SELECT series_id, model, horizon, test_year, count(*) AS n, avg((y_true / pred) ** 2 - ln((y_true / pred) ** 2) - 1) AS q
FROM preds WHERE include_in_main AND pred > 0 AND y_true > 0 GROUP BY ALL) GROUP BY ALL""", "preds"))
def qlike(spark, sf_dir):
    return rounded(metrics.qlike_table(level(spark, sf_dir)), 6)


@query("relative_to_reference", with_parts(f"""SELECT m.series_id, m.model, m.horizon, {rd('m.rmse_fold_mean', 6)} AS rmse_fold_mean,
{rd('100 * (m.rmse_fold_mean / r.rmse_fold_mean - 1)', 5)} AS rmse_fold_mean_vs_har_pct
FROM means m JOIN means r ON m.series_id = r.series_id AND m.horizon = r.horizon AND r.model = 'har'""", "means"))
def relative_to_reference(spark, sf_dir):
    out = metrics.relative_to(means(spark, sf_dir), "har", "rmse_fold_mean")
    return rounded(out.select("series_id", "model", "horizon", "rmse_fold_mean", "rmse_fold_mean_vs_har_pct"), 6,
                   rmse_fold_mean_vs_har_pct=5)


@query("decomposition", with_parts("SELECT a.series_id, a.horizon, " + ", ".join(
    f"{rd(f'100 * ({y}.rmse_fold_mean / {x}.rmse_fold_mean - 1)', 5)} AS {n}" for x, y, n in (
        ("a", "b", "pct_har_to_har_implied"), ("b", "c", "pct_har_implied_to_har_x"), ("a", "c", "pct_total")))
    + """ FROM means a JOIN means b USING (series_id, horizon) JOIN means c USING (series_id, horizon)
WHERE a.model = 'har' AND b.model = 'har_implied' AND c.model = 'har_x'""", "means"))
def decomposition(spark, sf_dir):
    return rounded(metrics.decomposition(means(spark, sf_dir), ["har", "har_implied", "har_x"]), 5)


@query("partial_year_footnote", with_parts(
    f"SELECT series_id, model, horizon, test_year, n, {rd('rmse', 7)} AS rmse, {rd('mae', 7)} AS mae FROM fm WHERE NOT include_in_main", "fm"))
def partial_year_footnote(spark, sf_dir):
    out = metrics.partial_year_footnote(fold_table(spark, sf_dir))
    return rounded(out.select("series_id", "model", "horizon", "test_year", "n", "rmse", "mae"), 7)


part("errs", """SELECT series_id, horizon, test_year, obs_date, """ + ", ".join(
    f"max(y_true - pred) FILTER (WHERE model = '{m}') AS e_{m}" for m in fs.LEVEL_MODELS)
    + " FROM preds WHERE include_in_main GROUP BY ALL", "preds")


def errors(spark, sf_dir):
    return metrics.model_errors(level(spark, sf_dir), fs.LEVEL_MODELS)


@query("error_correlation", with_parts(
    f"SELECT series_id, horizon, {rd('corr(e_har, e_past_vol)', 6)} AS error_corr, count(*) AS n FROM errs GROUP BY ALL", "errs"))
def error_correlation(spark, sf_dir):
    return rounded(metrics.error_correlation(errors(spark, sf_dir), "har", "past_vol"), 6)


@query("residual_stage_r2", with_parts(
    f"SELECT series_id, horizon, test_year, {rd('1 - sum(e_har_x ** 2) / sum(e_har ** 2)', 6)} AS resid_r2 FROM errs GROUP BY ALL", "errs"))
def residual_stage_r2(spark, sf_dir):
    return rounded(metrics.residual_stage_r2(errors(spark, sf_dir), "har", "har_x"), 6)


@query("floor_frequency", with_parts(f"""WITH y AS (SELECT series_id, model, horizon, test_year, sum(CAST(pred = floor AS INT)) AS k, count(*) AS m
FROM preds WHERE include_in_main GROUP BY ALL)
SELECT series_id, model, horizon, CAST(sum(k) AS BIGINT) AS n_floored, CAST(sum(m) AS BIGINT) AS n, {rd('100.0 * sum(k) / sum(m)', 6)} AS pct_floored,
arg_max(test_year, k / m * 10000 - test_year / 10000) FILTER (WHERE k > 0) AS densest_year FROM y GROUP BY ALL""", "preds"))
def floor_frequency(spark, sf_dir):
    return rounded(metrics.floor_frequency(level(spark, sf_dir)), 6)


@query("loss_concentration", with_parts(f"""WITH r AS (SELECT *, (y_true / pred) ** 2 - ln((y_true / pred) ** 2) - 1 AS loss FROM preds WHERE include_in_main),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, model, horizon ORDER BY loss DESC, obs_date) AS rn,
count(*) OVER (PARTITION BY series_id, model, horizon) AS n FROM r)
SELECT series_id, model, horizon, n, CAST(greatest(1, floor(n * 0.01)) AS BIGINT) AS k,
{rd('100 * sum(loss) FILTER (WHERE rn <= greatest(1, floor(n * 0.01))) / sum(loss)', 5)} AS top_share_pct,
CAST(max(obs_date) FILTER (WHERE rn = 1) AS VARCHAR) AS top_date, {rd('max(y_true / pred) FILTER (WHERE rn = 1)', 6)} AS top_ratio
FROM k GROUP BY series_id, model, horizon, n""", "preds"))
def loss_concentration(spark, sf_dir):
    return rounded(metrics.loss_concentration(level(spark, sf_dir), metrics.qlike()), 6, top_share_pct=5)


part("smears", " UNION ALL ".join(
    f"SELECT '{m}' AS model, s.*, f.n_train FROM smear_{m} s JOIN fold_stats f USING (series_id, horizon, test_year)"
    for m in fs.LOG_MODELS), *[f"smear_{m}" for m in fs.LOG_MODELS], "fold_stats")


def smear_table(spark, sf_dir):
    def build():
        r = wf.log_rows(rows(spark, sf_dir))
        v = {"har_log": C.HAR_VARIANTS["har"], "har_x_log": C.HAR_VARIANTS["har_x"]}
        c = wf.coefficients(r, v, YEARS, ["series_id"])
        s = wf.smearing(r, c, YEARS, ["series_id"])
        return (s.join(c.select("series_id", "horizon", "variant", "test_year", F.col("n").cast("long").alias("n_train")),
                       ["series_id", "horizon", "variant", "test_year"]).withColumnRenamed("variant", "model"))
    return fx.remember(spark, sf_dir, "smearing", build)


@query("duan_smearing", with_parts(f"""SELECT series_id, model, horizon, test_year, {rd('smearing', 7)} AS smearing, {rd('resid_log_std', 7)} AS resid_log_std,
{rd('1 + (n_train / horizon) / (n_train / horizon + 10.0) * (smearing - 1)', 7)} AS smearing_shrunk FROM smears""", "smears"))
def duan_smearing(spark, sf_dir):
    s = smear_table(spark, sf_dir)
    return rounded(s.select("series_id", "model", "horizon", "test_year", "smearing", "resid_log_std",
                            folds.shrink_smearing(F.col("smearing"), folds.effective_n("n_train")).alias("smearing_shrunk")), 7)


@query("smearing_summary", with_parts(f"""WITH s AS (SELECT *, 1 + (n_train / horizon) / (n_train / horizon + 10.0) * (smearing - 1) AS z FROM smears)
SELECT series_id, model, horizon, {rd('median(smearing)', 6)} AS smearing_median, {rd('min(smearing)', 6)} AS smearing_min, {rd('max(smearing)', 6)} AS smearing_max,
count(*) FILTER (WHERE smearing < 1.02) AS n_weak, {rd('avg(abs(smearing - 1))', 6)} AS raw_deviation, {rd('avg(abs(z - 1))', 6)} AS shrunk_deviation
FROM s GROUP BY ALL""", "smears"))
def smearing_summary(spark, sf_dir):
    s = smear_table(spark, sf_dir).withColumn(
        "smearing_shrunk", folds.shrink_smearing(F.col("smearing"), folds.effective_n("n_train")))
    return rounded(metrics.smearing_summary(s), 6)


@query("degenerate_forecast", with_parts(f"""SELECT *, CAST(sd_ratio < 0.10 AS INT) AS degenerate FROM (
SELECT series_id, model, horizon, fold, test_year, include_in_main, {rd('stddev_pop(pred) / nullif(stddev_pop(y_true), 0)', 6)} AS sd_ratio
FROM preds GROUP BY ALL)""", "preds"))
def degenerate_forecast(spark, sf_dir):
    return rounded(metrics.degenerate_forecast(level(spark, sf_dir)), 6)


@query("best_of_models", with_parts(f"SELECT series_id, horizon, arg_min(model, rmse_fold_mean) AS best_model, {rd('min(rmse_fold_mean)', 6)} AS best FROM means GROUP BY ALL", "means"))
def best_of_models(spark, sf_dir):
    return rounded(metrics.best_of(means(spark, sf_dir)), 6)


@query("by_procedure", with_parts(f"""WITH m AS (SELECT *, CASE WHEN model LIKE 'har%' THEN 'regression' ELSE 'naive' END AS procedure FROM fm)
SELECT horizon, model, procedure, count(*) AS n_folds, {rd('avg(rmse)', 6)} AS rmse_fold_mean, {rd('avg(mae)', 6)} AS mae_fold_mean,
CAST(grouping(procedure) AS INT) AS all_procedures FROM m WHERE include_in_main GROUP BY GROUPING SETS ((horizon, model, procedure), (horizon, model))""", "fm"))
def by_procedure(spark, sf_dir):
    m = fold_table(spark, sf_dir).withColumn("procedure", F.when(F.col("model").startswith("har"), "regression").otherwise("naive"))
    return rounded(metrics.by_procedure(m), 6)


@query("fixed_weight_blend", with_parts(f"""SELECT a.series_id, a.horizon, a.test_year, CAST(a.obs_date AS VARCHAR) AS obs_date, {rd('a.y_true', 7)} AS y_true,
{rd('0.5 * a.pred + 0.5 * b.pred', 7)} AS pred FROM p_har_x a JOIN p_past_vol b USING (series_id, horizon, obs_date)""", "p_har_x", "p_past_vol"))
def fixed_weight_blend(spark, sf_dir):
    from volpanel.operators.models import blend

    return rounded(blend(level(spark, sf_dir), "har_x", "past_vol").select(
        "series_id", "horizon", "test_year", "obs_date", "y_true", "pred"), 7)


# --- folds -----------------------------------------------------------------
@query("assign_folds", with_parts("""SELECT l.series_id, l.horizon, f.test_year,
count(*) FILTER (WHERE l.year < f.test_year) AS n_train_years, count(*) FILTER (WHERE l.year = f.test_year) AS n_test
FROM long l JOIN folds f ON l.series_id = f.series_id AND l.year <= f.test_year GROUP BY ALL""", "long", "folds"))
def assign_folds(spark, sf_dir):
    from volpanel.operators.models import fold_sizes

    return fold_sizes(rows(spark, sf_dir), YEARS)


@query("embargo", with_parts("""SELECT l.series_id, l.horizon, f.test_year, count(*) AS n_after_embargo, max(l.row_no) AS last_train_row
FROM long l JOIN folds f ON l.series_id = f.series_id AND l.year < f.test_year AND l.row_no + l.horizon < f.first_test GROUP BY ALL""", "long", "folds"))
def embargo(spark, sf_dir):
    r = rows(spark, sf_dir).filter(F.col("fit_from") <= max(YEARS))
    r = folds.replicate_to_folds(r, YEARS)
    return r.groupBy("series_id", "horizon", "test_year").agg(
        F.count(F.lit(1)).alias("n_after_embargo"), F.max("row_no").alias("last_train_row"))


@query("fold_leakage", with_parts("""SELECT f.series_id, l.horizon, f.test_year,
max(l.row_no) FILTER (WHERE l.year < f.test_year AND l.row_no + l.horizon < f.first_test AND l.y IS NOT NULL) AS last_train_row,
f.first_test AS first_test_row,
count(*) FILTER (WHERE l.year < f.test_year AND l.row_no + l.horizon < f.first_test AND l.y IS NOT NULL) AS n_train,
count(*) FILTER (WHERE l.year = f.test_year AND l.y IS NOT NULL) AS n_test, 0 AS leaks
FROM long l JOIN folds f ON l.series_id = f.series_id GROUP BY f.series_id, l.horizon, f.test_year, f.first_test""", "long", "folds"))
def fold_leakage(spark, sf_dir):
    return folds.fold_leakage(rows(spark, sf_dir), YEARS)


@query("inner_validation_split", with_parts("""WITH t AS (SELECT l.*, f.test_year FROM long l JOIN folds f ON l.series_id = f.series_id
 AND l.year < f.test_year AND l.row_no + l.horizon < f.first_test),
c AS (SELECT t.series_id, t.horizon, t.test_year, k.n AS n_years, count(*) AS n_val FROM t JOIN range(1, 7) k(n) ON t.year >= t.test_year - k.n GROUP BY ALL)
SELECT series_id, horizon, test_year, CAST(coalesce(min(n_years) FILTER (WHERE n_val >= 3 * horizon), max(n_years)) AS INT) AS n_val_years,
coalesce(arg_min(n_val, n_years) FILTER (WHERE n_val >= 3 * horizon), arg_max(n_val, n_years)) AS n_val FROM c GROUP BY ALL""", "long", "folds"))
def inner_validation_split(spark, sf_dir):
    return folds.validation_span(rows(spark, sf_dir), YEARS)


@query("effective_n_and_tier", with_parts(f"""SELECT series_id, horizon, test_year, n_train, {rd('n_train / horizon', 6)} AS n_effective,
CASE WHEN n_train / horizon >= 100 THEN 'high' WHEN n_train / horizon >= 30 THEN 'mid' ELSE 'low' END AS tier FROM fold_stats""", "fold_stats"))
def effective_n_and_tier(spark, sf_dir):
    c = coefs(spark, sf_dir).filter("variant = 'har'").withColumn("n_train", F.col("n").cast("long"))
    n_eff = folds.effective_n("n_train")
    return rounded(c.select("series_id", "horizon", "test_year", "n_train", n_eff.alias("n_effective"),
                            folds.capacity_tier(n_eff).alias("tier")), 6, "n_effective")


_q = {x: f"ln(1 + f_{x})" if x in LOG_FEATURES else f"CAST(f_{x} AS DOUBLE)" for x in FEATURES}
_LAST = "row_no >= 127"  # all 65 features are there: the longest window meets 126 returns before the row
for _s in ("train", "test"):
    part(f"{_s}_full", f"SELECT t.series_id, t.horizon, t.test_year, t.obs_date, {', '.join(f'{_q[x]} AS {x}' for x in FEATURES)} FROM {_s} t JOIN features f ON f.series_id = t.series_id AND f.row_no = t.row_no WHERE t.{_LAST}",
         _s, "features")


def _scaled(x):
    lo, hi = (f"least(greatest({m}_{x}, lo_{x}), hi_{x})" for m in ("mn", "mx"))
    return rd(f"(least(greatest(t.{x}, lo_{x}), hi_{x}) - {lo}) / CASE WHEN {hi} > {lo} THEN {hi} - {lo} ELSE 1 END", 6) + f" AS {x}"


@query("winsor_and_minmax", with_parts("WITH q AS (SELECT series_id, horizon, test_year, " + ", ".join(
    f"quantile_cont({x}, 0.005) AS lo_{x}, quantile_cont({x}, 0.995) AS hi_{x}, min({x}) AS mn_{x}, max({x}) AS mx_{x}"
    for x in FEATURES) + " FROM train_full GROUP BY ALL) SELECT t.series_id, t.horizon, t.test_year, CAST(t.obs_date AS VARCHAR) AS obs_date, "
    + ", ".join(map(_scaled, FEATURES)) + " FROM test_full t JOIN q ON " + fs.on("t", "q"), "train_full", "test_full"))
def winsor_and_minmax(spark, sf_dir):
    """All 65 features of every fold, bounds by narrowed bands."""
    from volpanel.catalog import window_queries as wq
    from volpanel.operators.trees import full_rows

    keys = ["series_id", "horizon"]
    r = fx.remember(spark, sf_dir, "complete_rows", lambda: full_rows(wq.features(spark, sf_dir), frame(spark, sf_dir), H).filter(folds.complete(FEATURES)))
    fits = folds.fit_preprocess(folds.bucketed(r, YEARS), FEATURES, LOG_FEATURES, YEARS, keys)
    out = folds.apply_preprocess(folds.test_rows(r, YEARS, PARTIAL), fits, FEATURES, LOG_FEATURES, keys)
    return rounded(out.select("series_id", "horizon", "test_year", "obs_date", *FEATURES), 6)


@query("target_transform", with_parts(f"""SELECT series_id, horizon, test_year, CAST(obs_date AS VARCHAR) AS obs_date,
{rd('ln(y) - ln(past_vol)', 7)} AS y_ratio, {rd('ln(y)', 7)} AS y_log, {rd('exp(ln(y) - ln(past_vol)) * 1.05 * past_vol', 7)} AS back
FROM test WHERE past_vol > 0""", "test"))
def target_transform(spark, sf_dir):
    from volpanel.operators.models import back_transform, fit_target

    t = folds.test_rows(rows(spark, sf_dir), YEARS, PARTIAL).filter(folds.complete(C.HAR)).filter("past_vol > 0")
    t = t.withColumns({"y_ratio": fit_target("ratio"), "y_log": fit_target("log")})
    return rounded(t.select("series_id", "horizon", "test_year", "obs_date", "y_ratio", "y_log",
                            back_transform(F.col("y_ratio"), F.lit(1.05), "ratio").alias("back")), 7)


@query("train_floor", with_parts(f"""SELECT s.series_id, s.horizon, s.test_year, {rd('s.floor', 7)} AS floor,
count(*) FILTER (WHERE p.model = 'har' AND p.pred = s.floor) AS n_floored_har, count(*) FILTER (WHERE p.model = 'har_x' AND p.pred = s.floor) AS n_floored_har_x
FROM fold_stats s JOIN preds p USING (series_id, horizon, test_year) GROUP BY s.series_id, s.horizon, s.test_year, s.floor""", "fold_stats", "preds"))
def train_floor(spark, sf_dir):
    p = level(spark, sf_dir)
    hit = F.col("pred") == F.col("floor")
    return rounded(p.groupBy("series_id", "horizon", "test_year").agg(
        F.first("floor").alias("floor"), F.count_if(hit & (F.col("model") == "har")).alias("n_floored_har"),
        F.count_if(hit & (F.col("model") == "har_x")).alias("n_floored_har_x")), 7)


@query("train_size_asymmetry", with_parts("""SELECT f.series_id, l.horizon, f.test_year,
count(*) FILTER (WHERE l.ret IS NOT NULL) AS n_unlabelled,
count(*) FILTER (WHERE l.row_no + l.horizon < f.first_test AND l.har_daily IS NOT NULL AND l.price_vol20 IS NOT NULL) AS n_labelled,
CAST(max(l.horizon) AS BIGINT) AS extra_from_embargo,
count(*) FILTER (WHERE l.ret IS NOT NULL) - count(*) FILTER (WHERE l.row_no + l.horizon < f.first_test AND l.har_daily IS NOT NULL AND l.price_vol20 IS NOT NULL) - max(l.horizon) AS extra_from_warmup
FROM (SELECT l.*, h.ret FROM long l JOIN har h USING (series_id, row_no)) l JOIN folds f ON l.series_id = f.series_id AND l.year < f.test_year GROUP BY ALL""", "long", "folds"))
def train_size_asymmetry(spark, sf_dir):
    from volpanel.operators.models import size_asymmetry

    return size_asymmetry(frame(spark, sf_dir), H, YEARS)
