"""Robustness, attribution, variants with removed rows, the variance grid, and relational operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import calendar_queries as cq
from volpanel.catalog import fixtures as fx
from volpanel.catalog import forecast_sql as fs
from volpanel.catalog.forecast_queries import coefs, fold_table, frame, level, means, rows
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.catalog.test_queries import HLN, K, binom_two_sql, nw_parts, t_two_sql
from volpanel.operators import attribution as at
from volpanel.operators import folds, garch, linear, metrics, robust, rolls, stattests
from volpanel.plans import walkforward as wf

H, YEARS, PARTIAL = fx.HORIZONS, fx.TEST_YEARS, fx.PARTIAL_YEAR
SAMPLES = {"full": (1998, 2001), "late": (2000, 2001), "early": (1998, 1999)}

# --- sub-samples -------------------------------------------------------------
part("subs", """SELECT *, rank() OVER (PARTITION BY series_id, horizon, sample ORDER BY rmse) AS rank_rmse, rank() OVER (PARTITION BY series_id, horizon, sample ORDER BY mae) AS rank_mae
FROM (SELECT series_id, horizon, model, s.sample, count(*) AS n_folds, avg(rmse) AS rmse, avg(mae) AS mae FROM fm
JOIN (VALUES ('full', 1998, 2001), ('late', 2000, 2001), ('early', 1998, 1999)) s(sample, a, b) ON test_year BETWEEN a AND b WHERE include_in_main GROUP BY ALL)""", "fm")


def subs(spark, sf_dir):
    return robust.subsample_ranking(fold_table(spark, sf_dir), SAMPLES)


@query("subsample_ranking", with_parts(f"""SELECT a.series_id, a.horizon, a.model, a.sample, a.n_folds, {rd('a.rmse', 7)} AS rmse, {rd('a.mae', 7)} AS mae,
CAST(a.rank_rmse AS INT) AS rank_rmse, CAST(a.rank_mae AS INT) AS rank_mae, CAST(a.rank_rmse - b.rank_rmse AS INT) AS rank_change
FROM subs a LEFT JOIN subs b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.model = b.model AND b.sample = 'full'""", "subs"))
def subsample_ranking(spark, sf_dir):
    return rounded(subs(spark, sf_dir), 7)


@query("ranking_stability", with_parts(f"""WITH j AS (SELECT a.*, b.rank_rmse AS rb FROM subs a JOIN subs b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.model = b.model AND b.sample = 'full')
SELECT series_id, horizon, sample, {rd('corr(rank_rmse, rb)', 6)} AS spearman, count(*) FILTER (WHERE rank_rmse != rb) AS n_moved,
array_to_string(list(model ORDER BY rmse, model)[1:3], ',') AS top3, {rd('100 * (max(rmse) FILTER (WHERE rank_rmse <= 5) / min(rmse) - 1)', 5)} AS top5_spread_pct FROM j GROUP BY ALL""", "subs"))
def ranking_stability(spark, sf_dir):
    return rounded(robust.ranking_stability(subs(spark, sf_dir), "full"), 6, top5_spread_pct=5)


@query("below_baseline", with_parts("""SELECT series_id, horizon, count(*) FILTER (WHERE m.rmse_fold_mean > b.r AND model != 'past_vol') AS n_worse FROM means m
JOIN (SELECT series_id, horizon, rmse_fold_mean AS r FROM means WHERE model = 'past_vol') b USING (series_id, horizon) GROUP BY ALL""", "means"))
def below_baseline(spark, sf_dir):
    return robust.below_baseline(means(spark, sf_dir), "past_vol")


@query("rank_models", with_parts(f"""SELECT series_id, horizon, model, CAST(rank() OVER (PARTITION BY series_id, horizon ORDER BY rmse_fold_mean) AS INT) AS rank FROM means""", "means"))
def rank_models(spark, sf_dir):
    w = Window.partitionBy("series_id", "horizon").orderBy("rmse_fold_mean")
    return means(spark, sf_dir).select("series_id", "horizon", "model", F.rank().over(w).alias("rank"))


@query("top_k_per_group", with_parts(f"""SELECT series_id, horizon, model, {rd('rmse_fold_mean', 7)} AS rmse FROM means
QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY rmse_fold_mean, model) <= 3""", "means"))
def top_k_per_group(spark, sf_dir):
    from volpanel.operators.relational import top_k

    out = top_k(means(spark, sf_dir), ["series_id", "horizon"], [F.col("rmse_fold_mean"), F.col("model")], 3)
    return rounded(out.select("series_id", "horizon", "model", F.col("rmse_fold_mean").alias("rmse")), 7)


ORDER = ["har_x", "har_index", "har_implied", "har", "train_mean", "past_vol"]


@query("custom_order", with_parts("SELECT series_id, horizon, model, CAST(CASE model " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(ORDER)) + " END AS BIGINT) AS position FROM means", "means"))
def custom_order(spark, sf_dir):
    from volpanel.operators.relational import in_order

    out = in_order(means(spark, sf_dir), "model", ORDER, "horizon", "series_id")
    return out.select("series_id", "horizon", "model", F.col("_rank").alias("position"))


# --- rescoring on a gap-adjusted target --------------------------------------
part("adjret", "SELECT f.*, r.ret / sqrt(1 + f.skipped) AS retc FROM flags f JOIN rets r USING (series_id, row_no)", "flags", "rets")
_w = "OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
part("adjtgt", " UNION ALL ".join(f"SELECT series_id, row_no, {h} AS horizon, CASE WHEN count(retc) {_w.format(h=h)} = {h} THEN stddev_samp(retc) {_w.format(h=h)} END AS y_new FROM adjret" for h in H), "adjret")
part("resc", """SELECT p.series_id, model, horizon, test_year, count(*) AS n, sqrt(avg((y_true - pred) ** 2)) AS rmse, sqrt(avg((y_new - pred) ** 2)) AS rmse_new,
avg(abs(y_true - pred)) AS mae, avg(abs(y_new - pred)) AS mae_new, count(*) FILTER (WHERE abs(y_new - y_true) > 1e-12 * abs(y_true)) AS n_changed
FROM preds p JOIN adjtgt t USING (series_id, horizon, row_no) WHERE include_in_main GROUP BY ALL""", "preds", "adjtgt")


def adjusted(spark, sf_dir):
    from volpanel.operators import features as ft
    from volpanel.operators.panel import add_chunks, chunk_window, core_rows

    w = chunk_window()
    df = add_chunks(cq.flagged(spark, sf_dir), back=1, ahead=max(H)).withColumn("ret", ft.log_return("price", w))
    df = df.withColumn("adj", rolls.gap_adjusted_return(F.col("ret"), F.col("n_unexplained")))
    df = core_rows(df.withColumns({f"t{h}": ft.forward_vol("adj", w, h) for h in H}))
    return df.select("series_id", "obs_date", "row_no", "adj", F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"t{h}").alias("y_new")) for h in H])))


@query("gap_adjusted_target", with_parts(f"SELECT series_id, row_no, horizon, {rd('y_new', 8)} AS y_new, {rd('retc', 8)} AS adj FROM adjtgt JOIN adjret USING (series_id, row_no)", "adjtgt", "adjret"))
def gap_adjusted_target(spark, sf_dir):
    return rounded(adjusted(spark, sf_dir).select("series_id", "row_no", "horizon", "y_new", "adj"), 8)


def rescored(spark, sf_dir):
    return robust.rescore(level(spark, sf_dir), adjusted(spark, sf_dir).select("series_id", "horizon", "row_no", "y_new"))


@query("rescore", with_parts("SELECT series_id, model, horizon, test_year, n, n_changed, " + ", ".join(f"{rd(c, 7)} AS {c}" for c in ("rmse", "rmse_new", "mae", "mae_new")) + " FROM resc", "resc"))
def rescore(spark, sf_dir):
    return rounded(rescored(spark, sf_dir), 7)


@query("rescore_ranks", with_parts(f"""SELECT *, CAST(rank() OVER (PARTITION BY series_id, horizon ORDER BY rmse) AS INT) AS rank, CAST(rank() OVER (PARTITION BY series_id, horizon ORDER BY rmse_new) AS INT) AS rank_new
FROM (SELECT series_id, horizon, model, {rd('avg(rmse)', 7)} AS rmse, {rd('avg(rmse_new)', 7)} AS rmse_new, CAST(sum(n_changed) AS BIGINT) AS n_changed, {rd('100 * (avg(rmse_new) / avg(rmse) - 1)', 5)} AS change_pct FROM resc GROUP BY ALL)""", "resc"))
def rescore_ranks(spark, sf_dir):
    return rounded(robust.rescore_ranks(rescored(spark, sf_dir)), 7, change_pct=5)


# --- regimes, tails, years ----------------------------------------------------
part("sq", """SELECT series_id, horizon, test_year, obs_date, any_value(y_true) AS y, max((y_true - pred) ** 2) FILTER (WHERE model = 'har') AS ea,
max((y_true - pred) ** 2) FILTER (WHERE model = 'har_x') AS eb FROM preds WHERE include_in_main GROUP BY ALL""", "preds")
part("reg", """SELECT *, CASE WHEN mv > median(mv) OVER (PARTITION BY series_id, horizon) THEN 'high' ELSE 'low' END AS regime
FROM (SELECT series_id, horizon, test_year, count(*) AS n, avg(y) AS mv, sqrt(avg(ea)) AS ra, sqrt(avg(eb)) AS rb, sum(ea) AS sa, sum(eb) AS sb FROM sq GROUP BY ALL)""", "sq")


@query("regime_split", with_parts(f"""SELECT series_id, horizon, regime, count(*) AS n_folds, {rd('avg(mv)', 6)} AS mean_vol, {rd('avg(ra)', 7)} AS fold_a, {rd('avg(rb)', 7)} AS fold_b,
{rd('sqrt(sum(sa) / sum(n))', 7)} AS pooled_a, {rd('sqrt(sum(sb) / sum(n))', 7)} AS pooled_b, count(*) FILTER (WHERE rb < ra) AS wins_b,
{rd('100 * sum(sa) / sum(sum(sa)) OVER (PARTITION BY series_id, horizon)', 5)} AS squared_error_share_pct FROM reg GROUP BY series_id, horizon, regime""", "reg"))
def regime_split(spark, sf_dir):
    return rounded(robust.regime_split(level(spark, sf_dir), "har", "har_x"), 7, mean_vol=6, squared_error_share_pct=5)


@query("tail_robustness", with_parts(f"""WITH e AS (SELECT *, 'all' AS sample FROM sq UNION ALL SELECT *, 'without_year' FROM sq WHERE test_year != 1999),
t AS (SELECT *, ea >= quantile_cont(ea, 0.99) OVER (PARTITION BY series_id, horizon, sample) AS top FROM e)
SELECT series_id, horizon, sample, count(*) AS n, count(*) FILTER (WHERE top) AS n_tail, {rd('100 * sum(ea) FILTER (WHERE top) / sum(ea)', 5)} AS tail_share_pct,
{rd('100 * (sqrt(avg(eb) FILTER (WHERE top) / avg(ea) FILTER (WHERE top)) - 1)', 5)} AS tail_pct, {rd('100 * (sqrt(avg(eb) FILTER (WHERE NOT top) / avg(ea) FILTER (WHERE NOT top)) - 1)', 5)} AS rest_pct,
{rd('100 * (sqrt(avg(eb) / avg(ea)) - 1)', 5)} AS pooled_pct FROM t GROUP BY ALL""", "sq"))
def tail_robustness(spark, sf_dir):
    return rounded(robust.tail_robustness(level(spark, sf_dir), "har", "har_x", 1999), 5)


@query("year_contribution", with_parts(f"""WITH y AS (SELECT series_id, horizon, test_year, count(*) AS n, sum(ea) - sum(eb) AS c FROM sq GROUP BY ALL)
SELECT series_id, horizon, test_year, n, {rd('c', 6)} AS contribution, {rd('100 * c / sum(c) OVER (PARTITION BY series_id, horizon)', 4)} AS share_pct,
{rd('100 * sum(c) OVER (PARTITION BY series_id, horizon ORDER BY c DESC, test_year) / sum(c) OVER (PARTITION BY series_id, horizon)', 4)} AS cumulative_pct FROM y""", "sq"))
def year_contribution(spark, sf_dir):
    return rounded(robust.year_contribution(level(spark, sf_dir), "har", "har_x"), 4, contribution=6)


@query("rmse_ratio_by_year", with_parts(f"SELECT a.series_id, a.horizon, a.model, a.test_year, {rd('a.rmse / b.rmse', 6)} AS ratio FROM fm a JOIN fm b USING (series_id, horizon, test_year) WHERE b.model = 'past_vol'", "fm"))
def rmse_ratio_by_year(spark, sf_dir):
    out = robust.rmse_ratio_by_year(fold_table(spark, sf_dir), "past_vol")
    return rounded(out.select("series_id", "horizon", "model", "test_year", "ratio"), 6)


# --- two alignments -------------------------------------------------------------
def published_rows(spark, sf_dir):
    from volpanel.catalog.window_queries import features_published

    idx = ["idx_a_lag1", "idx_b_lag1"]
    p = features_published(spark, sf_dir).select("series_id", "row_no", *[F.col(c).alias(f"p_{c}") for c in idx])
    f = frame(spark, sf_dir).join(p, ["series_id", "row_no"])
    return f.withColumns({c: F.col(f"p_{c}") for c in idx}).drop(*[f"p_{c}" for c in idx])


part("long_pub", "SELECT l.* EXCLUDE (idx_a_lag1, idx_b_lag1), p.f_idx_a_lag1 AS idx_a_lag1, p.f_idx_b_lag1 AS idx_b_lag1 FROM long l JOIN pub_features p USING (series_id, row_no)", "long", "pub_features")
_clean = "y IS NOT NULL AND har_daily IS NOT NULL AND price_vol5 IS NOT NULL AND price_vol20 IS NOT NULL"
part("train_pub", f"SELECT l.*, f.test_year FROM long_pub l JOIN folds f ON l.series_id = f.series_id AND l.year < f.test_year AND l.row_no + l.horizon < f.first_test WHERE {_clean}", "long_pub", "folds")
part("test_pub", f"SELECT *, year AS test_year, NOT (year = 2001 AND horizon >= 66) AS include_in_main FROM long_pub WHERE year BETWEEN 1998 AND 2001 AND {_clean}", "long_pub")
fs.ols_parts("har_x_pub", list(C.HAR_VARIANTS["har_x"]), "train_pub")
part("fm2", f"""SELECT series_id, model, horizon, test_year, include_in_main, 'row' AS alignment, rmse, mae, r2_oos FROM fm WHERE model IN ('har', 'har_x')
UNION ALL SELECT series_id, model, horizon, test_year, include_in_main, 'published', rmse, mae, r2_oos FROM fm WHERE model = 'har'
UNION ALL SELECT t.series_id, 'har_x', t.horizon, t.test_year, t.include_in_main, 'published', sqrt(avg((t.y - greatest({fs.predictor(C.HAR_VARIANTS['har_x'])}, s.floor)) ** 2)),
avg(abs(t.y - greatest({fs.predictor(C.HAR_VARIANTS['har_x'])}, s.floor))), 1 - sum((t.y - greatest({fs.predictor(C.HAR_VARIANTS['har_x'])}, s.floor)) ** 2) / sum((t.y - s.train_mean) ** 2)
FROM test_pub t JOIN fit_har_x_pub f ON {fs.on('t', 'f')} {fs.JOIN_STATS} GROUP BY t.series_id, t.horizon, t.test_year, t.include_in_main""", "fm", "test_pub", "fit_har_x_pub", "fold_stats")


@query("two_alignment_comparison", with_parts(f"""WITH f AS (SELECT a.series_id, a.model, a.horizon, a.test_year, a.rmse AS ra, b.rmse AS rb, a.mae AS ma, b.mae AS mb, a.r2_oos AS qa, b.r2_oos AS qb
FROM fm2 a JOIN fm2 b USING (series_id, model, horizon, test_year) WHERE a.alignment = 'row' AND b.alignment = 'published' AND a.include_in_main),
g AS (SELECT series_id, model, horizon, count(*) AS n_folds, avg(ra) AS rmse_a, avg(rb) AS rmse_b, avg(ma) AS mae_a, avg(mb) AS mae_b, avg(qb) - avg(qa) AS r2_oos_diff,
count(*) FILTER (WHERE rb < ra - 1e-12) AS wins_b, count(*) FILTER (WHERE rb > ra + 1e-12) AS wins_a, count(*) FILTER (WHERE abs(ra - rb) <= 1e-12) AS ties FROM f GROUP BY ALL)
SELECT series_id, model, horizon, n_folds, wins_a, wins_b, ties, {', '.join(f'{rd(c, 7)} AS {c}' for c in ('rmse_a', 'rmse_b', 'mae_a', 'mae_b'))}, {rd('r2_oos_diff', 5)} AS r2_oos_diff,
{rd('100 * (rmse_b / rmse_a - 1)', 5)} AS rmse_pct, {rd('100 * (mae_b / mae_a - 1)', 5)} AS mae_pct, {rd(binom_two_sql('wins_b', '(wins_a + wins_b)'), 7)} AS p_sign FROM g""", "fm2"))
def two_alignment_comparison(spark, sf_dir):
    def build():
        a = metrics.fold_metrics(level(spark, sf_dir).filter("model in ('har', 'har_x')")).withColumn("alignment", F.lit("row"))
        v = {k: C.HAR_VARIANTS[k] for k in ("har", "har_x")}
        p = wf.level_predictions(published_rows(spark, sf_dir), H, YEARS, PARTIAL, variants=v, naive=False)
        return a.unionByName(metrics.fold_metrics(p).withColumn("alignment", F.lit("published")))
    m = fx.remember(spark, sf_dir, "two_alignments", build)
    # models without the index must not differ at all; equal sums are compared after rounding off summation order
    m = m.withColumns({c: F.round(c, 12) for c in ("rmse", "mae")})
    out = robust.alignment_comparison(m, "row", "published")
    return rounded(out, 7, r2_oos_diff=5, rmse_pct=5, mae_pct=5)


# --- attribution -------------------------------------------------------------------
def std_betas(spark, sf_dir):
    b = linear.standardized_betas(coefs(spark, sf_dir), wf.XS, C.HAR_VARIANTS)
    return b.withColumn("include_in_main", folds.include_in_main(PARTIAL))


part("zs", " UNION ALL ".join(f"SELECT series_id, horizon, '{v}' AS variant, test_year, '{x}' AS regressor, z_{x} AS z, NOT (test_year = 2001 AND horizon >= 66) AS inc FROM fit_{v}"
                              for v, xs in C.HAR_VARIANTS.items() for x in xs), *[f"fit_{v}" for v in C.HAR_VARIANTS])


@query("beta_summary", with_parts("SELECT fold_set, series_id, horizon, variant, regressor, count(*) AS n_folds, " + ", ".join(
    f"{rd(f'{fn}(z)', 6)} AS {n}" for fn, n in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")))
    + """, count(*) FILTER (WHERE z > 0) AS n_positive, count(*) FILTER (WHERE z < 0) AS n_negative FROM (
SELECT *, 'main' AS fold_set FROM zs WHERE inc UNION ALL SELECT *, 'all_estimated' FROM zs) GROUP BY ALL""", "zs"))
def beta_summary(spark, sf_dir):
    return rounded(at.beta_summary(std_betas(spark, sf_dir)), 6)


def attributions(spark, sf_dir):
    def build():
        t = folds.test_rows(rows(spark, sf_dir), YEARS, PARTIAL).filter(folds.complete(wf.XS))
        c = coefs(spark, sf_dir).filter("variant = 'har_x'")
        return at.linear_attribution(t.select("series_id", "horizon", "test_year", "obs_date", *wf.XS), c, wf.XS, ["series_id", "horizon", "test_year"])
    return fx.remember(spark, sf_dir, "attributions", build)


part("attr", " UNION ALL ".join(f"""SELECT t.series_id, t.horizon, t.test_year, t.obs_date, '{x}' AS feature, t.{x} AS x, f.b_{x} * (t.{x} - f.m_{x}) AS a
FROM test t JOIN fit_har_x f ON {fs.on('t', 'f')}""" for x in wf.XS), "test", "fit_har_x")


@query("linear_attribution", with_parts(f"SELECT series_id, horizon, test_year, CAST(obs_date AS VARCHAR) AS obs_date, feature, {rd('a', 7)} AS attribution FROM attr", "attr"))
def linear_attribution(spark, sf_dir):
    return rounded(attributions(spark, sf_dir).select("series_id", "horizon", "test_year", "obs_date", "feature", "attribution"), 7)


part("imp", "SELECT series_id, horizon, test_year, feature, avg(abs(a)) AS v FROM attr GROUP BY ALL", "attr")


def importance(spark, sf_dir):
    return at.feature_importance(attributions(spark, sf_dir))


@query("feature_importance", with_parts(f"""WITH m AS (SELECT series_id, horizon, feature, avg(v) AS v FROM imp GROUP BY ALL)
SELECT series_id, horizon, feature, {rd('v', 7)} AS mean_abs, {rd('100 * v / sum(v) OVER (PARTITION BY series_id, horizon)', 5)} AS share_pct,
CAST(row_number() OVER (PARTITION BY series_id, horizon ORDER BY v DESC, feature) AS INT) AS rank,
{rd('100 * sum(v) OVER (PARTITION BY series_id, horizon ORDER BY v DESC, feature) / sum(v) OVER (PARTITION BY series_id, horizon)', 5)} AS cumulative_pct FROM m""", "imp"))
def feature_importance(spark, sf_dir):
    return rounded(at.importance_shares(importance(spark, sf_dir)), 7, share_pct=5, cumulative_pct=5)


_grp = "CASE WHEN feature LIKE 'idx%' THEN 'index' WHEN feature LIKE 'implied%' THEN 'implied' ELSE 'volatility' END"


@query("group_shares", with_parts(f"""WITH g AS (SELECT series_id, horizon, {_grp} AS "group", sum(v) AS t FROM imp GROUP BY ALL),
s AS (SELECT *, 100 * t / sum(t) OVER (PARTITION BY series_id, horizon) AS p FROM g)
SELECT series_id, horizon, "group", {rd('t', 6)} AS total, {rd('p', 5)} AS share_pct, {rd('''sum(p) FILTER (WHERE "group" = 'index') OVER (PARTITION BY series_id, horizon)''', 5)} AS outside_pct FROM s""", "imp"))
def group_shares(spark, sf_dir):
    return rounded(at.group_shares(importance(spark, sf_dir)), 6, share_pct=5, outside_pct=5)


@query("sign_agreement", with_parts(f"""WITH a AS (SELECT series_id, horizon, test_year, feature, corr(x, a) AS r FROM attr GROUP BY ALL)
SELECT a.series_id, a.horizon, count(*) AS n_compared, count(*) FILTER (WHERE sign(r) = sign(z)) AS n_agree, {rd('100.0 * count(*) FILTER (WHERE sign(r) = sign(z)) / count(*)', 5)} AS agree_pct
FROM a JOIN zs ON zs.variant = 'har_x' AND zs.regressor = a.feature AND {fs.on('zs', 'a')} WHERE feature NOT IN ('price_vol5', 'price_vol20') GROUP BY ALL""", "attr", "zs"))
def sign_agreement(spark, sf_dir):
    b = std_betas(spark, sf_dir).filter("variant = 'har_x'")
    s = at.sign_agreement(attributions(spark, sf_dir), b, ("price_vol5", "price_vol20"))
    return rounded(at.agreement_summary(s, "series_id", "horizon"), 5)


def stability_pairs(spark, sf_dir):
    sizes = coefs(spark, sf_dir).filter("variant = 'har_x'").select("series_id", "horizon", "test_year", F.col("n").alias("n_train"))
    return at.rank_stability_pairs(importance(spark, sf_dir), sizes)


part("spairs", """WITH r AS (SELECT *, rank() OVER (PARTITION BY series_id, horizon, test_year ORDER BY v) AS r FROM imp)
SELECT a.series_id, a.horizon, a.test_year AS y1, b.test_year AS y2, corr(a.r, b.r) AS rho, any_value(100.0 * s1.n_train / s2.n_train) AS ov
FROM r a JOIN r b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.feature = b.feature AND a.test_year < b.test_year
JOIN fold_stats s1 ON s1.series_id = a.series_id AND s1.horizon = a.horizon AND s1.test_year = a.test_year
JOIN fold_stats s2 ON s2.series_id = b.series_id AND s2.horizon = b.horizon AND s2.test_year = b.test_year GROUP BY ALL""", "imp", "fold_stats")


@query("stability_by_distance", with_parts(f"SELECT series_id, horizon, CAST(y2 - y1 AS INT) AS distance, count(*) AS n_pairs, {rd('avg(rho)', 6)} AS rho_mean, {rd('avg(ov)', 5)} AS overlap_mean_pct FROM spairs GROUP BY series_id, horizon, y2 - y1", "spairs"))
def stability_by_distance(spark, sf_dir):
    return rounded(at.stability_by_distance(stability_pairs(spark, sf_dir)), 6, overlap_mean_pct=5)


@query("rank_stability", with_parts(f"""WITH s AS (SELECT series_id, horizon, avg(rho) FILTER (WHERE y2 - y1 = 1) AS cm, min(rho) FILTER (WHERE y2 - y1 = 1) AS cn, arg_max(rho, y2 - y1) AS fl, arg_max(ov, y2 - y1) AS fo FROM spairs GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon, test_year ORDER BY v DESC, feature) AS k FROM imp),
t AS (SELECT series_id, horizon, count(DISTINCT feature) FILTER (WHERE k <= 2) AS n_in_top, count(DISTINCT test_year) AS n_folds FROM k GROUP BY ALL),
l AS (SELECT series_id, horizon, feature AS usual_leader, count(*) AS folds_led FROM k WHERE k = 1 GROUP BY series_id, horizon, feature QUALIFY row_number() OVER (PARTITION BY series_id, horizon ORDER BY count(*) DESC, feature DESC) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY v DESC, feature) AS k FROM (SELECT series_id, horizon, feature, avg(v) AS v FROM imp GROUP BY ALL)),
c AS (SELECT series_id, horizon, 100 * sum(v) FILTER (WHERE k <= 2) / sum(v) AS cc FROM p GROUP BY ALL)
SELECT series_id, horizon, {rd('cm', 6)} AS consecutive_mean, {rd('cn', 6)} AS consecutive_min, {rd('fl', 6)} AS first_last_rho, {rd('fo', 5)} AS first_last_overlap_pct, n_in_top, n_folds, usual_leader, folds_led,
{rd('cc', 5)} AS top_concentration_pct FROM s JOIN t USING (series_id, horizon) JOIN l USING (series_id, horizon) JOIN c USING (series_id, horizon)""", "spairs", "imp"))
def rank_stability(spark, sf_dir):
    return rounded(at.stability_summary(stability_pairs(spark, sf_dir), importance(spark, sf_dir)), 6,
                   first_last_overlap_pct=5, top_concentration_pct=5)


# --- variants without roll days ------------------------------------------------------
def masked(spark, sf_dir, variant: str):
    """Panel with ``removed`` = 1 on roll rows (A), also on the row after (A2), or nowhere (baseline)."""
    r = cq.rolls(spark, sf_dir).select("series_id", F.col("roll_row").alias("row_no")).distinct()
    if variant == "A2":
        r = r.unionByName(r.withColumn("row_no", F.col("row_no") + 1)).distinct()
    if variant == "baseline":
        return fx.panel(spark, sf_dir).withColumn("removed", F.lit(0))
    return (fx.panel(spark, sf_dir).join(r.withColumn("removed", F.lit(1)), ["series_id", "row_no"], "left")
            .na.fill(0, ["removed"]))


def variant_frame(spark, sf_dir, variant: str):
    return fx.remember(spark, sf_dir, f"variant_{variant}", lambda: rolls.build_variant(masked(spark, sf_dir, variant), H))


part("mask", "SELECT r.*, coalesce(m.removed, 0) AS removed, CASE WHEN m.removed IS NULL THEN ret END AS clean FROM rets r LEFT JOIN (SELECT DISTINCT series_id, roll_row, 1 AS removed FROM rollt) m ON m.series_id = r.series_id AND m.roll_row = r.row_no", "rets", "rollt")
part("cleanseq", "SELECT series_id, row_no, clean, row_number() OVER (PARTITION BY series_id ORDER BY row_no) AS k FROM mask WHERE clean IS NOT NULL", "mask")
part("cleanpos", "SELECT *, coalesce(count(clean) OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen, lag(ret, 1) OVER (PARTITION BY series_id ORDER BY row_no) AS o1, lag(ret, 3) OVER (PARTITION BY series_id ORDER BY row_no) AS o3 FROM mask", "mask")


@query("clean_return_lags", with_parts(f"""SELECT c.series_id, c.row_no, {rd('CASE WHEN o1 IS NOT NULL THEN a.clean END', 8)} AS price_ret_lag1, {rd('CASE WHEN o3 IS NOT NULL THEN b.clean END', 8)} AS price_ret_lag3
FROM cleanpos c LEFT JOIN cleanseq a ON a.series_id = c.series_id AND a.k = c.seen LEFT JOIN cleanseq b ON b.series_id = c.series_id AND b.k = c.seen - 2""", "cleanpos", "cleanseq"))
def clean_return_lags(spark, sf_dir):
    return rounded(variant_frame(spark, sf_dir, "A").select("series_id", "row_no", "price_ret_lag1", "price_ret_lag3"), 8)


def _clean_std_sql(n, frame_sql):
    w = f"OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN {frame_sql})"
    return f"CASE WHEN count(ret) {w} = {n} THEN CASE WHEN count(clean) {w} >= 2 THEN stddev_samp(clean) {w} END END"


@query("clean_rolling_vol", with_parts("SELECT series_id, row_no, " + ", ".join(
    [f"{rd(_clean_std_sql(n, f'{n} PRECEDING AND 1 PRECEDING'), 8)} AS price_vol{n}" for n in (5, 20)]
    + [f"{rd(_clean_std_sql(h, f'1 FOLLOWING AND {h} FOLLOWING'), 8)} AS target_vol_{h}" for h in H]) + " FROM mask", "mask"))
def clean_rolling_vol(spark, sf_dir):
    return rounded(variant_frame(spark, sf_dir, "A").select("series_id", "row_no", "price_vol5", "price_vol20", *[f"target_vol_{h}" for h in H]), 8)


@query("empty_mask_is_baseline", with_parts("SELECT count(*) AS n_left, count(*) AS n_right, CAST(0 AS BIGINT) AS n_different FROM num", "num"))
def empty_mask_is_baseline(spark, sf_dir):
    from volpanel.operators.quality import same_table

    cols = [*[f"target_vol_{h}" for h in H], *[f"past_vol_{h}" for h in H], "har_daily", "price_vol5", "price_vol20"]
    return same_table(frame(spark, sf_dir), variant_frame(spark, sf_dir, "baseline"), ["series_id", "row_no"], cols)


@query("mask_targets_touching_roll", with_parts(f"""SELECT series_id, count(*) FILTER (WHERE y IS NOT NULL) AS n_valid, count(*) FILTER (WHERE y IS NOT NULL AND NOT t) AS n_kept FROM (
SELECT series_id, target_vol_5 AS y, coalesce(max(removed) OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) > 0 AS t
FROM wide JOIN (SELECT series_id, row_no, removed FROM mask) USING (series_id, row_no)) GROUP BY ALL""", "wide", "mask"))
def mask_targets_touching_roll(spark, sf_dir):
    t = variant_frame(spark, sf_dir, "A").select("series_id", "row_no", "touched_5")
    f = frame(spark, sf_dir).join(t, ["series_id", "row_no"])
    return f.groupBy("series_id").agg(F.count("target_vol_5").alias("n_valid"),
                                      F.count(F.when(F.col("touched_5") == 0, F.col("target_vol_5"))).alias("n_kept"))


def variant_panel(spark, sf_dir):
    """Regressors and targets of the baseline, A, A2 and B (targets touching a roll dropped, h = 5), one below the other."""
    def build():
        stacked = None
        for name in ("baseline", "A", "A2", "B"):
            f = frame(spark, sf_dir) if name == "baseline" else variant_frame(spark, sf_dir, "A2" if name == "A2" else "A")
            if name == "B":
                t = f.select("series_id", "row_no", "touched_5")
                f = frame(spark, sf_dir).join(t, ["series_id", "row_no"])
                f = f.withColumns({f"target_vol_{h}": F.when(F.lit(h == 5) & (F.col("touched_5") == 0), F.col(f"target_vol_{h}")) for h in H})
            f = f.select("series_id", "obs_date", "year", "row_no", *wf.XS, *[f"{c}_{h}" for h in H for c in ("target_vol", "past_vol", "fit_from")],
                         F.lit(name).alias("variant"))
            stacked = f if stacked is None else stacked.unionByName(f)
        return stacked.withColumnRenamed("variant", "roll_variant")
    return fx.remember(spark, sf_dir, "variant_panel", build)


def variant_rows(spark, sf_dir):
    return wf.level_rows(variant_panel(spark, sf_dir), H, ["series_id", "roll_variant"])


def variant_predictions(spark, sf_dir):
    """HAR and HAR-X on all variants."""
    v = {k: C.HAR_VARIANTS[k] for k in ("har", "har_x")}
    return fx.remember(spark, sf_dir, "variant_predictions", lambda: wf.level_predictions(
        variant_panel(spark, sf_dir), H, YEARS, PARTIAL, keys=("series_id", "roll_variant"), variants=v, naive=False))


part("base_fm", "SELECT 'baseline' AS roll_variant, series_id, model, horizon, test_year, n, rmse FROM fm WHERE model IN ('har', 'har_x')", "fm")


@query("rollover_baseline", with_parts(f"SELECT roll_variant, series_id, model, horizon, test_year, n, {rd('rmse', 7)} AS rmse FROM base_fm", "base_fm"))
def rollover_baseline(spark, sf_dir):
    m = metrics.fold_metrics(variant_predictions(spark, sf_dir).filter("roll_variant = 'baseline'"), ("roll_variant", *metrics.FOLD))
    return rounded(m.select("roll_variant", "series_id", "model", "horizon", "test_year", "n", "rmse"), 7)


# every variant as a series of its own: series_id = series # variant
def _variant_long(tag: str, gone: str) -> None:
    part(f"mask_{tag}", f"SELECT r.*, CAST(r.row_no IN (SELECT x.row_no FROM ({gone}) x WHERE x.series_id = r.series_id) AS INT) AS removed FROM rets r", "rets", "rollt")
    part(f"cl_{tag}", f"SELECT *, CASE WHEN removed = 0 THEN ret END AS clean, lag(ret) OVER (PARTITION BY series_id ORDER BY row_no) AS o1 FROM mask_{tag}", f"mask_{tag}")
    part(f"var_{tag}", "SELECT series_id, obs_date, year, row_no, CASE WHEN o1 IS NOT NULL THEN abs(last_value(clean IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY row_no "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS har_daily, "
         + ", ".join(f"{_clean_std_sql(n, f'{n} PRECEDING AND 1 PRECEDING')} AS price_vol{n}" for n in (5, 20)) + ", "
         + ", ".join(f"lag({x}) OVER (PARTITION BY series_id ORDER BY row_no) AS {x}_lag1" for x in ("implied", "idx_a", "idx_b")) + ", "
         + ", ".join(f"{_clean_std_sql(h, f'1 FOLLOWING AND {h} FOLLOWING')} AS y_{h}" for h in H)
         + f", coalesce(max(removed) OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS touched FROM cl_{tag}", f"cl_{tag}")


_variant_long("A", "SELECT series_id, roll_row AS row_no FROM rollt")
_variant_long("A2", "SELECT series_id, roll_row AS row_no FROM rollt UNION SELECT series_id, roll_row + 1 FROM rollt")
_xs = ", ".join(C.HAR_VARIANTS["har_x"])
part("long_v", f"""SELECT series_id || '#baseline' AS series_id, horizon, obs_date, year, row_no, y, {_xs} FROM long
UNION ALL SELECT l.series_id || '#B', l.horizon, l.obs_date, l.year, l.row_no, l.y, {', '.join('l.' + x for x in C.HAR_VARIANTS['har_x'])} FROM long l JOIN var_A a USING (series_id, row_no) WHERE l.horizon = 5 AND a.touched = 0
""" + "".join(f" UNION ALL SELECT series_id || '#{t}', {h}, obs_date, year, row_no, y_{h}, {_xs} FROM var_{t}" for t in ("A", "A2") for h in H), "long", "var_A", "var_A2")
_base = "split_part(l.series_id, '#', 1)"
part("train_v", f"SELECT l.*, f.test_year FROM long_v l JOIN folds f ON f.series_id = {_base} AND l.year < f.test_year AND l.row_no + l.horizon < f.first_test WHERE {_clean}", "long_v", "folds")
part("test_v", f"SELECT *, year AS test_year, NOT (year = 2001 AND horizon >= 66) AS include_in_main FROM long_v WHERE year BETWEEN 1998 AND 2001 AND {_clean}", "long_v")
part("stats_v", "SELECT series_id, horizon, test_year, avg(y) AS train_mean, min(y) AS floor FROM train_v GROUP BY ALL", "train_v")
for _m in ("har", "har_x"):
    fs.ols_parts(f"{_m}_v", list(C.HAR_VARIANTS[_m]), "train_v")
part("preds_v", " UNION ALL ".join(f"""SELECT '{m}' AS model, t.series_id, t.horizon, t.test_year, t.obs_date, t.include_in_main, t.y AS y_true, greatest({fs.predictor(C.HAR_VARIANTS[m])}, s.floor) AS pred
FROM test_v t JOIN fit_{m}_v f ON {fs.on('t', 'f')} JOIN stats_v s ON {fs.on('t', 's')}""" for m in ("har", "har_x")), "test_v", "fit_har_v", "fit_har_x_v", "stats_v")
_split = "split_part(series_id, '#', 1) AS series_id, split_part(series_id, '#', 2) AS roll_variant"


@query("rollover_variants", with_parts(f"""SELECT {_split}, model, horizon, test_year, n, {rd('rmse', 6)} AS rmse, {rd('mae', 6)} AS mae FROM (
SELECT series_id, model, horizon, test_year, count(*) AS n, sqrt(avg((y_true - pred) ** 2)) AS rmse, avg(abs(y_true - pred)) AS mae FROM preds_v GROUP BY ALL)""", "preds_v"))
def rollover_variants(spark, sf_dir):
    m = metrics.fold_metrics(variant_predictions(spark, sf_dir), ("roll_variant", *metrics.FOLD))
    return rounded(m.select("roll_variant", "series_id", "model", "horizon", "test_year", "n", "rmse", "mae"), 6)


part("pl_v", """SELECT a.series_id, a.horizon, 'har|har_x' AS pair, a.test_year, a.obs_date, a.y_true - a.pred AS e1, b.y_true - b.pred AS e2,
(a.y_true - a.pred) ** 2 - (b.y_true - b.pred) ** 2 AS d FROM preds_v a JOIN preds_v b USING (series_id, horizon, obs_date) WHERE a.model = 'har' AND b.model = 'har_x' AND a.include_in_main""", "preds_v")
nw_parts("v", "pl_v", "d")
part("dm_v", f"""SELECT *, mean / sqrt(greatest(omega, 1e-300) / n) * {HLN} AS dm_hln FROM (SELECT {K}, count(*) AS n, avg(d) AS mean FROM pl_v GROUP BY ALL) JOIN nw_v USING ({K})""", "pl_v", "nw_v")
part("sg_v", f"""SELECT {K}, count(*) AS n_folds, count(*) FILTER (WHERE a < b) AS wins FROM (SELECT {K}, test_year, sqrt(avg(e1 ** 2)) AS a, sqrt(avg(e2 ** 2)) AS b FROM pl_v GROUP BY ALL) GROUP BY ALL""", "pl_v")
part("p_v", f"""SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p, horizon) AS r, count(*) OVER (PARTITION BY series_id) AS m
FROM (SELECT *, {t_two_sql('dm_hln', '(n - 1.0)')} AS p, {binom_two_sql('wins', 'n_folds')} AS ps FROM dm_v JOIN sg_v USING ({K}))""", "dm_v", "sg_v")


@query("family_tests_by_variant", with_parts(f"""SELECT split_part(a.series_id, '#', 1) AS series_id, split_part(a.series_id, '#', 2) AS roll_variant, a.horizon, a.pair, a.n, {rd('a.dm_hln', 5)} AS dm_hln, {rd('a.p', 6)} AS p_hln,
a.wins, a.n_folds, {rd('a.ps', 6)} AS p_sign, {rd('least(1.0, max((b.m - b.r + 1) * b.p) FILTER (WHERE b.r <= a.r))', 6)} AS p_hln_holm, {rd('least(1.0, min(b.m / b.r * b.p) FILTER (WHERE b.r >= a.r))', 6)} AS p_hln_bh,
{rd('least(1.0, min(b.m / b.r * b.p) FILTER (WHERE b.r >= a.r) * list_sum(list_transform(range(1, any_value(a.m) + 1), lambda i: 1.0 / i)))', 6)} AS p_hln_by
FROM p_v a JOIN p_v b ON a.series_id = b.series_id GROUP BY a.series_id, a.horizon, a.pair, a.n, a.dm_hln, a.p, a.wins, a.n_folds, a.ps""", "p_v"))
def family_tests_by_variant(spark, sf_dir):
    """DM, sign test and corrections inside each variant separately."""
    keys = ("series_id", "roll_variant", "horizon", "pair")
    d = stattests.loss_diff(variant_predictions(spark, sf_dir), [("har", "har_x")], ("series_id", "roll_variant", "horizon"))
    t = stattests.diebold_mariano(d, keys).join(stattests.sign_test(d, keys=keys), list(keys))
    t = stattests.adjust(t, "p_hln", ["series_id", "roll_variant"])
    return rounded(t.select(*keys, "n", "dm_hln", "p_hln", "wins", "n_folds", "p_sign", "p_hln_holm", "p_hln_bh", "p_hln_by"), 6, dm_hln=5)


@query("data_equalization", with_parts(f"""WITH t AS (SELECT * FROM train WHERE row_no >= 127),
s AS (SELECT series_id, horizon, test_year, count(*) AS n, avg(y) AS m FROM t GROUP BY ALL)
SELECT f.series_id, f.horizon, f.test_year, f.n_train, s.n AS n_train_equalized, {rd('100 * (s.m / f.train_mean - 1)', 6)} AS train_mean_pct FROM fold_stats f JOIN s USING (series_id, horizon, test_year)""", "train", "fold_stats"))
def data_equalization(spark, sf_dir):
    from volpanel.operators.models import align_start

    c = wf.coefficients(wf.level_rows(align_start(frame(spark, sf_dir), 127), H, ["series_id"]), {"har": C.HAR}, YEARS, ["series_id"])
    a = coefs(spark, sf_dir).filter("variant = 'har'").select("series_id", "horizon", "test_year", F.col("n").alias("n_train"), F.col("y_mean").alias("_m"))
    out = c.join(a, ["series_id", "horizon", "test_year"])
    return rounded(out.select("series_id", "horizon", "test_year", F.col("n_train").cast("long").alias("n_train"), F.col("n").cast("long").alias("n_train_equalized"),
                              (100 * (F.col("y_mean") / F.col("_m") - 1)).alias("train_mean_pct")), 6)


# --- variance grid ---------------------------------------------------------------------
def garch_fits(spark, sf_dir):
    f = frame(spark, sf_dir).select("series_id", "row_no", "year", "ret")
    table = fx.remember(spark, sf_dir, "garch_table", lambda: garch.decay_table(f))
    params = garch.fold_parameters(f, YEARS)
    fits = fx.remember(spark, sf_dir, "garch_fits", lambda: garch.fit_grid(table, params))
    return table, params, fits


part("gr", "SELECT series_id, row_no - 1 AS t, year, ret FROM rets WHERE ret IS NOT NULL", "rets")
part("gpar", "SELECT g.series_id, f.test_year, avg(ret) AS mu, var_pop(ret) AS v, count(*) AS n_train FROM gr g JOIN folds f ON g.series_id = f.series_id AND g.year < f.test_year GROUP BY ALL", "gr", "folds")
# the recursion itself, carried along the ordered list of squared shocks
part("gpath", f"""SELECT g.series_id, p.test_year, g.t, g.year, g.ret, p.mu, p.v, a.a AS alpha, b.b AS beta,
list_reduce(list_prepend(p.v, coalesce(list(pow(g.ret - p.mu, 2)) OVER (PARTITION BY g.series_id, p.test_year, a.a, b.b ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])),
  lambda s, e: (1 - a.a - b.b) * p.v + a.a * e + b.b * s) AS s2
FROM gr g JOIN gpar p ON g.series_id = p.series_id JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in garch.ALPHAS)}) a(a) ON true
JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in garch.BETAS)}) b(b) ON a.a + b.b < 0.999""", "gr", "gpar")
part("gfit", """SELECT series_id, test_year, arg_max(alpha, ll) AS alpha, arg_max(beta, ll) AS beta, max(ll) AS loglik FROM (
SELECT series_id, test_year, alpha, beta, sum(-0.5 * (ln(s2) + pow(ret - mu, 2) / s2)) AS ll FROM gpath WHERE year < test_year GROUP BY ALL) GROUP BY ALL""", "gpath")


@query("garch_grid", with_parts(f"SELECT series_id, test_year, alpha, beta, {rd('loglik', 5)} AS loglik, n_train FROM gfit JOIN gpar USING (series_id, test_year)", "gfit", "gpar"))
def garch_grid(spark, sf_dir):
    _, params, fits = garch_fits(spark, sf_dir)
    return rounded(fits.join(params.select("series_id", "test_year", "n_train"), ["series_id", "test_year"]), 5, "loglik")


@query("garch_forecast", with_parts(f"""SELECT t.series_id, t.horizon, t.test_year, CAST(t.obs_date AS VARCHAR) AS obs_date, {rd('t.y', 7)} AS y_true,
{rd('sqrt(g.v + list_sum(list_transform(range(2, t.horizon + 2), lambda j: pow(g.alpha + g.beta, j - 1))) / t.horizon * (g.s2 - g.v))', 7)} AS pred
FROM test t JOIN gfit f ON f.series_id = t.series_id AND f.test_year = t.test_year
JOIN gpath g ON g.series_id = t.series_id AND g.test_year = t.test_year AND g.alpha = f.alpha AND g.beta = f.beta AND g.t = t.row_no - 1""", "test", "gfit", "gpath"))
def garch_forecast(spark, sf_dir):
    table, params, fits = garch_fits(spark, sf_dir)
    t = folds.test_rows(rows(spark, sf_dir), YEARS, PARTIAL).filter(folds.complete(C.HAR)).select("series_id", "row_no", "horizon", "test_year", "obs_date", F.col("y").alias("y_true"))
    out = garch.forecast(table, fits, params, t.withColumnRenamed("obs_date", "day").withColumnRenamed("day", "t_date"))
    return rounded(out.select("series_id", "horizon", "test_year", F.col("t_date").alias("obs_date"), "y_true", "pred"), 7)
