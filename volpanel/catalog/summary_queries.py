"""Summaries next to the main tables: families, fold correlations, low forecasts, revisions, decay of dependence."""

from pyspark.sql import functions as F

from volpanel.catalog import calendar_queries as cq
from volpanel.catalog import window_queries as wq
from volpanel.catalog.forecast_queries import fold_table, level, means
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import rd, with_parts
from volpanel.catalog.test_queries import losses
from volpanel.operators import metrics
from volpanel.operators import stattests as st
from volpanel.operators import vintages as vt

FAMILY, NAIVE = ["har", "har_implied", "har_index", "har_x"], ["train_mean", "past_vol"]
_LOSS = "(y_true / pred) ** 2 - ln((y_true / pred) ** 2) - 1"


def _names(models):
    return ", ".join(f"'{m}'" for m in models)


@query("best_in_family", with_parts(f"""WITH f AS (SELECT series_id, horizon, arg_min(model, rmse_fold_mean) AS m, min(rmse_fold_mean) AS v FROM means WHERE model IN ({_names(FAMILY)}) GROUP BY ALL),
r AS (SELECT series_id, horizon, arg_min(model, rmse_fold_mean) AS m, min(rmse_fold_mean) AS v FROM means WHERE model IN ({_names(NAIVE)}) GROUP BY ALL)
SELECT series_id, horizon, f.m AS best_family, {rd('f.v', 6)} AS family_value, r.m AS best_reference, {rd('r.v', 6)} AS reference_value,
{rd('100 * (f.v / r.v - 1)', 5)} AS pct FROM f JOIN r USING (series_id, horizon)""", "means"))
def best_in_family(spark, sf_dir):
    return rounded(metrics.best_in_family(means(spark, sf_dir), FAMILY, NAIVE), 6, pct=5)


@query("fold_correlation", with_parts(f"""SELECT h.series_id, h.horizon, count(*) AS n_folds, {rd('corr(h.rmse, p.rmse)', 5)} AS fold_corr,
{rd('corr(h.rmse / t.rmse, p.rmse / t.rmse)', 5)} AS relative_corr FROM fm h JOIN fm p USING (series_id, horizon, test_year) JOIN fm t USING (series_id, horizon, test_year)
WHERE h.model = 'har' AND p.model = 'past_vol' AND t.model = 'train_mean' AND h.include_in_main GROUP BY ALL""", "fm"))
def fold_correlation(spark, sf_dir):
    return rounded(metrics.fold_correlation(fold_table(spark, sf_dir), "har", "past_vol", "train_mean"), 5)


@query("near_floor", with_parts(f"""WITH r AS (SELECT *, {_LOSS} AS l, pred / floor AS k FROM preds WHERE include_in_main)
SELECT series_id, model, horizon, count(*) AS n, count(*) FILTER (WHERE k <= 1.25) AS n_near, {rd('min(k)', 6)} AS ratio_min, {rd('max(k)', 6)} AS ratio_max,
{rd('100 * coalesce(sum(l) FILTER (WHERE k <= 1.25), 0) / sum(l)', 5)} AS near_share_pct, {rd('avg(l)', 6)} AS loss_all, {rd('avg(l) FILTER (WHERE k > 1.25)', 6)} AS loss_without
FROM r GROUP BY ALL""", "preds"))
def near_floor(spark, sf_dir):
    return rounded(metrics.near_floor(level(spark, sf_dir), metrics.qlike()), 6, near_share_pct=5)


def _low_sql(factor: float) -> str:
    return with_parts(f"""WITH r AS (SELECT a.series_id, a.horizon, a.test_year, a.l AS la, b.l AS lb, a.pred < {factor} * b.pred AS low FROM
(SELECT *, {_LOSS} AS l FROM p_har_x WHERE include_in_main) a JOIN (SELECT *, {_LOSS} AS l FROM p_har) b USING (series_id, horizon, obs_date)),
y AS (SELECT series_id, horizon, test_year, count(*) FILTER (WHERE low) AS k, avg(la) FILTER (WHERE NOT low) AS ma, avg(lb) FILTER (WHERE NOT low) AS mb FROM r GROUP BY ALL),
z AS (SELECT series_id, horizon, coalesce(string_agg(test_year || ' (' || k || ')', ', ' ORDER BY test_year) FILTER (WHERE k > 0), '') AS low_years, avg(ma) AS fa, avg(mb) AS fb FROM y GROUP BY ALL)
SELECT r.series_id, r.horizon, count(*) AS n, count(*) FILTER (WHERE low) AS n_low, z.low_years, {rd('sum(la - lb)', 5)} AS difference,
{rd('coalesce(sum(la - lb) FILTER (WHERE low), 0)', 5)} AS low_difference, {rd('avg(la) FILTER (WHERE NOT low)', 6)} AS pooled_a, {rd('avg(lb) FILTER (WHERE NOT low)', 6)} AS pooled_b,
{rd('z.fa', 6)} AS fold_mean_a, {rd('z.fb', 6)} AS fold_mean_b FROM r JOIN z USING (series_id, horizon) GROUP BY r.series_id, r.horizon, z.low_years, z.fa, z.fb""", "p_har_x", "p_har")


@query("markedly_low", _low_sql(0.5))
def markedly_low(spark, sf_dir):
    """HAR-X below half of HAR; the share of the difference follows from two returned columns."""
    p = level(spark, sf_dir).filter("include_in_main and model in ('har', 'har_x')")
    wide = p.withColumn("l", metrics.qlike()).groupBy("series_id", "horizon", "test_year", "obs_date").agg(*[
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{n}_{x}") for m, x in (("har_x", "a"), ("har", "b")) for c, n in (("pred", "pred"), ("l", "loss"))])
    out = metrics.markedly_low(wide).drop("low_share_pct")
    return rounded(out, 6, difference=5, low_difference=5)


BY = {"all": "'all'", "lag": "CAST(lag_days AS VARCHAR)", "year": "CAST(year(obs_date) AS VARCHAR)"}


@query("revisions_by", with_parts("WITH x AS (SELECT *, (current - first_value) / current AS r FROM frel) " + " UNION ALL ".join(
    f"""SELECT series_id, '{name}' AS grouping, {sql} AS value, count(*) AS n, {rd('avg(r)', 8)} AS mean, {rd('median(r)', 8)} AS median, {rd('avg(abs(r))', 8)} AS mean_abs,
{rd('median(abs(r))', 8)} AS median_abs, {rd('max(abs(r))', 8)} AS max_abs, CAST(min(lag_days) AS INT) AS lag_min, median(lag_days) AS lag_median, CAST(max(lag_days) AS INT) AS lag_max
FROM x GROUP BY 1, 2, 3""" for name, sql in BY.items()), "frel"))
def revisions_by(spark, sf_dir):
    """Overall, by publication lag and by year: each row once per grouping, summed before the shuffle."""
    groups = F.array(*[F.struct(F.lit(n).alias("grouping"), v.cast("string").alias("value")) for n, v in (
        ("all", F.lit("all")), ("lag", F.col("lag_days")), ("year", F.year("obs_date")))])
    fr = cq.first(spark, sf_dir).select("*", F.inline(groups))
    return rounded(vt.revision_summary(fr, "series_id", "grouping", "value"), 8, "mean", "median", "mean_abs", "median_abs", "max_abs")


@query("mean_acf", with_parts(f"""WITH v AS (SELECT series_id, horizon, pair, count(*) AS n, avg(x * x) AS g0 FROM nx_d WHERE pair = 'har|har_x' GROUP BY ALL),
s AS (SELECT a.series_id, a.horizon, a.pair, sum(a.x * b.x) AS s FROM nx_d a JOIN nx_d b USING (series_id, horizon, pair)
WHERE a.pair = 'har|har_x' AND a.i - b.i BETWEEN a.horizon AND 2 * a.horizon GROUP BY ALL)
SELECT series_id, horizon, pair, n, CASE WHEN least(2 * horizon, n - 1) >= horizon THEN least(2 * horizon, n - 1) - horizon + 1 END AS n_lags,
{rd('coalesce(s, 0) / (n * g0 * CASE WHEN least(2 * horizon, n - 1) >= horizon THEN least(2 * horizon, n - 1) - horizon + 1 END)', 6)} AS acf_mean FROM v LEFT JOIN s USING (series_id, horizon, pair)""", "nx_d"))
def mean_acf(spark, sf_dir):
    d = st.number_days(losses(spark, sf_dir).filter("pair = 'har|har_x'"))
    return rounded(st.mean_acf(d, "d", F.col("horizon"), 2 * F.col("horizon")), 6)


@query("ratio_summary", with_parts(f"""SELECT series_id, {rd('min(r)', 6)} AS min, {rd('median(r)', 6)} AS median, {rd('max(r)', 6)} AS max, count(*) - count(r) AS n_null,
{rd('min(price_vol20)', 8)} AS smallest_base FROM (SELECT *, price_vol5 / (price_vol20 + 1e-9) AS r FROM har) GROUP BY series_id""", "har"))
def ratio_summary(spark, sf_dir):
    """Range of the volatility ratio: what its guard against a zero base does."""
    f = wq.features(spark, sf_dir).groupBy("series_id").agg(
        F.min("vol_ratio").alias("min"), F.median("vol_ratio").alias("median"), F.max("vol_ratio").alias("max"),
        F.count_if(F.col("vol_ratio").isNull()).alias("n_null"), F.min("price_vol20").alias("smallest_base"))
    return rounded(f, 6, smallest_base=8)
