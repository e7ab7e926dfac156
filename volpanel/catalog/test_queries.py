"""Forecast comparison tests."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from volpanel.catalog import fixtures as fx
from volpanel.catalog import forecast_sql as fs
from volpanel.catalog.forecast_queries import fold_table, frame, level, means
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.functions import tails
from volpanel.operators import descriptive
from volpanel.operators import stattests as st

PAIRS = [("har", "har_x"), ("har_x", "past_vol"), ("har", "past_vol"), ("har_x", "train_mean"), ("har", "har_implied")]
PRIMARY = PAIRS[:2]
NESTED = [("har", "har_implied"), ("har", "har_index"), ("har", "har_x")]
K = "series_id, horizon, pair"


def losses(spark, sf_dir):
    return fx.remember(spark, sf_dir, "losses", lambda: st.loss_diff(level(spark, sf_dir), PAIRS))


def nested(spark, sf_dir):
    return fx.remember(spark, sf_dir, "nested_losses", lambda: st.loss_diff(level(spark, sf_dir), NESTED))


def dm(spark, sf_dir):
    def build():
        from volpanel.plans.comparison import comparison_table

        return comparison_table(level(spark, sf_dir), PAIRS, PRIMARY)
    return fx.remember(spark, sf_dir, "dm_tests", build)


def _pairs_sql(pairs):
    return " UNION ALL ".join(f"""SELECT a.series_id, a.horizon, '{x}|{y}' AS pair, a.test_year, a.obs_date, a.row_no, a.y_true, a.pred AS p1, b.pred AS p2,
a.y_true - a.pred AS e1, b.y_true - b.pred AS e2, (a.y_true - a.pred) ** 2 - (b.y_true - b.pred) ** 2 AS d,
(a.y_true - a.pred) ** 2 - (b.y_true - b.pred) ** 2 + (a.pred - b.pred) ** 2 AS f
FROM preds a JOIN preds b USING (series_id, horizon, obs_date) WHERE a.model = '{x}' AND b.model = '{y}' AND a.include_in_main""" for x, y in pairs)


def nw_parts(tag, source, value):
    """Sample autocovariances lag by lag, weighted 1 - j/(L+1)."""
    part(f"nx_{tag}", f"""SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY obs_date) AS i,
{value} - avg({value}) OVER (PARTITION BY {K}) AS x, count(*) OVER (PARTITION BY {K}) AS n FROM {source}""", source)
    part(f"ng_{tag}", f"""SELECT a.series_id, a.horizon, a.pair, a.i - b.i AS j, sum(a.x * b.x) / any_value(a.n) AS g
FROM nx_{tag} a JOIN nx_{tag} b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.pair = b.pair
AND a.i - b.i BETWEEN 0 AND a.horizon - 1 GROUP BY ALL""", f"nx_{tag}")
    part(f"nw_{tag}", f"""SELECT {K}, max(g) FILTER (WHERE j = 0) AS gamma0,
max(g) FILTER (WHERE j = 0) + coalesce(sum(2 * (1 - j / horizon) * g) FILTER (WHERE j > 0), 0) AS omega FROM ng_{tag} GROUP BY ALL""", f"ng_{tag}")


def simpson(f: str, top: str, n: int = 2000) -> str:
    """Integral of f(u) over [0, top]; f uses {u}."""
    u = f"({top}) * k / {n}.0"
    w = f"CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"({top}) / {n * 3}.0 * list_sum(list_transform(range(0, {n + 1}), lambda k: ({w}) * ({f.format(u=u)})))"


def t_two_sql(t: str, df: str) -> str:
    c = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    area = simpson(f"pow(1 + ({{u}}) * ({{u}}) / {df}, -({df} + 1) / 2.0)", f"least(abs({t}), 40)")
    return f"greatest(0, 1 - 2 * ({c}) * ({area}))"


def phi_sql(z: str) -> str:
    area = simpson("exp(-({u}) * ({u}) / 2)", f"least(abs({z}), 40)")
    return f"(0.5 + sign({z}) * ({area}) / sqrt(2 * pi()))"


def binom_two_sql(k: str, n: str) -> str:
    kk = f"least({k}, {n} - {k})"
    terms = (f"list_sum(list_transform(range(0, CAST({kk} + 1 AS BIGINT)), lambda i: "
             f"exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0))))")
    return f"CASE WHEN {n} > 0 THEN least(1.0, 2 * ({terms}) * pow(0.5, {n})) END"


part("pl", _pairs_sql(PAIRS), "preds")
part("pn", _pairs_sql(NESTED), "preds")
nw_parts("d", "pl", "d")
nw_parts("f", "pn", "f")
HLN = "sqrt(greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, 1e-12))"
part("dmt", f"""SELECT *, mean / sqrt(greatest(omega, 1e-300) / n) AS dm, mean / sqrt(gamma0 / n) AS dm_naive, omega / gamma0 AS inflation,
{HLN} AS hln, rmse1 / rmse2 AS rmse_ratio, mean / sqrt(greatest(omega, 1e-300) / n) * {HLN} AS dm_hln
FROM (SELECT {K}, count(*) AS n, avg(d) AS mean, sqrt(avg(e1 ** 2)) AS rmse1, sqrt(avg(e2 ** 2)) AS rmse2 FROM pl GROUP BY ALL)
JOIN nw_d USING ({K})""", "pl", "nw_d")
part("foldpair", f"SELECT {K}, test_year, sqrt(avg(e1 ** 2)) AS a, sqrt(avg(e2 ** 2)) AS b FROM pl GROUP BY ALL", "pl")
part("signt", f"""SELECT *, {binom_two_sql('wins', 'n_folds')} AS p_sign FROM (
SELECT {K}, count(*) AS n_folds, count(*) FILTER (WHERE a < b) AS wins, count(*) FILTER (WHERE a = b) AS ties FROM foldpair GROUP BY ALL)""", "foldpair")
_prim = ", ".join(f"'{a}|{b}'" for a, b in PRIMARY)
part("dmfam", f"""SELECT *, {t_two_sql('dm_hln', '(n - 1.0)')} AS p_hln,
CASE WHEN pair IN ({_prim}) THEN 'primary' ELSE 'secondary' END AS family FROM dmt JOIN signt USING ({K})""", "dmt", "signt")


@query("loss_differences", with_parts(
    f"SELECT {K}, test_year, CAST(obs_date AS VARCHAR) AS obs_date, {rd('d', 7)} AS d FROM pl", "pl"))
def loss_differences(spark, sf_dir):
    return rounded(losses(spark, sf_dir).select(*st.KEYS, "test_year", "obs_date", "d"), 7)


@query("newey_west", with_parts(f"SELECT {K}, {rd('gamma0 * 1000', 6)} AS gamma0, {rd('omega * 1000', 6)} AS omega FROM nw_d", "nw_d"))
def newey_west(spark, sf_dir):
    v = st.long_run_variance(losses(spark, sf_dir))
    return rounded(v.select(*st.KEYS, (F.col("gamma0") * 1000).alias("gamma0"), (F.col("omega") * 1000).alias("omega")), 6)


@query("diebold_mariano", with_parts(f"SELECT {K}, n, " + ", ".join(f"{rd(c, 5)} AS {c}" for c in (
    "rmse1", "rmse2", "rmse_ratio", "dm", "dm_naive", "inflation", "hln", "dm_hln")) + f""",
{rd('p_hln', 6)} AS p_hln, {rd('2 * ' + phi_sql('-abs(dm)'), 6)} AS p_normal FROM dmfam""", "dmfam"))
def diebold_mariano(spark, sf_dir):
    t = dm(spark, sf_dir)
    return rounded(t.select(*st.KEYS, "n", "rmse1", "rmse2", "rmse_ratio", "dm", "dm_naive", "inflation", "hln",
                            "dm_hln", "p_hln", "p_normal"), 5, p_hln=6, p_normal=6)


part("cwt", f"""SELECT *, f_mean / sqrt(greatest(omega, 1e-300) / n) AS cw, f_mean / sqrt(greatest(omega, 1e-300) / n) * {HLN} AS cw_hln
FROM (SELECT {K}, count(*) AS n, avg(f) AS f_mean, avg(e1 ** 2) AS mse1, avg(e2 ** 2) AS mse2 FROM pn GROUP BY ALL) JOIN nw_f USING ({K})
JOIN (SELECT {K}, count(*) AS n_folds, avg(m) AS f_fold_mean, count(*) FILTER (WHERE m > 0) AS folds_f_positive FROM (
SELECT {K}, test_year, avg(f) AS m FROM pn GROUP BY ALL) GROUP BY ALL) USING ({K})""", "pn", "nw_f")


@query("clark_west", with_parts(f"""SELECT {K}, n, n_folds, folds_f_positive, """ + ", ".join(f"{rd(c, 6)} AS {c}" for c in (
    "mse1", "mse2", "f_fold_mean")) + f""", {rd('cw', 5)} AS cw, {rd('cw_hln', 5)} AS cw_hln,
{rd(f"CASE WHEN cw_hln >= 0 THEN 0.5 * ({t_two_sql('cw_hln', '(n - 1.0)')}) ELSE 1 - 0.5 * ({t_two_sql('cw_hln', '(n - 1.0)')}) END", 6)} AS p_hln FROM cwt""", "cwt"))
def clark_west(spark, sf_dir):
    t = st.clark_west(nested(spark, sf_dir))
    return rounded(t.select(*st.KEYS, "n", "n_folds", "folds_f_positive", "mse1", "mse2", "f_fold_mean", "cw", "cw_hln", "p_hln"),
                   6, cw=5, cw_hln=5)


part("acfs", f"""SELECT a.series_id, a.horizon, a.pair, l.lag, sum(a.x * b.x) / any_value(v.n * v.g0) AS acf, any_value(v.n) AS n
FROM nx_d a JOIN (SELECT DISTINCT horizon, unnest([1, greatest(1, (horizon - 1) // 2), horizon - 1, horizon, 2 * (horizon - 1)]) AS lag
  FROM nx_d) l ON a.horizon = l.horizon
JOIN (SELECT {K}, count(*) AS n, avg(x * x) AS g0 FROM nx_d GROUP BY ALL) v
  ON a.series_id = v.series_id AND a.horizon = v.horizon AND a.pair = v.pair
JOIN nx_d b ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.pair = b.pair AND b.i = a.i - l.lag GROUP BY ALL""", "nx_d")


@query("acf_of_loss_difference", with_parts(
    f"SELECT {K}, CAST(lag AS INT) AS lag, {rd('acf', 6)} AS acf FROM acfs WHERE pair = 'har|har_x'", "acfs"))
def acf_of_loss_difference(spark, sf_dir):
    d = st.number_days(losses(spark, sf_dir).filter("pair = 'har|har_x'"))
    h = F.col("horizon")
    lags = F.array_distinct(F.array(F.lit(1), F.greatest(F.lit(1), F.floor((h - 1) / 2).cast("int")), h - 1, h, 2 * (h - 1)))
    return rounded(st.acf(d, "d", lags, st.KEYS).select(*st.KEYS, F.col("lag").cast("int").alias("lag"), "acf"), 6)


@query("sign_test", with_parts(f"""SELECT {K}, n_folds, wins, ties, {rd('p_sign', 8)} AS p_sign,
{rd(binom_two_sql('wins', '(n_folds - ties)'), 8)} AS p_sign_ties_dropped FROM signt""", "signt"))
def sign_test(spark, sf_dir):
    a = st.sign_test(losses(spark, sf_dir))
    b = a.withColumn("p_sign_ties_dropped", st.binomial_two_sided(F.col("wins"), F.col("n_folds") - F.col("ties")))
    return rounded(b, 8)


part("adjp", f"""SELECT {K}, family, p_hln AS p, row_number() OVER w AS r, count(*) OVER (PARTITION BY series_id, family) AS m FROM dmfam
WINDOW w AS (PARTITION BY series_id, family ORDER BY p_hln, series_id, horizon, pair)""", "dmfam")
part("adjo", f"""SELECT a.series_id, a.horizon, a.pair, a.family, a.p,
least(1.0, max((b.m - b.r + 1) * b.p) FILTER (WHERE b.r <= a.r)) AS holm, least(1.0, min(b.m / b.r * b.p) FILTER (WHERE b.r >= a.r)) AS bh,
least(1.0, min(b.m / b.r * b.p) FILTER (WHERE b.r >= a.r) * list_sum(list_transform(range(1, any_value(a.m) + 1), lambda i: 1.0 / i))) AS by_
FROM adjp a JOIN adjp b ON a.series_id = b.series_id AND a.family = b.family GROUP BY a.series_id, a.horizon, a.pair, a.family, a.p""", "adjp")


@query("adjusted_p_values", with_parts(f"SELECT {K}, family, {rd('p', 6)} AS p_hln, {rd('holm', 6)} AS p_hln_holm, {rd('bh', 6)} AS p_hln_bh, {rd('by_', 6)} AS p_hln_by FROM adjo", "adjo"))
def adjusted_p_values(spark, sf_dir):
    return rounded(dm(spark, sf_dir).select(*st.KEYS, "family", "p_hln", "p_hln_holm", "p_hln_bh", "p_hln_by"), 6)


@query("family_labels", with_parts("""SELECT series_id, family, count(*) AS n_tests, count(*) FILTER (WHERE p < 0.05) AS n_raw,
count(*) FILTER (WHERE holm < 0.05) AS n_holm, count(*) FILTER (WHERE bh < 0.05) AS n_bh, count(*) FILTER (WHERE by_ < 0.05) AS n_by,
count(*) FILTER (WHERE p < 0.01) AS n_three_stars FROM adjo GROUP BY ALL""", "adjo"))
def family_labels(spark, sf_dir):
    t = dm(spark, sf_dir).withColumn("stars", st.stars("p_hln"))
    return t.groupBy("series_id", "family").agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("p_hln") < 0.05).alias("n_raw"),
        F.count_if(F.col("p_hln_holm") < 0.05).alias("n_holm"), F.count_if(F.col("p_hln_bh") < 0.05).alias("n_bh"),
        F.count_if(F.col("p_hln_by") < 0.05).alias("n_by"), F.count_if(F.col("stars") == "***").alias("n_three_stars"))


@query("direction_agreement", with_parts(f"""SELECT {K}, CAST(CASE WHEN dm_hln < 0 THEN 1 ELSE 2 END AS INT) AS dm_side,
CAST(CASE WHEN wins > n_folds / 2 THEN 1 ELSE 2 END AS INT) AS sign_side,
CAST(CASE WHEN dm_hln < 0 THEN 1 ELSE 2 END = CASE WHEN wins > n_folds / 2 THEN 1 ELSE 2 END AS INT) AS agree,
CAST(p_hln < 0.05 AND p_sign < 0.05 AS INT) AS both_significant FROM dmfam""", "dmfam"))
def direction_agreement(spark, sf_dir):
    return dm(spark, sf_dir).select(*st.KEYS, "dm_side", "sign_side", "agree", "both_significant")


@query("carrying_years", with_parts(f"""WITH x AS (SELECT *, a - b AS delta, avg(a - b) OVER (PARTITION BY {K}) AS mean_delta FROM foldpair)
SELECT {K}, test_year, {rd('delta', 7)} AS delta, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY abs(delta) DESC, test_year) AS rank FROM x WHERE sign(delta) = sign(mean_delta)) WHERE rank <= 3""", "foldpair"))
def carrying_years(spark, sf_dir):
    return rounded(st.carrying_years(losses(spark, sf_dir)).select(*st.KEYS, "test_year", "delta", "rank"), 7)


NEED = "(1.959963984540054 + 0.8416212335729143)"
part("rpy", "SELECT series_id, avg(c) AS rows_per_year FROM (SELECT series_id, test_year, count(*) AS c FROM test WHERE include_in_main AND horizon = 5 GROUP BY ALL) GROUP BY ALL", "test")


@query("dm_power", with_parts(f"""SELECT {K}, {rd('n / horizon', 6)} AS blocks, {rd('abs(dm_hln) / sqrt(n / horizon)', 6)} AS effect_per_block,
{rd(phi_sql('-1.959963984540054 + abs(dm_hln)') + ' + ' + phi_sql('-1.959963984540054 - abs(dm_hln)'), 6)} AS achieved_power,
{rd(f'log10(pow({NEED} / (abs(dm_hln) / sqrt(n / horizon)), 2))', 5)} AS log_required_blocks,
{rd(f'log10(pow({NEED} / (abs(dm_hln) / sqrt(n / horizon)), 2) * horizon / rows_per_year)', 5)} AS log_required_years
FROM dmfam JOIN rpy USING (series_id) WHERE family = 'primary'""", "dmfam", "rpy"))
def dm_power(spark, sf_dir):
    t = dm(spark, sf_dir).filter("family = 'primary'")
    rpy = (level(spark, sf_dir).filter("include_in_main and horizon = 5 and model = 'har'").groupBy("series_id", "test_year")
           .count().groupBy("series_id").agg(F.avg("count").alias("rows_per_year")))
    out = st.required_sample(t.join(rpy, "series_id"), F.col("rows_per_year"))
    return rounded(out.select(*st.KEYS, "blocks", "effect_per_block", "achieved_power",
                              F.log10("required_blocks").alias("log_required_blocks"),
                              F.log10("required_years").alias("log_required_years")), 6,
                   log_required_blocks=5, log_required_years=5)


@query("sign_power", with_parts(f"""WITH c AS (SELECT *, wins / n_folds AS p FROM signt),
g AS (SELECT c.*, k.k, exp(lgamma(n_folds + 1.0) - lgamma(k.k + 1.0) - lgamma(n_folds - k.k + 1.0)) AS ways, {binom_two_sql('k.k', 'n_folds')} AS pv
  FROM c JOIN range(0, 40) k(k) ON k.k <= n_folds)
SELECT {K}, n_folds, wins, CAST(min(k) FILTER (WHERE pv <= 0.05 AND k > n_folds / 2) AS INT) AS min_wins,
{rd("coalesce(sum(ways * pow(p, k) * pow(1 - p, n_folds - k)) FILTER (WHERE pv <= 0.05), 0)", 7)} AS achieved_power FROM g GROUP BY ALL""", "signt"))
def sign_power(spark, sf_dir):
    out = st.sign_power(dm(spark, sf_dir))
    return rounded(out.select(*st.KEYS, "n_folds", "wins", "min_wins", "achieved_power"), 7)


@query("sign_required_folds", with_parts(f"""WITH b AS (SELECT n.n, k.k, exp(lgamma(n.n + 1.0) - lgamma(k.k + 1.0) - lgamma(n.n - k.k + 1.0) + n.n * ln(0.5)) AS half,
lgamma(n.n + 1.0) - lgamma(k.k + 1.0) - lgamma(n.n - k.k + 1.0) AS lways FROM range(1, 161) n(n) JOIN range(0, 161) k(k) ON k.k <= n.n),
u AS (SELECT n, k, 2 * sum(half) OVER (PARTITION BY n ORDER BY k) AS p2 FROM b),
c AS (SELECT n, max(k) AS crit FROM u WHERE p2 <= 0.05 AND k < n / 2 GROUP BY n),
s AS (SELECT DISTINCT n_folds, wins, wins / n_folds AS p FROM signt),
w AS (SELECT s.n_folds, s.wins, b.n, sum(exp(b.lways) * pow(s.p, b.k) * pow(1 - s.p, b.n - b.k)) AS power
 FROM s JOIN b ON b.n >= greatest(s.n_folds, 5) JOIN c ON c.n = b.n AND (b.k <= c.crit OR b.k >= b.n - c.crit) WHERE abs(s.p - 0.5) > 1e-9 GROUP BY ALL)
SELECT {K}, n_folds, wins, CAST(r.n AS INT) AS required_folds FROM signt LEFT JOIN (SELECT n_folds, wins, min(n) AS n FROM w WHERE power >= 0.8 GROUP BY ALL) r USING (n_folds, wins)""", "signt"))
def sign_required_folds(spark, sf_dir):
    out = st.sign_power(dm(spark, sf_dir))
    return out.select(*st.KEYS, "n_folds", "wins", "required_folds")


_size = "sqrt(blocks) * abs(pow(1 - effect, 2) - 1)"


@query("power_calibration", with_parts(f"""WITH k AS (SELECT series_id, horizon, avg(k) AS k_mean, min(k) AS k_min, max(k) AS k_max, avg(n / horizon) AS blocks
 FROM (SELECT *, (dm_hln / sqrt(n / horizon)) / (pow(rmse_ratio, 2) - 1) AS k FROM dmfam WHERE family = 'primary') GROUP BY ALL)
SELECT series_id, horizon, effect, {rd('k_mean', 5)} AS k_mean, """ + ", ".join(
    rd(phi_sql(f'-1.959963984540054 + {_size} * k_{s}') + ' + ' + phi_sql(f'-1.959963984540054 - {_size} * k_{s}'), 6) + f" AS power_{s}"
    for s in ("mean", "min", "max")) + " FROM k CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (0.1), (0.2)) e(effect)", "dmfam"))
def power_calibration(spark, sf_dir):
    out = st.power_calibration(dm(spark, sf_dir).filter("family = 'primary'"))
    return rounded(out.select("series_id", "horizon", "effect", "k_mean", "power_mean", "power_min", "power_max"), 6, k_mean=5)


part("fd", "SELECT series_id, horizon, test_year, " + ", ".join(
    f"max(rmse) FILTER (WHERE model = '{m}') AS r_{m}" for m in ("har", "har_x", "past_vol")) + " FROM fm WHERE include_in_main GROUP BY ALL", "fm")


def fold_diffs(spark, sf_dir):
    from volpanel.operators.metrics import pivot_models

    f = fold_table(spark, sf_dir).filter("include_in_main")
    w = pivot_models(f, ["har", "har_x", "past_vol"], "rmse", ["series_id", "horizon", "test_year"])
    return w.withColumns({"a": F.col("har_x") - F.col("har"), "b": F.col("past_vol") - F.col("har")})


@query("fold_diff_dependence", with_parts(f"""WITH d AS (SELECT series_id, horizon, r_har_x - r_har AS a, r_past_vol - r_har AS b FROM fd),
r AS (SELECT *, rank() OVER (PARTITION BY series_id, horizon ORDER BY a) AS ra, rank() OVER (PARTITION BY series_id, horizon ORDER BY b) AS rb FROM d)
SELECT series_id, horizon, count(*) AS n_folds, {rd('corr(a, b)', 6)} AS pearson, {rd('corr(ra, rb)', 6)} AS spearman,
count(*) FILTER (WHERE sign(a) = sign(b)) AS same_sign FROM r GROUP BY ALL""", "fd"))
def fold_diff_dependence(spark, sf_dir):
    return rounded(st.fold_diff_dependence(fold_diffs(spark, sf_dir), "a", "b", ["series_id", "horizon"]), 6)


@query("rank_correlations", with_parts(f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY series_id, horizon ORDER BY rmse_fold_mean) AS ra,
rank() OVER (PARTITION BY series_id, horizon ORDER BY mae_fold_mean) AS rb FROM means),
t AS (SELECT a.series_id, a.horizon, sum(sign(a.ra - b.ra) * sign(a.rb - b.rb)) AS s, sum(abs(sign(a.ra - b.ra))) AS u, sum(abs(sign(a.rb - b.rb))) AS v
 FROM r a JOIN r b USING (series_id, horizon) GROUP BY ALL)
SELECT r.series_id, r.horizon, {rd('corr(ra, rb)', 6)} AS spearman, count(*) AS n, {rd('any_value(s / sqrt(u * v))', 6)} AS kendall_tau
FROM r JOIN t USING (series_id, horizon) GROUP BY ALL""", "means"))
def rank_correlations(spark, sf_dir):
    return rounded(st.rank_correlation(means(spark, sf_dir), "rmse_fold_mean", "mae_fold_mean", ["series_id", "horizon"]), 6)


@query("fold_delta_summary", with_parts(f"""WITH d AS (
SELECT series_id, horizon, test_year, 'rmse' AS measure, max(rmse) FILTER (WHERE model = 'har_x') - max(rmse) FILTER (WHERE model = 'har_implied') AS d FROM fm WHERE include_in_main GROUP BY ALL
UNION ALL SELECT series_id, horizon, test_year, 'mae', max(mae) FILTER (WHERE model = 'har_x') - max(mae) FILTER (WHERE model = 'har_implied') FROM fm WHERE include_in_main GROUP BY ALL),
s AS (SELECT series_id, horizon, measure, count(*) AS n_folds, count(*) FILTER (WHERE d > 0) AS wins_a, count(*) FILTER (WHERE d < 0) AS wins_b,
count(*) FILTER (WHERE d = 0) AS ties, avg(d) AS m, median(d) AS md, max(d) AS mx, arg_max(test_year, d) AS year_of_max, (sum(d) - max(d)) / nullif(count(*) - 1, 0) AS mw FROM d GROUP BY ALL)
SELECT series_id, horizon, measure, n_folds, wins_a, wins_b, ties, {rd('m', 7)} AS mean_delta, {rd('md', 7)} AS median_delta, {rd('mx', 7)} AS max_delta,
year_of_max, {rd('mw', 7)} AS mean_without_worst, {rd(binom_two_sql('wins_a', '(wins_a + wins_b)'), 7)} AS p_sign FROM s""", "fm"))
def fold_delta_summary(spark, sf_dir):
    return rounded(st.fold_delta_summary(fold_table(spark, sf_dir), "har_implied", "har_x"), 7)


@query("fold_winners", with_parts(f"""SELECT series_id, horizon, test_year, {rd('r_har', 7)} AS rmse_a, {rd('r_har_x', 7)} AS rmse_b, {rd('r_har_x - r_har', 7)} AS delta,
CASE WHEN r_har_x > r_har THEN 'har' WHEN r_har_x < r_har THEN 'har_x' ELSE 'tie' END AS winner FROM fd""", "fd"))
def fold_winners(spark, sf_dir):
    return rounded(st.fold_winners(fold_table(spark, sf_dir), "har", "har_x"), 7)


# --- descriptive statistics -------------------------------------------------
VARS = ("price", "implied", "idx_a", "idx_b", "ret")
part("vals", " UNION ALL ".join(f"SELECT series_id, '{v}' AS variable, row_no AS i, CAST({v} AS DOUBLE) AS x FROM rets WHERE {v} IS NOT NULL" for v in VARS), "rets")


def values(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.select("series_id", F.col("row_no").alias("i"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in VARS]))).filter("x is not null")



@query("descriptive_stats", with_parts(f"""SELECT series_id, variable, count(*) AS n, {rd('avg(x)', 3)} AS mean, {rd('stddev_samp(x)', 3)} AS std, {rd('min(x) + 0.0000314159265', 2)} AS min, {rd('max(x) + 0.0000314159265', 2)} AS max,
{rd('skewness(x)', 6)} AS skew, {rd('kurtosis(x)', 6)} AS excess_kurtosis FROM vals GROUP BY ALL""", "vals"))
def descriptive_stats(spark, sf_dir):
    from volpanel.operators.descriptive import descriptive_stats as describe

    out = describe(values(spark, sf_dir), "x", ["series_id", "variable"])
    out = out.withColumns({c: F.col(c) + 0.0000314159265 for c in ("min", "max")})
    return rounded(out, 6, mean=3, std=3, min=2, max=2)


part("dense", "SELECT series_id, variable, x - avg(x) OVER (PARTITION BY series_id, variable) AS x, row_number() OVER (PARTITION BY series_id, variable ORDER BY i) AS i FROM vals", "vals")
part("rho", """SELECT a.series_id, a.variable, a.i - b.i AS lag, sum(a.x * b.x) / any_value(v.ss) AS acf, any_value(v.n) AS n FROM dense a
JOIN dense b ON a.series_id = b.series_id AND a.variable = b.variable AND a.i - b.i BETWEEN 1 AND 20
JOIN (SELECT series_id, variable, sum(x * x) AS ss, count(*) AS n FROM dense GROUP BY ALL) v ON a.series_id = v.series_id AND a.variable = v.variable GROUP BY ALL""", "dense")


@query("autocorrelation", with_parts(f"SELECT series_id, variable, CAST(lag AS INT) AS lag, {rd('acf', 6)} AS acf FROM rho WHERE lag IN (1, 5, 20)", "rho"))
def autocorrelation(spark, sf_dir):
    from volpanel.operators.descriptive import dense_index

    v = dense_index(values(spark, sf_dir), ["series_id", "variable"])
    out = st.acf(v, "x", F.array(F.lit(1), F.lit(5), F.lit(20)), ["series_id", "variable"])
    return rounded(out.select("series_id", "variable", "lag", "acf"), 6)


@query("ljung_box", with_parts(f"""SELECT series_id, variable, {rd('q', 4)} AS q, {rd('exp(-q / 2) * list_sum(list_transform(range(0, 10), lambda i: pow(q / 2, i) / exp(lgamma(i + 1.0))))', 6)} AS p
FROM (SELECT series_id, variable, any_value(n) * (any_value(n) + 2.0) * sum(acf * acf / (n - lag)) AS q FROM rho GROUP BY ALL)""", "rho"))
def ljung_box(spark, sf_dir):
    from volpanel.operators.descriptive import dense_index, ljung_box as lb

    return rounded(lb(dense_index(values(spark, sf_dir), ["series_id", "variable"]), "x", 20, ["series_id", "variable"]).select(
        "series_id", "variable", "q", "p"), 6, q=4)


_G = "series_id, variable"
part("adf_n", f"SELECT {_G}, n, CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2) AS INT) AS top FROM (SELECT {_G}, count(*) AS n FROM vals GROUP BY ALL)", "vals")
part("adf_d", f"SELECT {_G}, row_number() OVER w - 1 AS t, x - lag(x) OVER w AS d, lag(x) OVER w AS level FROM vals WINDOW w AS (PARTITION BY {_G} ORDER BY i)", "vals")
# values of row t by regressor: j >= 0 the difference j rows before (0: what is explained), -1 the level
part("adf_v", f"""SELECT {_G}, t + j AS t, j, d AS v FROM (SELECT a.*, unnest(range(0, top + 1)) AS j FROM adf_d a JOIN adf_n USING ({_G}) WHERE d IS NOT NULL) JOIN adf_n USING ({_G}) WHERE t + j < n
UNION ALL SELECT {_G}, t, -1, level FROM adf_d WHERE level IS NOT NULL""", "adf_d", "adf_n")


def _adf_products(orders: str) -> str:
    """Centred products over the rows with ``q`` lagged differences, q by group from ``orders``."""
    return f"""SELECT {_G}, q, a.j AS r, b.j AS c, covar_pop(a.v, b.v) AS m, count(*) AS n FROM adf_v a JOIN adf_v b USING ({_G}, t) JOIN ({orders}) o USING ({_G})
WHERE t > q AND a.j <= q AND b.j <= q GROUP BY ALL"""


def _adf_sweep(source: str, first: int, last: str) -> str:
    """Take regressors ``first``, first + 1, ... out one by one; step s is the matrix without those up to s."""
    return f"""SELECT {_G}, q, {first - 1} AS s, r, c, m, n FROM {source}
UNION ALL SELECT x.series_id, x.variable, x.q, x.s + 1, x.r, x.c, x.m - u.m * v.m / p.m, x.n FROM {{0}} x
JOIN {{0}} p ON p.series_id = x.series_id AND p.variable = x.variable AND p.r = p.c AND p.r = {last}
JOIN {{0}} u ON u.series_id = x.series_id AND u.variable = x.variable AND u.r = x.r AND u.c = p.r
JOIN {{0}} v ON v.series_id = x.series_id AND v.variable = x.variable AND v.r = p.r AND v.c = x.c
WHERE x.r != p.r AND x.c != p.r AND x.s + 1 <= x.q"""


# comparison: the level goes first (step 0), then the lags in turn; refit: only the lags (steps from 1), the level is left
_ADF_Z = f"CASE WHEN stat <= {descriptive.ADF_STAR} THEN " + " + ".join(f"{c} * pow(stat, {i})" for i, c in enumerate(descriptive.ADF_SMALL)) + " ELSE " + " + ".join(
    f"{c} * pow(stat, {i})" for i, c in enumerate(descriptive.ADF_LARGE)) + " END"
_PHI = "0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"


@query("augmented_dickey_fuller", with_parts(f"""WITH c0 AS MATERIALIZED ({_adf_products(f"SELECT {_G}, top AS q FROM adf_n")}),
cs AS ({_adf_sweep("c0", 0, "CASE WHEN x.s + 1 = 0 THEN -1 ELSE x.s + 1 END").format("cs")}),
b AS MATERIALIZED (SELECT {_G}, arg_min(s, n * ln(m) + 2 * (s + 2)) AS q FROM cs WHERE r = 0 AND c = 0 AND s >= 0 GROUP BY ALL),
f0 AS MATERIALIZED ({_adf_products(f"SELECT {_G}, q FROM b")}),
fs AS ({_adf_sweep("f0", 1, "x.s + 1").format("fs")}),
l AS (SELECT {_G}, q, n, max(m) FILTER (WHERE r = -1 AND c = -1) AS piv, max(m) FILTER (WHERE r = -1 AND c = 0) AS b, max(m) FILTER (WHERE r = 0 AND c = 0) AS yy FROM fs WHERE s = q GROUP BY ALL),
t AS (SELECT *, b / piv / sqrt((yy - b * b / piv) / (n - q - 2) / piv) AS stat FROM l),
p AS (SELECT *, {_ADF_Z} AS z FROM t)
SELECT {_G}, {rd('stat', 5)} AS adf_stat, CAST(q AS INT) AS adf_lag, n AS n_used, {rd(f"CASE WHEN stat > {descriptive.ADF_RANGE[1]} THEN 1 WHEN stat < {descriptive.ADF_RANGE[0]} THEN 0 ELSE {_PHI} END", 5)} AS p,
CASE WHEN stat < -3.43035 THEN '1' WHEN stat < -2.86154 THEN '5' WHEN stat < -2.56677 THEN '10' ELSE 'none' END AS rejects_at_pct FROM p""", "adf_v", "adf_n", recursive=True))
def augmented_dickey_fuller(spark, sf_dir):
    return rounded(descriptive.adf(frame(spark, sf_dir), list(VARS)), 5)


@query("normal_quantiles", with_parts("""
SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date,
       round((row_number() OVER (PARTITION BY series_id, year ORDER BY ret, row_no) - 0.5) / count(*) OVER (PARTITION BY series_id, year), 9) + 0.0 AS p_back,
       sign(2 * row_number() OVER (PARTITION BY series_id, year ORDER BY ret, row_no) - 1 - count(*) OVER (PARTITION BY series_id, year))::INT AS side
FROM rets WHERE ret IS NOT NULL""", "rets"))
def normal_quantiles(spark, sf_dir):
    """Ranks of returns as normal scores, and back: the distribution of the score is the rank again."""
    w = Window.partitionBy("series_id", "year").orderBy("ret", "row_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id", "year"))
    f = frame(spark, sf_dir).filter("ret is not null").withColumn("score", tails.norm_ppf((F.row_number().over(w) - 0.5) / n))
    side = F.when(F.abs("score") < 1e-12, 0).otherwise(F.signum("score")).cast("int")
    return f.select("series_id", "obs_date", (F.round(tails.norm_cdf("score"), 9) + 0.0).alias("p_back"), side.alias("side"))
