"""DuckDB expressions for folds, least squares and predictions.

Training rows are joined to folds row by row and normal equations are solved by
elimination written out in SQL, so nothing is shared with the Spark route.
"""

from volpanel import config as C
from volpanel.catalog.sql import part

XS = list(C.HAR_VARIANTS["har_x"])
KEYS = "series_id, horizon, test_year"


def ols_parts(name: str, xs, source: str, y: str = "y", keys: str = KEYS) -> str:
    """Register the parts of one regression; the last one, ``fit_<name>``, has b0, b_<x>."""
    p = len(xs)
    ups = [(i, j) for i in range(p) for j in range(i, p)]
    part(f"e{name}_0", f"SELECT {keys}, count(*) AS n, avg({y}) AS my, " + ", ".join(
        [f"avg({x}) AS m{i}" for i, x in enumerate(xs)]
        + [f"covar_pop({xs[i]}, {xs[j]}) AS a{i}_{j}" for i, j in ups]
        + [f"covar_pop({x}, {y}) AS b{i}" for i, x in enumerate(xs)]
        + [f"stddev_pop({x}) AS sd{i}" for i, x in enumerate(xs)] + [f"stddev_pop({y}) AS sdy"])
        + f" FROM {source} GROUP BY {keys}", source)
    for k in range(p):
        cols = []
        for i, j in ups:
            cols.append(f"a{i}_{j}" if i <= k else f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}")
        for i in range(p):
            cols.append(f"b{i}" if i <= k else f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}")
        rest = [f"m{i}" for i in range(p)] + [f"sd{i}" for i in range(p)] + ["sdy", "my", "n"]
        part(f"e{name}_{k + 1}", f"SELECT {keys}, " + ", ".join(rest + cols) + f" FROM e{name}_{k}", f"e{name}_{k}")
    last = f"e{name}_{p}"
    for k in reversed(range(p)):
        expr = f"(b{k}" + "".join(f" - a{k}_{j} * c{j}" for j in range(k + 1, p)) + f") / a{k}_{k} AS c{k}"
        part(f"s{name}_{k}", f"SELECT *, {expr} FROM {last}", last)
        last = f"s{name}_{k}"
    part(f"fit_{name}", f"SELECT {keys}, n, my - " + " - ".join(f"c{i} * m{i}" for i in range(p)) + " AS b0, "
         + ", ".join(f"c{i} AS b_{x}, m{i} AS m_{x}, c{i} * sd{i} / sdy AS z_{x}" for i, x in enumerate(xs))
         + f" FROM {last}", last)
    return f"fit_{name}"


def predictor(xs, t: str = "t", f: str = "f") -> str:
    return f"{f}.b0 + " + " + ".join(f"{f}.b_{x} * {t}.{x}" for x in xs)


OUT = ("t.series_id, t.horizon, t.test_year, t.obs_date, t.row_no, t.include_in_main, "
       "CAST(t.test_year - 1997 AS INT) AS fold, s.train_mean, s.floor, s.n_train")
JOIN_STATS = "JOIN fold_stats s ON s.series_id = t.series_id AND s.horizon = t.horizon AND s.test_year = t.test_year"


def on(a, b, keys=("series_id", "horizon", "test_year")):
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


for _v, _xs in C.HAR_VARIANTS.items():
    ols_parts(_v, list(_xs), "train")
    part(f"p_{_v}", f"""SELECT '{_v}' AS model, {OUT}, t.y AS y_true, greatest({predictor(_xs)}, s.floor) AS pred
FROM test t JOIN fit_{_v} f ON {on('t', 'f')} {JOIN_STATS}""", "test", f"fit_{_v}", "fold_stats")

part("p_train_mean", f"SELECT 'train_mean' AS model, {OUT}, t.y AS y_true, s.train_mean AS pred FROM test t {JOIN_STATS}",
     "test", "fold_stats")
part("p_past_vol", f"SELECT 'past_vol' AS model, {OUT}, t.y AS y_true, t.past_vol AS pred FROM test t {JOIN_STATS}",
     "test", "fold_stats")

_lx = ", ".join(f"ln(greatest({x}, 1e-4)) AS {x}" for x in XS)
part("train_log", f"SELECT {KEYS}, ln(y) AS y, {_lx} FROM train", "train")
part("test_log", f"SELECT {KEYS}, obs_date, row_no, include_in_main, y, {_lx} FROM test", "test")
for _v, _base in (("har_log", "har"), ("har_x_log", "har_x")):
    _xs = C.HAR_VARIANTS[_base]
    ols_parts(_v, list(_xs), "train_log")
    part(f"smear_{_v}", f"""SELECT t.series_id, t.horizon, t.test_year, avg(exp(t.y - ({predictor(_xs)}))) AS smearing,
stddev_samp(t.y - ({predictor(_xs)})) AS resid_log_std FROM train_log t JOIN fit_{_v} f ON {on('t', 'f')} GROUP BY 1, 2, 3""",
         "train_log", f"fit_{_v}")
    part(f"p_{_v}", f"""SELECT '{_v}' AS model, {OUT}, t.y AS y_true, exp({predictor(_xs)}) * m.smearing AS pred
FROM test_log t JOIN fit_{_v} f ON {on('t', 'f')} JOIN smear_{_v} m ON {on('t', 'm')} {JOIN_STATS}""",
         "test_log", f"fit_{_v}", f"smear_{_v}", "fold_stats")

LEVEL_MODELS = ["har", "har_implied", "har_index", "har_x", "train_mean", "past_vol"]
LOG_MODELS = ["har_log", "har_x_log"]
COLS = ("model, series_id, horizon, test_year, obs_date, row_no, include_in_main, fold, train_mean, floor, "
        "n_train, y_true, pred")
part("preds", " UNION ALL ".join(f"SELECT {COLS} FROM p_{m}" for m in LEVEL_MODELS), *[f"p_{m}" for m in LEVEL_MODELS])
part("preds_log", " UNION ALL ".join(f"SELECT {COLS} FROM p_{m}" for m in LOG_MODELS), *[f"p_{m}" for m in LOG_MODELS])

part("fm", """SELECT series_id, model, horizon, fold, test_year, include_in_main, count(*) AS n,
sqrt(avg((y_true - pred) ** 2)) AS rmse, avg(abs(y_true - pred)) AS mae,
1 - sum((y_true - pred) ** 2) / nullif(sum((y_true - train_mean) ** 2), 0) AS r2_oos,
1 - sum((y_true - pred) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS r2,
var_pop(y_true) * count(*) AS sst_own
FROM preds WHERE pred IS NOT NULL AND isfinite(pred) GROUP BY ALL""", "preds")
part("means", """SELECT series_id, model, horizon, count(*) AS n_folds, avg(rmse) AS rmse_fold_mean,
avg(mae) AS mae_fold_mean, avg(r2_oos) AS r2_oos_fold_mean FROM fm WHERE include_in_main GROUP BY ALL""", "fm")
