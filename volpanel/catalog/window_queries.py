"""Window and time-series features."""

from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import fixtures as fx
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import fwd, lag, part, past, rd, with_parts
from volpanel.operators import features as ft
from volpanel.operators.panel import add_chunks, chunk_window, core_rows, running_sum

NUDGE = 0.0000314159265  # keeps exact halves of averaged cents off the rounding edge
KEY = ("series_id", "obs_date", "row_no")
KEY_SQL = "series_id, CAST(obs_date AS VARCHAR) AS obs_date, row_no"


@query("row_numbers", with_parts(f"SELECT {KEY_SQL}, year FROM num", "num"))
def row_numbers(spark, sf_dir):
    return fx.panel(spark, sf_dir).select(*KEY, "year")


@query("lags", with_parts(
    "SELECT " + KEY_SQL + ", " + ", ".join(
        f"{rd(f'{lag(x, i)} + {NUDGE}', 4)} AS {x}_lag{i}" for x in ("price", "implied", "idx_a", "idx_b")
        for i in C.LAGS) + " FROM num", "num"))
def lags(spark, sf_dir):
    w = chunk_window()
    df = core_rows(add_chunks(fx.panel(spark, sf_dir), back=max(C.LAGS)).withColumns({
        f"{x}_lag{i}": F.lag(x, i).over(w) for x in ("price", "implied", "idx_a", "idx_b") for i in C.LAGS}))
    names = [f"{x}_lag{i}" for x in ("price", "implied", "idx_a", "idx_b") for i in C.LAGS]
    return rounded(df.select(*KEY, *[(F.col(n) + NUDGE).alias(n) for n in names]), 4)


@query("log_returns", with_parts(f"SELECT {KEY_SQL}, {rd('ret', 8)} AS ret FROM rets", "rets"))
def log_returns(spark, sf_dir):
    df = add_chunks(fx.panel(spark, sf_dir), back=1)
    return rounded(core_rows(df.withColumn("ret", ft.log_return("price", chunk_window()))).select(*KEY, "ret"), 8)


@query("forward_realized_vol", with_parts(
    f"SELECT {KEY_SQL}, " + ", ".join(f"{rd(f'target_vol_{h}', 8)} AS target_vol_{h}" for h in fx.HORIZONS)
    + " FROM wide", "wide"))
def forward_realized_vol(spark, sf_dir):
    df = ft.returns_and_targets(fx.panel(spark, sf_dir), fx.HORIZONS)
    return rounded(df.select(*KEY, *[f"target_vol_{h}" for h in fx.HORIZONS]), 8)


@query("rolling_vol", with_parts(
    f"SELECT {KEY_SQL}, " + ", ".join(f"{rd(past(n), 8)} AS price_vol{n}" for n in C.VOL_WINDOWS)
    + " FROM rets", "rets"))
def rolling_vol(spark, sf_dir):
    w = chunk_window()
    df = add_chunks(fx.panel(spark, sf_dir), back=max(C.VOL_WINDOWS) + 1)
    df = df.withColumn("ret", ft.log_return("price", w))
    df = core_rows(df.withColumns({f"price_vol{n}": ft.past_vol("ret", w, n) for n in C.VOL_WINDOWS}))
    return rounded(df.select(*KEY, *[f"price_vol{n}" for n in C.VOL_WINDOWS]), 8)


def ema_sql(x: str, span: int) -> str:
    """The recursion itself, run over the ordered list of all values so far."""
    return (f"CASE WHEN row_no >= {span - 1} THEN list_reduce(list({x}) OVER (PARTITION BY series_id "
            f"ORDER BY row_no ROWS UNBOUNDED PRECEDING), lambda a, v: a + {2.0 / (span + 1)!r} * (v - a)) END")


part("emas", "SELECT *, " + ", ".join(
    f"{ema_sql(x, s)} AS {x}_ema{s}" for x in ("price", "implied", "idx_a", "idx_b") for s in C.EMA_SPANS)
    + " FROM num", "num")
EMA = [(x, s, 6 if x == "implied" else 3) for x in ("price", "implied", "idx_a", "idx_b") for s in C.EMA_SPANS]


@query("ema", with_parts(f"SELECT {KEY_SQL}, " + ", ".join(
    f"{rd(lag(f'{x}_ema{s}', 1), d)} AS {x}_ema{s}" for x, s, d in EMA) + " FROM emas", "emas"))
def ema(spark, sf_dir):
    w = chunk_window()
    df = add_chunks(fx.panel(spark, sf_dir), back=ft.ema_reach())
    df = ft.ema_columns(df, ("price", "implied", "idx_a", "idx_b"))
    df = core_rows(df.withColumns({f"{x}_ema{s}": F.lag(f"{x}_ema{s}", 1).over(w) for x, s, _ in EMA}))
    return rounded(df.select(*KEY, *[f"{x}_ema{s}" for x, s, _ in EMA]), 3, **{f"implied_ema{s}": 6 for s in C.EMA_SPANS})


# --- the whole matrix ------------------------------------------------------
def _sql_z(x: str, frame: str = "59 PRECEDING AND CURRENT ROW") -> str:
    w = f"(PARTITION BY series_id ORDER BY row_no ROWS BETWEEN {frame})"
    return f"CASE WHEN count({x}) OVER {w} = 60 THEN ({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0) END"


def _sql_mr(x: str) -> str:
    w = "(PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = 60 THEN {x} / avg({x}) OVER {w} - 1 END"


part("block", "SELECT *, " + ", ".join(
    [f"{_sql_z(x)} AS {x}_z0" for x in ("implied", "idx_a", "idx_b")]
    + [f"{_sql_mr('implied')} AS mr0", "idx_b / nullif(idx_a, 0) AS ratio0",
       "ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY row_no)) AS ret"]) + " FROM emas", "emas")

part("own", "SELECT *, " + ", ".join(
    [f"{lag(x, i)} AS {x}_lag{i}" for x in ("price", "implied") for i in C.LAGS]
    + [f"{lag(f'{x}_ema{s}', 1)} AS {x}_e{s}" for x in ("price", "implied") for s in C.EMA_SPANS]
    + [f"{lag('ret', i)} AS price_ret_lag{i}" for i in C.LAGS]
    + [f"{past(n)} AS price_vol{n}" for n in C.VOL_WINDOWS]
    + [f"{lag('implied_z0', 1)} AS implied_z60", f"{lag('mr0', 1)} AS implied_mr60"]) + " FROM block", "block")

part("ts_block", "SELECT *, " + ", ".join(
    [f"{lag(x, i)} AS {x}_lag{i}" for x in ft.INDEXES for i in C.LAGS]
    + [f"{lag(f'{x}_ema{s}', 1)} AS {x}_e{s}" for x in ft.INDEXES for s in C.EMA_SPANS]
    + [f"{lag(f'{x}_z0', 1)} AS {x}_z60" for x in ft.INDEXES] + [f"{lag('ratio0', 1)} AS index_ratio"])
    + " FROM own", "own")


def _flag(cond: str, z: str) -> str:
    return f"CASE WHEN {z} IS NOT NULL THEN CAST({cond} AS DOUBLE) END"


_DERIVED = ({f"{x}_lag{i}": f"{x}_lag{i}" for x in ("price", "implied", *ft.INDEXES) for i in C.LAGS}
            | {f"{x}_ema{s}": f"{x}_e{s}" for x in ("price", "implied", *ft.INDEXES) for s in C.EMA_SPANS}
            | {f"price_ret_lag{i}": f"price_ret_lag{i}" for i in C.LAGS}
            | {f"price_vol{n}": f"price_vol{n}" for n in C.VOL_WINDOWS}
            | {"vol_ratio": "price_vol5 / (price_vol20 + 1e-9)", "vol5_vol60": "price_vol5 / (price_vol60 + 1e-9)",
               "vol20_vol126": "price_vol20 / (price_vol126 + 1e-9)",
               "implied_z60": "implied_z60", "implied_mr60": "implied_mr60",
               "implied_spike": _flag("implied_z60 > 2", "implied_z60"),
               "implied_regime_high": _flag("implied_z60 > 1", "implied_z60"),
               "implied_regime_low": _flag("implied_z60 < -1", "implied_z60"), "index_ratio": "index_ratio"}
            | {f"{x}_z60": f"{x}_z60" for x in ft.INDEXES}
            | {f"{x}_spike": _flag(f"{x}_z60 > 2", f"{x}_z60") for x in ft.INDEXES}
            | {f"{x}_momentum": f"{x}_e5 - {x}_e20" for x in ft.INDEXES}
            | {"implied_x_idx_a": "implied_lag1 * idx_a_lag1", "implied_x_idx_b": "implied_lag1 * idx_b_lag1",
               "regime_high_x_idx_a": f"({_flag('implied_z60 > 1', 'implied_z60')}) * idx_a_lag1",
               "regime_low_x_idx_a": f"({_flag('implied_z60 < -1', 'implied_z60')}) * idx_a_lag1",
               "dow": "CAST(isodow(obs_date) - 1 AS INT)", "month": "CAST(month(obs_date) AS INT)",
               "is_month_start": "CAST(day(obs_date) = 1 AS INT)",
               "is_month_end": "CAST(last_day(obs_date) = obs_date AS INT)",
               "is_quarter_end": "CAST(last_day(obs_date) = obs_date AND month(obs_date) % 3 = 0 AS INT)"})
_INTS = ("dow", "month", "is_month_start", "is_month_end", "is_quarter_end")
# digits by magnitude: about nine significant ones, clear of the summation noise
_DIGITS = {c: (0 if c.startswith("implied_x") else 1 if "_x_" in c else 6 if c.startswith("implied") and "_x" not in c
               else 6 if c in ("index_ratio", "vol_ratio", "vol5_vol60", "vol20_vol126") or "z60" in c or "vol" in c
               or "ret" in c or "spike" in c else 3) for c in _DERIVED}
def matrix_sql(source: str) -> str:
    cols = [f"{e} AS {c}" if c in _INTS else f"{rd(f'({e}) + {NUDGE}', _DIGITS[c])} AS {c}"
            for c, e in ((c, _DERIVED[c]) for c in ft.FEATURES)]
    return f"SELECT {KEY_SQL}, " + ", ".join(cols) + f" FROM {source}"


def matrix_out(df):
    cols = [F.col(c) if c in _INTS else (F.round(F.col(c) + NUDGE, _DIGITS[c]) + 0.0).alias(c) for c in ft.FEATURES]
    return df.select(*KEY, *cols)


def features(spark, sf_dir):
    return fx.remember(spark, sf_dir, "features", lambda: ft.build_features(
        fx.panel(spark, sf_dir), keep=("price", "implied", "idx_a", "idx_b")))


part("features", "SELECT *, " + ", ".join(f"{e} AS f_{c}" for c, e in _DERIVED.items()) + " FROM ts_block", "ts_block")
part("feature_rows", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, series_id, row_no, obs_date, year, CAST(f_{c} AS DOUBLE) AS v FROM features"
    for c in ft.FEATURES), "features")


@query("feature_matrix", with_parts(matrix_sql("ts_block"), "ts_block"))
def feature_matrix(spark, sf_dir):
    return matrix_out(features(spark, sf_dir))


def subset(*cols):
    names = list(cols)
    sql = with_parts(f"SELECT {KEY_SQL}, " + ", ".join(
        f"{_DERIVED[c]} AS {c}" if c in _INTS else f"{rd(f'({_DERIVED[c]}) + {NUDGE}', _DIGITS[c])} AS {c}" for c in names)
        + " FROM ts_block", "ts_block")
    return names, sql


def _subset_query(name, cols, build):
    names, sql = subset(*cols)

    @query(name, sql)
    def run(spark, sf_dir):
        df = build(fx.panel(spark, sf_dir))
        return df.select(*KEY, *[F.col(c) if c in _INTS else (F.round(F.col(c) + NUDGE, _DIGITS[c]) + 0.0).alias(c)
                                 for c in names])
    return run


def _implied(p):
    w = chunk_window()
    df = add_chunks(p, back=61)
    df = df.withColumns({"_z": ft.zscore("implied", w), "_m": ft.mean_ratio("implied", w)})
    return core_rows(df.withColumns({"implied_z60": F.lag("_z", 1).over(w), "implied_mr60": F.lag("_m", 1).over(w)}))


_subset_query("rolling_zscore", ["implied_z60"], _implied)
_subset_query("mean_reversion", ["implied_mr60"], _implied)
_subset_query("regime_flags", ["implied_spike", "implied_regime_high", "implied_regime_low"],
              lambda p: _implied(p).withColumns({
                  "implied_spike": ft.flag_null_safe(F.col("implied_z60") > C.SPIKE_Z, F.col("implied_z60")),
                  "implied_regime_high": ft.flag_null_safe(F.col("implied_z60") > C.REGIME_Z, F.col("implied_z60")),
                  "implied_regime_low": ft.flag_null_safe(F.col("implied_z60") < -C.REGIME_Z, F.col("implied_z60"))}))
_subset_query("calendar_features", list(_INTS), lambda p: p.withColumns(ft.calendar_flags()))
_subset_query("vol_ratios", ["vol_ratio", "vol5_vol60", "vol20_vol126"], lambda p: ft.build_features(p))
_subset_query("momentum", ["idx_a_momentum", "idx_b_momentum"], lambda p: ft.build_features(p))
_subset_query("interactions", ["index_ratio", "implied_x_idx_a", "implied_x_idx_b", "regime_high_x_idx_a",
                               "regime_low_x_idx_a"], lambda p: ft.build_features(p))


@query("har_daily", with_parts(f"SELECT {KEY_SQL}, {rd(f'abs({lag('ret', 1)})', 8)} AS har_daily FROM rets", "rets"))
def har_daily(spark, sf_dir):
    w = chunk_window()
    df = add_chunks(fx.panel(spark, sf_dir), back=2).withColumn("ret", ft.log_return("price", w))
    return rounded(core_rows(df.withColumn("har_daily", F.abs(F.lag("ret", 1).over(w)))).select(*KEY, "har_daily"), 8)


# --- publication alignment -------------------------------------------------
part("released", """SELECT *, CAST(obs_date + CAST((8 - isodow(obs_date)) % 7 AS INT) AS DATE) AS publication_date,
lag(obs_date) OVER (PARTITION BY series_id ORDER BY row_no) AS prev_date FROM own""", "own")
part("asof_rows", """SELECT l.series_id AS ls, l.row_no AS lr, max(r.row_no) AS used_row
FROM released l JOIN released r ON l.series_id = r.series_id AND r.publication_date <= l.prev_date GROUP BY 1, 2""",
     "released")
_BLOCK_RAW = ([f"{x}_lag{i}" for x in ft.INDEXES for i in C.LAGS])
part("pub_raw", "SELECT *, " + ", ".join(
    f"{lag(x, i - 1)} AS {x}_lag{i}" for x in ft.INDEXES for i in C.LAGS)
    + ", " + ", ".join(f"{x}_ema{s} AS {x}_e{s}" for x in ft.INDEXES for s in C.EMA_SPANS)
    + ", " + ", ".join(f"{x}_z0 AS {x}_z60" for x in ft.INDEXES) + ", ratio0 AS index_ratio FROM released", "released")
part("pub_block", "SELECT o.*, a.used_row, b.obs_date AS used_date, " + ", ".join(
    f"b.{c}" for c in [*_BLOCK_RAW, *[f"{x}_e{s}" for x in ft.INDEXES for s in C.EMA_SPANS],
                       *[f"{x}_z60" for x in ft.INDEXES], "index_ratio"])
    + """ FROM released o LEFT JOIN asof_rows a ON o.series_id = a.ls AND o.row_no = a.lr
LEFT JOIN pub_raw b ON b.series_id = o.series_id AND b.row_no = a.used_row""", "pub_raw", "asof_rows")


def features_published(spark, sf_dir):
    from volpanel.operators.alignment import features_as_published, release_monday

    return fx.remember(spark, sf_dir, "features_published", lambda: features_as_published(
        fx.panel(spark, sf_dir).withColumn("publication_date", release_monday(F.col("obs_date")))))


@query("features_as_published", with_parts(matrix_sql("pub_block"), "pub_block"))
def features_as_published(spark, sf_dir):
    return matrix_out(features_published(spark, sf_dir))


part("pub_features", "SELECT *, " + ", ".join(f"{e} AS f_{c}" for c, e in _DERIVED.items()) + " FROM pub_block", "pub_block")


@query("alignment_effect", with_parts(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*) FILTER (WHERE a.f_{c} IS DISTINCT FROM b.f_{c}) AS n_rows_differ,
    min(a.row_no) FILTER (WHERE a.f_{c} IS NOT NULL) AS first_valid_a, min(b.row_no) FILTER (WHERE b.f_{c} IS NOT NULL) AS first_valid_b,
    CAST(count(*) FILTER (WHERE a.f_{c} IS DISTINCT FROM b.f_{c}) > 0 AS INT) AS changed
    FROM features a JOIN pub_features b USING (series_id, row_no)""" for c in ft.FEATURES), "features", "pub_features"))
def alignment_effect(spark, sf_dir):
    from volpanel.operators.alignment import alignment_effect as effect

    return effect(features(spark, sf_dir), features_published(spark, sf_dir), ft.FEATURES)


part("pub_lags", """SELECT *, date_diff('day', used_date, obs_date) AS lag_days, row_no - used_row AS lag_rows,
dayname(obs_date) AS weekday FROM pub_block WHERE used_row IS NOT NULL""", "pub_block")


def _four(c):
    return (f"CAST(min({c}) AS BIGINT) AS {c}_min, median({c}) AS {c}_median, {rd(f'avg({c})', 8)} AS {c}_mean, "
            f"CAST(max({c}) AS BIGINT) AS {c}_max")


@query("effective_lag", with_parts(f"""SELECT series_id, weekday, count(*) AS n, {_four('lag_days')}, {_four('lag_rows')},
{rd('avg(CAST(lag_rows > 1 AS DOUBLE))', 8)} AS share_not_yet_published FROM pub_lags GROUP BY series_id, weekday""", "pub_lags"))
def effective_lag(spark, sf_dir):
    from volpanel.operators.alignment import effective_lag as ages, lag_summary

    return rounded(lag_summary(ages(features_published(spark, sf_dir)), "series_id", "weekday"), 8)


# --- correlation of features ----------------------------------------------
@query("high_corr_pairs", with_parts("WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(f_{a}, f_{b}) AS r FROM features"
    for i, a in enumerate(ft.FEATURES) for b in ft.FEATURES[i + 1:]) + f") SELECT feature_a, feature_b, {rd('r', 6)} AS r FROM c WHERE abs(r) > 0.95",
    "features"))
def high_corr_pairs(spark, sf_dir):
    from volpanel.operators.diagnostics import high_corr_pairs as pairs

    return rounded(pairs(features(spark, sf_dir), ft.FEATURES, C.CORR_THRESHOLD), 6)


_RISING = "list_sum([" + ", ".join(f"CAST(f_{c} > lag(f_{c}, 19) OVER o AS INT)" for c in ft.FEATURES) + "])"


@query("lookback_sequences", with_parts(f"""
SELECT {KEY_SQL}, CAST(20 AS INT) AS steps, CAST({len(ft.FEATURES)} AS INT) AS width, {rd('sum(f_price_vol5) OVER w', 6)} AS sum_vol5, {rd('sum(f_price_vol20) OVER w', 6)} AS sum_vol20,
CAST({_RISING} AS INT) AS n_risen, {rd('sum(f_implied_spike) OVER w', 6)} AS n_spikes
FROM features WINDOW o AS (PARTITION BY series_id ORDER BY row_no), w AS (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
QUALIFY count(CASE WHEN {" AND ".join(f"f_{c} IS NOT NULL" for c in ft.FEATURES)} THEN 1 END) OVER w = 20""", "features"))
def lookback_sequences(spark, sf_dir):
    """The last 20 vectors of all 65 features; checked by sums of some and by how many end above their start."""
    df = ft.lookback_sequences(features(spark, sf_dir), ft.FEATURES, 20)
    total = lambda c: F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[ft.FEATURES.index(c)])
    risen = F.aggregate(F.zip_with(F.element_at("sequence", -1), F.element_at("sequence", 1), lambda b, a: (b > a).cast("int")), F.lit(0), lambda s, v: s + v)
    return rounded(df.select(*KEY, F.size("sequence").alias("steps"), F.size(F.element_at("sequence", 1)).alias("width"), total("price_vol5").alias("sum_vol5"),
                             total("price_vol20").alias("sum_vol20"), risen.alias("n_risen"), total("implied_spike").alias("n_spikes")), 6)


@query("cumulative_counts", with_parts(f"""SELECT {KEY_SQL},
CAST(sum(CAST(abs(ret) > 0.5 AS INT)) OVER (PARTITION BY series_id ORDER BY row_no) AS BIGINT) AS big_moves
FROM (SELECT series_id, obs_date, row_no, coalesce(ret, 0) AS ret FROM rets)""", "rets"))
def cumulative_counts(spark, sf_dir):
    df = add_chunks(fx.panel(spark, sf_dir), back=1)
    df = core_rows(df.withColumn("big", (F.abs(F.coalesce(ft.log_return("price", chunk_window()), F.lit(0.0))) > 0.5).cast("long")))
    return running_sum(df, {"big_moves": "big"}, ["series_id"]).select(*KEY, "big_moves")
