"""Causal features: row t uses rows up to t-1 only (calendar flags excepted).

Every window is bounded and runs over the chunks of :mod:`panel`, so the whole
matrix costs one exchange.
"""

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators.panel import (add_chunks, chunk_window, core_rows, decay_block,
                                      decayed_sums, full_frame)

INDEXES = ("idx_a", "idx_b")
RETURN_COLUMNS = [f"price_ret_lag{i}" for i in C.LAGS] + [f"price_vol{w}" for w in C.VOL_WINDOWS] \
    + ["vol_ratio", "vol5_vol60", "vol20_vol126"]


def log_return(price: str, w: WindowSpec) -> Column:
    """ln(p / previous p); NULL on the first row and where a price is not positive."""
    before = F.lag(price, 1).over(w)
    return F.when((before > 0) & (F.col(price) > 0), F.log(F.try_divide(F.col(price), before)))


def forward_vol(ret: str, w: WindowSpec, h: int) -> Column:
    """Sample deviation of the returns of rows t+1..t+h; NULL unless all are there."""
    return full_frame(F.stddev_samp(ret), F.col(ret), w.rowsBetween(1, h), h)


def past_vol(ret: str, w: WindowSpec, size: int) -> Column:
    """Sample deviation of the returns of rows t-size..t-1."""
    return full_frame(F.stddev_samp(ret), F.col(ret), w.rowsBetween(-size, -1), size)


def flag_null_safe(condition: Column, source: Column) -> Column:
    """1.0 / 0.0, and NULL (not 0) where the source is NULL."""
    return F.when(source.isNotNull(), condition.cast("double"))


def zscore(x: str, w: WindowSpec, size: int = C.Z_WINDOW) -> Column:
    """(x - mean) / deviation over the last ``size`` rows, this row included."""
    frame = w.rowsBetween(-(size - 1), 0)
    z = F.try_divide(F.col(x) - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return F.when(F.count(x).over(frame) == size, z)


def mean_ratio(x: str, w: WindowSpec, size: int = C.Z_WINDOW) -> Column:
    frame = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(frame) == size,
                  F.try_divide(F.col(x), F.avg(x).over(frame)) - 1)


def calendar_flags(d: str = "obs_date") -> dict[str, Column]:
    day = F.col(d)
    return {
        "dow": F.weekday(day).cast("int"),
        "month": F.month(day).cast("int"),
        "is_month_start": (F.dayofmonth(day) == 1).cast("int"),
        "is_month_end": (F.last_day(day) == day).cast("int"),
        "is_quarter_end": ((F.last_day(day) == day) & (F.month(day) % 3 == 0)).cast("int"),
    }


def ema_columns(df: DataFrame, columns, spans=C.EMA_SPANS, keys=("series_id",)) -> DataFrame:
    """Exponential means ``{col}_ema{span}``, this row included, seeded by the first value.

    NULL on the first span-1 rows. ``(1-a)*ema + a*x`` with the seed counted in
    full is a decayed sum in which row 0 weighs 1 and the others ``a``.
    """
    def weight(alpha):
        return F.when(F.col("row_no") == 0, F.lit(1.0)).otherwise(F.lit(alpha))

    df = decayed_sums(df, {f"{c}_ema{s}": (weight(2.0 / (s + 1)) * F.col(c), 1 - 2.0 / (s + 1))
                           for c in columns for s in spans}, keys)
    return df.withColumns({f"{c}_ema{s}": F.when(F.col("row_no") >= s - 1, F.col(f"{c}_ema{s}"))
                           for c in columns for s in spans})


def ema_reach(spans=C.EMA_SPANS) -> int:
    return 2 * max(decay_block(1 - 2.0 / (s + 1)) for s in spans) + 1


def returns_and_targets(numbered: DataFrame, horizons, keys=("series_id",),
                        price: str = "price") -> DataFrame:
    """Per row: ``ret``, and per horizon ``target_vol_h``, ``past_vol_h``, ``fit_from_h``.

    ``fit_from_h`` is the first test year whose training set holds the row once
    the last h rows before the test year are dropped: the year of row t+h, plus
    one. It turns the expanding window into a bucket key (see :mod:`linear`).
    """
    top = max(horizons)
    w = chunk_window(keys)
    df = add_chunks(numbered, back=top + 1, ahead=top)
    df = df.withColumn("ret", log_return(price, w))
    df = df.withColumns({
        **{f"target_vol_{h}": forward_vol("ret", w, h) for h in horizons},
        **{f"past_vol_{h}": past_vol("ret", w, h) for h in horizons},
        **{f"fit_from_{h}": F.lead("year", h).over(w) + 1 for h in horizons}})
    return core_rows(df)


def index_block(numbered: DataFrame, keys=("series_id",)) -> DataFrame:
    """Index features on the index's own rows, not yet shifted (row d uses rows <= d).

    Columns are named as the features they become once an as-of join has aligned
    them; lagging them by one row gives the plain alignment.
    """
    w = chunk_window(keys)
    df = ema_columns(add_chunks(numbered, back=ema_reach()), INDEXES, keys=keys)
    cols = {}
    for x in INDEXES:
        for i in C.LAGS:
            cols[f"{x}_lag{i}"] = F.lag(x, i - 1).over(w) if i > 1 else F.col(x)
        cols[f"{x}_z60"] = zscore(x, w)
    cols["index_ratio"] = F.try_divide(F.col("idx_b"), F.col("idx_a"))
    return core_rows(df.withColumns(cols))


INDEX_BLOCK = ([f"{x}_lag{i}" for x in INDEXES for i in C.LAGS]
               + [f"{x}_ema{s}" for x in INDEXES for s in C.EMA_SPANS]
               + [f"{x}_z60" for x in INDEXES] + ["index_ratio"])


def causal_columns(numbered: DataFrame, names, keys=("series_id",), previous_date: bool = False) -> DataFrame:
    """All windowed features of the series in ``names``, lagged by one row.

    Windows come in three layers on one exchange: decayed sums, this-row
    statistics, and their lags.
    """
    w = chunk_window(keys)
    indexes = [x for x in names if x in INDEXES]
    df = ema_columns(add_chunks(numbered, back=ema_reach() + 1), names, keys=keys)
    zs = ["implied", *indexes]
    df = df.withColumns({"ret": log_return("price", w), **{f"_z_{x}": zscore(x, w) for x in zs},
                         "_mr": mean_ratio("implied", w)})
    cols = {f"{x}_lag{i}": F.lag(x, i).over(w) for x in names for i in C.LAGS}
    cols |= {f"{x}_ema{s}": F.lag(f"{x}_ema{s}", 1).over(w) for x in names for s in C.EMA_SPANS}
    cols |= {f"{x}_z60": F.lag(f"_z_{x}", 1).over(w) for x in zs}
    cols |= {f"price_ret_lag{i}": F.lag("ret", i).over(w) for i in C.LAGS}
    cols |= {f"price_vol{n}": past_vol("ret", w, n) for n in C.VOL_WINDOWS}
    cols |= {"implied_mr60": F.lag("_mr", 1).over(w), "har_daily": F.abs(F.lag("ret", 1).over(w))}
    if previous_date:
        cols["prev_date"] = F.lag("obs_date", 1).over(w)
    df = core_rows(df.withColumns(cols)).drop("_mr", *[f"_z_{x}" for x in zs])
    if len(indexes) == 2:
        df = df.withColumn("index_ratio", F.try_divide(F.col("idx_b_lag1"), F.col("idx_a_lag1")))
    return df


def derived_features(df: DataFrame) -> DataFrame:
    """Row-wise features of already aligned columns."""
    z = F.col("implied_z60")
    cols = {
        "vol_ratio": F.col("price_vol5") / (F.col("price_vol20") + C.RATIO_EPS),
        "vol5_vol60": F.col("price_vol5") / (F.col("price_vol60") + C.RATIO_EPS),
        "vol20_vol126": F.col("price_vol20") / (F.col("price_vol126") + C.RATIO_EPS),
        "implied_spike": flag_null_safe(z > C.SPIKE_Z, z),
        "implied_regime_high": flag_null_safe(z > C.REGIME_Z, z),
        "implied_regime_low": flag_null_safe(z < -C.REGIME_Z, z),
    }
    for x in INDEXES:
        zx = F.col(f"{x}_z60")
        cols[f"{x}_spike"] = flag_null_safe(zx > C.SPIKE_Z, zx)
        cols[f"{x}_momentum"] = F.col(f"{x}_ema5") - F.col(f"{x}_ema20")
    df = df.withColumns(cols)
    return df.withColumns({
        "implied_x_idx_a": F.col("implied_lag1") * F.col("idx_a_lag1"),
        "implied_x_idx_b": F.col("implied_lag1") * F.col("idx_b_lag1"),
        "regime_high_x_idx_a": F.col("implied_regime_high") * F.col("idx_a_lag1"),
        "regime_low_x_idx_a": F.col("implied_regime_low") * F.col("idx_a_lag1"),
        **calendar_flags()})


FEATURES = (
    [f"{x}_lag{i}" for x in ("price", "implied", "idx_a", "idx_b") for i in C.LAGS]
    + [f"{x}_ema{s}" for x in ("price", "implied", "idx_a", "idx_b") for s in C.EMA_SPANS]
    + [f"price_ret_lag{i}" for i in C.LAGS]
    + [f"price_vol{w}" for w in C.VOL_WINDOWS]
    + ["vol_ratio", "vol5_vol60", "vol20_vol126"]
    + ["implied_z60", "implied_spike", "implied_regime_high", "implied_regime_low", "implied_mr60"]
    + [f"{x}_{f}" for x in INDEXES for f in ("z60", "spike", "momentum")] + ["index_ratio"]
    + ["implied_x_idx_a", "implied_x_idx_b", "regime_high_x_idx_a", "regime_low_x_idx_a"]
    + ["dow", "month", "is_month_start", "is_month_end", "is_quarter_end"])

LOG_FEATURES = (
    [f"{x}_lag{i}" for x in ("price", "implied", "idx_a", "idx_b") for i in C.LAGS]
    + [f"{x}_ema{s}" for x in ("price", "implied", "idx_a", "idx_b") for s in C.EMA_SPANS]
    + [f"price_vol{w}" for w in C.VOL_WINDOWS]
    + ["vol_ratio", "vol5_vol60", "vol20_vol126", "index_ratio",
       "implied_x_idx_a", "implied_x_idx_b"])


def build_features(numbered: DataFrame, keys=("series_id",), keep=()) -> DataFrame:
    """The 65-column matrix with every index feature lagged by one row.

    ``numbered`` is the output of ``number_rows``. For features aligned by
    publication date see ``alignment.features_as_published``.
    """
    df = derived_features(causal_columns(numbered, ("price", "implied", *INDEXES), keys))
    return df.select(*keys, "obs_date", "year", "row_no", *keep, "har_daily", *FEATURES)


def lookback_sequences(df: DataFrame, columns, length: int = 20, keys=("series_id",)) -> DataFrame:
    """Arrays of the last ``length`` feature vectors; only rows with all of them complete."""
    w = chunk_window(keys).rowsBetween(-(length - 1), 0)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    df = add_chunks(df, back=length)
    df = df.withColumn("_v", F.when(complete, F.array(*[F.col(c).cast("double") for c in columns])))
    df = df.withColumn("sequence", F.collect_list("_v").over(w))
    return core_rows(df).drop("_v").filter(F.size("sequence") == length)
