"""Series with some returns removed: roll days, or days after a date gap.

Removed rows stay in place as NULLs, so windows keep their row distance.
"""

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators import features as ft
from volpanel.operators.panel import add_chunks, chunk_window, core_rows, running_sum


def add_clean_lags(df: DataFrame, keys, clean: str, lags) -> DataFrame:
    """``clean_lag<i>``: i-th most recent return that was not removed, however many were removed between.

    Kept returns are numbered; a row that has seen k of them before finds the
    i-th last as number k - i + 1, all lags in one equality join.
    """
    df = running_sum(df.withColumn("_kept", F.col(clean).isNotNull().cast("int")), {"_seen": "_kept"}, keys)
    df = df.withColumn("_at", F.col("_seen") - F.col("_kept"))
    kept = df.filter("_kept = 1").select(*keys, F.inline(F.array(*[
        F.struct((F.col("_seen") + (i - 1)).alias("_at"), F.lit(i).alias("_i"), F.col(clean).alias("_v")) for i in lags])))
    wide = kept.groupBy(*keys, "_at").agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"clean_lag{i}") for i in lags])
    return df.join(wide, [*keys, "_at"], "left").drop("_at", "_kept", "_seen")


def clean_std(clean: str, removed: str, original, w: WindowSpec, size: int):
    """Deviation over the window without removed rows; untouched windows keep the original."""
    frame = w.rowsBetween(-size, -1)
    left = F.when(F.count(clean).over(frame) >= 2, F.stddev_samp(clean).over(frame))
    return F.when(original.isNotNull(), F.when(F.max(removed).over(frame) > 0, left).otherwise(original))


def build_variant(numbered: DataFrame, horizons, keys=("series_id",), removed: str = "removed") -> DataFrame:
    """Targets, return features and past volatility without the removed returns.

    ``removed`` is 1 on rows whose own return is taken out. With no row removed
    every column equals its plain counterpart, bit for bit.
    """
    top = max(max(horizons), max(C.VOL_WINDOWS))
    w = chunk_window(keys)
    df = add_chunks(numbered, back=top + 1, ahead=max(horizons))
    df = df.withColumn("ret", ft.log_return("price", w))
    df = df.withColumn("clean", F.when(F.col(removed) == 0, F.col("ret")))
    cols = {}
    for i in C.LAGS:
        o = F.lag("ret", i).over(w)
        hit = F.max(removed).over(w.rowsBetween(-i, -1)) > 0
        cols |= {f"_plain{i}": o, f"_hit{i}": hit}
    for n in C.VOL_WINDOWS:
        cols[f"price_vol{n}"] = clean_std("clean", removed, ft.past_vol("ret", w, n), w, n)
    for h in horizons:
        y, ahead = ft.forward_vol("ret", w, h), w.rowsBetween(1, h)
        left = F.when(F.count("clean").over(ahead) >= 2, F.stddev_samp("clean").over(ahead))
        cols[f"target_vol_{h}"] = F.when(
            y.isNotNull(), F.when(F.max(removed).over(ahead) > 0, left).otherwise(y))
        cols[f"past_vol_{h}"] = clean_std("clean", removed, ft.past_vol("ret", w, h), w, h)
        cols[f"touched_{h}"] = F.coalesce(F.max(removed).over(ahead), F.lit(0))
        cols[f"fit_from_{h}"] = F.lead("year", h).over(w) + 1
    cols |= {f"{x}_lag1": F.lag(x, 1).over(w) for x in ("implied", *ft.INDEXES)}
    df = add_clean_lags(core_rows(df.withColumns(cols)), list(keys), "clean", C.LAGS)
    df = df.withColumns({f"price_ret_lag{i}": F.when(
        F.col(f"_plain{i}").isNotNull(), F.when(F.col(f"_hit{i}"), F.col(f"clean_lag{i}")).otherwise(F.col(f"_plain{i}"))) for i in C.LAGS})
    df = df.drop(*[f"{x}{i}" for i in C.LAGS for x in ("_plain", "_hit", "clean_lag")])
    a, e = F.abs("price_ret_lag1"), C.RATIO_EPS
    return df.withColumns({
        "har_daily": a,
        "vol_ratio": F.col("price_vol5") / (F.col("price_vol20") + e),
        "vol5_vol60": F.col("price_vol5") / (F.col("price_vol60") + e),
        "vol20_vol126": F.col("price_vol20") / (F.col("price_vol126") + e)})


def gap_adjusted_return(ret, skipped):
    """A return over k skipped days, scaled to one day: r / sqrt(1 + k)."""
    return ret / F.sqrt(F.lit(1.0) + skipped)
