"""Chunks, running sums and as-of slices give what a single pass would give."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel.operators import features as ft
from volpanel.operators import panel as pn
from volpanel.operators import quality
from volpanel.operators.asof import asof_join


def make_panel(spark, n=2500, series=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    frames = []
    for i, s in enumerate(series):
        m = n // (i + 1)
        day = pd.date_range("2008-01-01", periods=m, freq="B")
        frames.append(pd.DataFrame({
            "series_id": s, "obs_date": day.date, "price": 50 * np.exp(np.cumsum(rng.normal(0, 0.02, m))),
            "implied": 30 + rng.normal(0, 3, m), "idx_a": 100 + rng.normal(0, 20, m), "idx_b": 90 + rng.normal(0, 20, m)}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(make_panel(spark), "series_id string, obs_date date, price double, implied double, idx_a double, idx_b double").cache()


def test_row_numbers(spark, obs):
    got = pn.number_rows(obs).toPandas().sort_values(["series_id", "obs_date"])
    assert (got.groupby("series_id").cumcount().to_numpy() == got["row_no"].to_numpy()).all()


def test_features_do_not_depend_on_the_chunk(spark, obs, monkeypatch):
    num = pn.number_rows(obs).cache()
    whole = ft.build_features(num).toPandas().sort_values(["series_id", "row_no"]).reset_index(drop=True)
    monkeypatch.setattr(pn, "CHUNK_ROWS", 1)  # the reach of the windows then sets the length
    cut = ft.build_features(num)
    assert pn.add_chunks(num, back=ft.ema_reach() + 1).select("_chunk").distinct().count() > 2
    cut = cut.toPandas().sort_values(["series_id", "row_no"]).reset_index(drop=True)
    for c in ft.FEATURES:
        np.testing.assert_allclose(cut[c].astype(float), whole[c].astype(float), rtol=1e-10, atol=1e-12, err_msg=c)


def test_features_against_pandas(spark, obs):
    got = ft.build_features(pn.number_rows(obs)).filter("series_id = 'a'").toPandas().sort_values("row_no")
    p = make_panel(spark).query("series_id == 'a'").reset_index(drop=True)
    ret = np.log(p.price / p.price.shift(1))
    want = {"price_ema20": p.price.ewm(span=20, adjust=False, min_periods=20).mean().shift(1),
            "idx_a_ema5": p.idx_a.ewm(span=5, adjust=False, min_periods=5).mean().shift(1),
            "price_vol126": ret.rolling(126).std().shift(1), "implied_lag3": p.implied.shift(3),
            "implied_z60": ((p.implied - p.implied.rolling(60).mean()) / p.implied.rolling(60).std()).shift(1)}
    for c, w in want.items():
        np.testing.assert_allclose(got[c].to_numpy(float), w.to_numpy(float), rtol=1e-9, err_msg=c)
    assert len(ft.FEATURES) == 65 == len(set(ft.FEATURES))
    assert got["implied_spike"].isna().sum() == 60


def test_valid_targets(spark, obs):
    f = ft.returns_and_targets(pn.number_rows(obs), (5, 22))
    n = {r["series_id"]: r for r in f.groupBy("series_id").agg(
        F.count("target_vol_5").alias("a"), F.count("target_vol_22").alias("b"), F.count("*").alias("n")).collect()}
    for r in n.values():
        assert r["a"] == r["n"] - 5 and r["b"] == r["n"] - 22


def test_decayed_sums_over_many_blocks(spark):
    x = np.random.default_rng(3).normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "row_no": np.arange(3000), "x": x}))
    for rows in (None, 1000):
        c = pn.add_chunks(df, back=2 * pn.decay_block(0.92) + 1, rows=rows)
        got = pn.core_rows(pn.decayed_sums(c, {"y": (F.col("x"), 0.92), "z": (F.col("x"), 0.7)})).toPandas().sort_values("row_no")
        for col, d in (("y", 0.92), ("z", 0.7)):
            s, want = 0.0, []
            for v in x:
                s = v + d * s
                want.append(s)
            np.testing.assert_allclose(got[col], want, rtol=1e-9, atol=1e-12)


def test_decays_too_far_apart(spark):
    df = spark.range(3).selectExpr("'s' as series_id", "id as row_no", "0L as _chunk")
    with pytest.raises(ValueError):
        pn.decayed_sums(df, {"a": (F.lit(1.0), 0.99), "b": (F.lit(1.0), 0.1)})


def test_running_sum_and_min_in_blocks(spark):
    x = np.random.default_rng(4).integers(0, 100, 500)
    df = spark.createDataFrame(pd.DataFrame({"k": "s", "row_no": np.arange(500), "x": x}))
    got = pn.running_sum(df, {"t": "x"}, ["k"], rows=37).toPandas().sort_values("row_no")
    assert (got["t"].to_numpy() == np.cumsum(x)).all()
    got = pn.running_min(df, "x", "m", ["k"], "row_no", F.floor(F.col("row_no") / 37), suffix=True).toPandas().sort_values("row_no")
    assert (got["m"].to_numpy() == np.minimum.accumulate(x[::-1])[::-1]).all()


@pytest.mark.parametrize("hot", [40, 10_000])
def test_asof_against_pandas(spark, hot):
    """With a hot key cut into slices, ties, NULL times and keys without a right row."""
    rng = np.random.default_rng(5)
    base = dt.datetime(2020, 1, 1)
    left = pd.DataFrame({"k": rng.choice(["hot", "b", "none"], 600, p=[0.8, 0.15, 0.05]),
                         "t": [base + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 5 * 86400, 600)], "id": np.arange(600)})
    right = pd.DataFrame({"k": rng.choice(["hot", "b"], 300), "u": [base + dt.timedelta(seconds=int(s) * 600) for s in rng.integers(0, 5 * 144, 300)],
                          "v": np.arange(300)})
    ldf = spark.createDataFrame(left).withColumn("t", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("t")))
    got = asof_join(ldf, spark.createDataFrame(right), ["k"], "t", "u", ["v"], tie=("v",), hot_rows=hot).toPandas().set_index("id")["v"]
    assert len(got) == 600
    for i, k, t in zip(left["id"], left["k"], left["t"]):
        r = right[(right["k"] == k) & (right["u"] <= t)].sort_values(["u", "v"])
        want = None if i % 50 == 0 or r.empty else r["v"].iloc[-1]
        assert (pd.isna(got[i]) and want is None) or got[i] == want


def test_out_of_order_across_blocks(spark):
    v = [1, 2, 3, 2, 5, 6, 1, 7]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(v)], "k string, pos long, x long")
    for block in (1, 2, 3, 100):
        got = sorted(r["pos"] for r in quality.out_of_order(df, ["k"], "pos", "x", block).collect())
        assert got == [3, 6], block


def test_feature_tables_of_both_alignments(spark, obs, tmp_path):
    from volpanel.plans.features import write_features, write_targets
    from volpanel.sources import io

    days = obs.select(F.col("obs_date").alias("day")).distinct()
    late = days.withColumn("publication_date", F.date_add("day", 3))
    write_features(obs, late, str(tmp_path))
    a, b = (io.read_table(spark, str(tmp_path), "features", v) for v in ("row", "published"))
    assert a.count() == b.count() == obs.count()
    shift = a.join(b.select("series_id", "row_no", F.col("idx_a_lag1").alias("p"), F.col("price_lag1").alias("q")), ["series_id", "row_no"])
    assert shift.filter(~F.col("price_lag1").eqNullSafe(F.col("q"))).count() == 0
    assert shift.filter(F.col("idx_a_lag1") != F.col("p")).count() > 1000
    write_targets(obs, (5,), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/targets").filter("target_vol_5 is null").count() == 10
