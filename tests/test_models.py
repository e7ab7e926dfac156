"""Folds, least squares, tests and calendars against known answers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.functions import tails
from volpanel.operators import calendars as cal
from volpanel.operators import descriptive, folds, garch, linear, metrics, quality, trees
from volpanel.operators import stattests as st
from volpanel.operators.panel import number_rows
from volpanel.plans import walkforward as wf
from volpanel.sources import io

from test_panel import make_panel

YEARS, H = (2012, 2013, 2014), (5, 22)


@pytest.fixture(scope="module")
def frame(spark):
    obs = spark.createDataFrame(make_panel(spark), "series_id string, obs_date date, price double, implied double, idx_a double, idx_b double")
    return folds.model_frame(number_rows(obs), H).cache()


def test_least_squares_against_numpy(spark, frame):
    rows = wf.level_rows(frame, H, ["series_id"])
    got = wf.coefficients(rows, C.HAR_VARIANTS, YEARS, ["series_id"]).toPandas()
    pdf = rows.toPandas()
    first = pdf.groupby(["series_id", "year"])["row_no"].min()
    xs = list(C.HAR_VARIANTS["har_x"])
    checked = 0
    for r in got.itertuples():
        cols = list(C.HAR_VARIANTS[r.variant])
        if (r.series_id, r.test_year) not in first.index:
            continue
        t = pdf[(pdf.series_id == r.series_id) & (pdf.horizon == r.horizon) & (pdf.year < r.test_year)
                & (pdf.row_no + r.horizon < first[(r.series_id, r.test_year)])].dropna(subset=[*cols, "y"])
        b = np.linalg.lstsq(np.column_stack([np.ones(len(t)), t[cols]]), t["y"], rcond=None)[0]
        assert r.n == len(t) and r.y_min == t["y"].min()
        np.testing.assert_allclose([r.intercept, *[r.beta[xs.index(c)] for c in cols]], b, rtol=1e-6, atol=1e-10)
        checked += 1
    assert checked >= 4 * len(H) * len(YEARS)


def test_singular_design_keeps_the_prediction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    x = np.column_stack([x, x[:, 0] * 2])
    y = x[:, 0] + 0.1 * rng.normal(size=200)
    xc, yc = x - x.mean(0), y - y.mean()
    b = linear.solve_batch((xc.T @ xc)[None], (xc.T @ yc)[None])[0]
    want = np.linalg.lstsq(xc, yc, rcond=None)[0]
    np.testing.assert_allclose(b, want, rtol=1e-8)


def test_folds_do_not_leak_and_train_mean_scores_zero(spark, frame):
    rows = wf.level_rows(frame, H, ["series_id"])
    assert folds.fold_leakage(rows, YEARS).filter("leaks = 1").count() == 0
    m = metrics.fold_metrics(wf.level_predictions(frame, H, YEARS, 2014))
    tm = m.filter("model = 'train_mean'").toPandas()
    assert len(tm) and (tm["r2_oos"].abs() < 1e-12).all()
    assert set(m.select("model").distinct().toPandas()["model"]) == {*C.HAR_VARIANTS, "train_mean", "past_vol"}


def test_tail_functions():
    np.testing.assert_allclose(tails.t_sf_two_sided(np.array([2.0, 2.228139, 0.0]), np.array([10.0, 10.0, 5.0])), [0.07338803, 0.05, 1.0], atol=1e-7)
    np.testing.assert_allclose(tails.gamma_sf(np.array([10.0, 0.5]), np.array([31.41043 / 2, 3.841459 / 2])), [0.05, 0.05], atol=1e-6)
    np.testing.assert_allclose(tails._normal_cdf(np.array([1.959964, -1.0])), [0.975, 0.15865525], atol=1e-7)
    np.testing.assert_allclose(tails.binom_cdf(np.array([3.0, -1.0, 5.0]), np.array([10.0, 10.0, 5.0]), np.array([0.5, 0.5, 0.3])), [0.171875, 0, 1], atol=1e-12)


def test_sign_test_known_answers(spark):
    df = spark.createDataFrame([(13, 15), (7, 14), (0, 4)], "w long, n long")
    p = [r["p"] for r in df.select(st.binomial_two_sided(F.col("w"), F.col("n")).alias("p")).collect()]
    np.testing.assert_allclose(p, [0.00738525, 1.0, 0.125], atol=1e-7)
    crit = tails._lower_critical(15, 0.05)
    assert 15 - crit[15] == 12 and 14 - crit[14] == 12 and crit[5] == -1


def newey_west(x, lag):
    x = np.asarray(x) - np.mean(x)
    n = len(x)
    return x @ x / n + sum(2 * (1 - j / (lag + 1)) * (x[j:] @ x[:-j]) / n for j in range(1, min(lag, n - 1) + 1))


def test_long_run_variance(spark):
    rng = np.random.default_rng(2)
    rows = []
    for pair, n, h in (("a", 300, 22), ("b", 40, 60), ("c", 200, 1)):
        x = np.cumsum(rng.normal(size=n)) * 0.1 + 5
        rows += [("s", h, pair, 2000 + i // 90, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v), 0.0, 0.0, 0.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, horizon int, pair string, test_year int, obs_date date, d double, e1 double, e2 double, adjustment double")
    got = {r["pair"]: r for r in st.long_run_variance(df).collect()}
    for pair, h in (("a", 22), ("b", 60), ("c", 1)):
        x = [r[5] for r in rows if r[2] == pair]
        np.testing.assert_allclose(got[pair]["omega"], newey_west(x, h - 1), rtol=1e-9)
        np.testing.assert_allclose(got[pair]["gamma0"], np.var(x), rtol=1e-9)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("s", "f", str(i), v) for i, v in enumerate(p)], "series_id string, family string, pair string, p double")
    r = st.adjust(df, "p", ["series_id", "family"]).toPandas().sort_values("pair")
    np.testing.assert_allclose(r["p_holm"], [0.04, 0.09, 0.09, 0.5])
    np.testing.assert_allclose(r["p_bh"], [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    np.testing.assert_allclose(r["p_by"], np.minimum(np.array([0.04, 0.16 / 3, 0.16 / 3, 0.5]) * (1 + 1 / 2 + 1 / 3 + 1 / 4), 1))


# Published expiry dates by contract month.
EXPIRIES = """2015-12 13.11.2015 2016-01 16.12.2015 2016-02 14.01.2016 2016-03 29.01.2016 2016-04 29.02.2016 2016-05 31.03.2016
2016-06 29.04.2016 2016-07 31.05.2016 2016-08 30.06.2016 2016-09 29.07.2016 2016-10 31.08.2016 2016-11 30.09.2016 2016-12 31.10.2016
2017-01 30.11.2016 2017-02 29.12.2016 2017-03 31.01.2017 2017-04 28.02.2017 2017-05 31.03.2017 2017-06 28.04.2017 2017-07 31.05.2017
2017-08 30.06.2017 2017-09 31.07.2017 2017-10 31.08.2017 2017-11 29.09.2017 2017-12 31.10.2017 2018-01 30.11.2017 2018-02 28.12.2017
2018-03 31.01.2018 2018-04 28.02.2018 2018-05 29.03.2018 2018-06 30.04.2018 2018-07 31.05.2018 2018-08 29.06.2018 2018-09 31.07.2018
2018-10 31.08.2018 2018-11 28.09.2018 2018-12 31.10.2018 2019-01 30.11.2018 2019-02 28.12.2018 2019-03 31.01.2019 2019-04 28.02.2019
2019-05 29.03.2019 2019-06 30.04.2019 2019-07 31.05.2019 2019-08 28.06.2019 2019-09 31.07.2019 2019-10 30.08.2019 2019-11 30.09.2019
2019-12 31.10.2019 2020-01 29.11.2019 2020-02 30.12.2019 2020-03 31.01.2020 2020-04 28.02.2020 2020-05 31.03.2020 2020-06 30.04.2020
2020-07 29.05.2020 2020-08 30.06.2020 2020-09 31.07.2020 2020-10 28.08.2020 2020-11 30.09.2020 2020-12 30.10.2020 2021-01 30.11.2020
2021-02 30.12.2020 2021-03 29.01.2021 2021-04 26.02.2021 2021-05 31.03.2021 2021-06 30.04.2021 2021-07 28.05.2021 2021-08 30.06.2021
2021-09 30.07.2021 2021-10 31.08.2021 2021-11 30.09.2021 2021-12 29.10.2021 2022-01 30.11.2021 2022-02 30.12.2021 2022-03 31.01.2022
2022-04 28.02.2022 2022-05 31.03.2022 2022-06 29.04.2022 2022-07 31.05.2022 2022-08 30.06.2022 2022-09 29.07.2022 2022-10 31.08.2022
2022-11 30.09.2022 2022-12 31.10.2022 2023-01 30.11.2022 2023-02 29.12.2022 2023-03 31.01.2023""".split()


def test_expiry_calendar(spark):
    want = {k: dt.datetime.strptime(v, "%d.%m.%Y").date() for k, v in zip(EXPIRIES[::2], EXPIRIES[1::2])}
    assert len(want) == 88
    span = spark.sql("select date'2015-09-01' as first_day, date'2023-06-30' as last_day")
    hol = cal.holidays(cal.years_of(span))
    bd = cal.business_days(cal.calendar(span), hol, "england")
    months = spark.createDataFrame([(dt.date.fromisoformat(f"{k}-01"),) for k in want], "contract date")
    got = {r["contract"].strftime("%Y-%m"): r["expiry"] for r in cal.contract_expiry(months, bd, "2016-03-01").collect()}
    assert got == want


def test_one_off_holidays(spark):
    span = spark.sql("select date'2012-01-01' as first_day, date'2022-12-31' as last_day")
    h = cal.holidays(cal.years_of(span, 0)).toPandas()
    days = {k: set(map(str, g["day"])) for k, g in h.groupby("kind")}
    assert {"2012-06-04", "2012-06-05", "2020-05-08", "2022-06-02", "2022-06-03", "2022-09-19"} <= days["england"]
    assert "2020-05-04" not in days["england"] and "2022-05-30" not in days["england"]
    assert {"2012-10-29", "2018-12-05", "2019-04-19", "2022-06-20"} <= days["exchange"]
    assert "2021-12-31" not in days["exchange"] and "2021-12-31" in days["federal"] and "2021-06-18" in days["federal"]


def test_variance_path_against_the_recursion(spark):
    r = np.random.default_rng(6).normal(0, 1, 1500)
    pdf = pd.DataFrame({"series_id": "s", "row_no": np.arange(1, 1501), "year": 2000 + np.arange(1500) // 300, "ret": r})
    df = spark.createDataFrame(pdf)
    table = garch.decay_table(df)
    par = garch.fold_parameters(df, (2003,))
    p = par.first()
    j = table.join(par, "series_id").withColumn("s", garch.variance(0.87, F.lit(0.1))).toPandas().sort_values("row_no")
    s, want = p["var"], []
    for v in r:
        want.append(s)
        s = (1 - 0.97) * p["var"] + 0.1 * (v - p["mu"]) ** 2 + 0.87 * s
    np.testing.assert_allclose(j["s"], want, rtol=1e-9)
    assert p["n_train"] == 900


def test_adf_statistic(spark):
    rng = np.random.default_rng(8)
    walk, noise = np.cumsum(rng.normal(size=600)), rng.normal(size=600)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "s", "row_no": np.arange(600), "walk": walk, "noise": noise}))
    got = descriptive.adf(df, ["walk", "noise"], 4).toPandas().set_index("variable")
    for name, x in (("walk", walk), ("noise", noise)):
        d = np.diff(x)
        q = got.loc[name, "adf_lag"]
        y = d[q:]
        a = np.column_stack([np.ones(len(y)), x[q:-1], *[d[q - k:len(d) - k] for k in range(1, q + 1)]])
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        se = np.sqrt(e @ e / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        np.testing.assert_allclose(got.loc[name, "adf_stat"], b[1] / se, rtol=1e-6)
    assert got.loc["noise", "rejects_at_pct"] == "1" and got.loc["walk", "rejects_at_pct"] == "none"
    assert got.loc["noise", "p"] < 0.001 < 0.05 < got.loc["walk", "p"]


def test_adf_order_by_a_bound_that_follows_the_length(spark):
    """Each order fitted by itself on the common rows; short, long, constant and empty series."""
    rng, rows = np.random.default_rng(3), []
    series = {"a": np.cumsum(rng.normal(size=60)), "b": rng.normal(size=700), "flat": np.ones(50), "tiny": np.arange(3.0)}
    series["b"][8:] += 0.5 * series["b"][:-8]
    for name, x in series.items():
        rows += [(name, i, float(v)) for i, v in enumerate(x)]
    got = {r["series_id"]: r for r in descriptive.adf(spark.createDataFrame(rows, "series_id string, row_no long, x double"), ["x"]).collect()}
    assert set(got) == {"a", "b"}
    for name in got:
        x = series[name] - 7
        d, top = np.diff(x), descriptive.adf_top(len(x))
        assert top == {"a": 11, "b": 20}[name]

        def fit(q, start):
            t = np.arange(start, len(d))
            a = np.column_stack([np.ones(len(t)), x[t], *[d[t - k] for k in range(1, q + 1)]])
            b, *_ = np.linalg.lstsq(a, d[t], rcond=None)
            e = d[t] - a @ b
            return len(t), e @ e, b[1] / np.sqrt(e @ e / (len(t) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])

        aic = [n * np.log(rss / n) + 2 * (q + 2) for q in range(top + 1) for n, rss, _ in [fit(q, top)]]
        q = int(np.argmin(aic))
        assert got[name]["adf_lag"] == q and got[name]["n_used"] == len(d) - q
        np.testing.assert_allclose(got[name]["adf_stat"], fit(q, q)[2], rtol=1e-7)


def test_adf_p_meets_known_points():
    """The surface at the asymptotic critical values, and its two ends."""
    for level, stat in descriptive.ADF_CRITICAL.items():
        assert descriptive.adf_p(stat) == pytest.approx(int(level) / 100, abs=0.002)
    assert descriptive.adf_p(3) == 1 and descriptive.adf_p(-20) == 0
    assert abs(descriptive.adf_p(descriptive.ADF_STAR) - descriptive.adf_p(descriptive.ADF_STAR + 1e-9)) < 0.01


def test_schema_messages(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert quality.check_schema(df, ["a", "b"]) == [("warning", "columns in another order")]
    assert ("error", "missing column c") in quality.check_schema(df, ["a", "b", "c"])
    assert quality.check_schema(df, ["b"]) == [("warning", "extra column a")]


def test_validated_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, 2.0)], "k int, w double")
    assert quality.join_validated(a, b, ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        quality.join_validated(b, a, ["k"]).collect()
    with pytest.raises(Exception, match="positive"):
        quality.require_positive(b.withColumn("w", -F.col("w")), ["w"]).collect()


def test_vintage_files(spark, tmp_path):
    for day, n in (("20220228", 2), ("20220307", 3)):
        (tmp_path / f"data_daily_recent_{day}.csv").write_text("obs_date,value\n" + "".join(f"2022-02-0{i + 1},{i}.5\n" for i in range(n)))
    v = io.read_vintages(spark, str(tmp_path), "obs_date date, value double", "csv")
    got = {str(r["vintage_date"]): r["n"] for r in v.groupBy("vintage_date").agg(F.count("*").alias("n")).collect()}
    assert got == {"2022-02-28": 2, "2022-03-07": 3}


def test_tiers_and_candidates():
    assert [trees.tier_params(n)[0] for n in (100, 99.9, 30, 29, 0)] == ["high", "mid", "mid", "low", "low"]
    a, b = trees.candidates("mid", 5), trees.candidates("mid", 5)
    assert a == b and all(60 <= c["trees"] <= 300 and 2 <= c["depth"] <= 4 and 0.02 <= c["step"] <= 0.1 for c in a)
