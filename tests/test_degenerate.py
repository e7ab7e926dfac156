"""Tests that cannot be made give NULL, never a small p-value."""

import math

import numpy as np
import pytest

from volpanel.functions import tails
from volpanel.operators import stattests


def preds(spark, days, bad=None):
    rows = []
    for t in range(days):
        y = math.sin(t) + 2
        for m, p in (("a", y + 0.3 * math.cos(3 * t)), ("b", y - 0.1 * math.sin(5 * t))):
            rows.append(("s", 5, 2000, f"2000-01-01T{t:05d}", t, m, y, bad if (bad is not None and t == 7 and m == "b") else p, True))
    return spark.createDataFrame(rows, "series_id string, horizon int, test_year int, obs_date string, row_no long, model string, y_true double, pred double, include_in_main boolean")


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_a_forecast_that_is_no_number_drops_its_day(spark, bad):
    d = stattests.loss_diff(preds(spark, 80, bad), [("a", "b")])
    assert d.count() == 79
    r = stattests.diebold_mariano(d).first()
    assert 0 < r["p_hln"] <= 1 and not math.isnan(r["dm_hln"])


def test_one_day_and_equal_models_have_no_p_value(spark):
    one = stattests.diebold_mariano(stattests.loss_diff(preds(spark, 1), [("a", "b")])).collect()
    assert all(r["p_hln"] is None for r in one)
    same = stattests.diebold_mariano(stattests.loss_diff(preds(spark, 30), [("a", "a")])).collect()
    assert all(r["p_hln"] is None or r["p_hln"] == 1.0 for r in same)


def test_tails_of_degenerate_values(spark):
    df = spark.createDataFrame([(float("nan"), 5.0), (None, 5.0), (1.0, 0.0), (1.0, None), (1.0, float("nan"))], "t double, df double")
    for f in (tails.t_two_sided, tails.t_one_sided, tails.t_cdf, tails.chi2_sf):
        assert [r[0] for r in df.select(f("t", "df")).collect()] == [None] * 5


def test_large_degrees_of_freedom_are_normal():
    assert abs(tails.t_sf_two_sided(np.array([1e-4]), np.array([1e9]))[0] - math.erfc(1e-4 / math.sqrt(2))) < 1e-12
    for df in (1.0, 30.0, 1e3, 1e5, 9e6):
        near = tails.t_sf_two_sided(np.array([1.96]), np.array([df]))[0]
        assert abs(near - math.erfc(1.96 / math.sqrt(2))) < 2 / df
    assert tails.t_sf_two_sided(np.array([np.inf]), np.array([4.0]))[0] == 0


def test_small_and_large_statistics_converge_side_by_side():
    t, df = (v.ravel() for v in np.meshgrid(np.geomspace(1e-8, 1e6, 57), [1, 2, 3.5, 10, 77, 500, 928, 4000, 1e5, 9e6]))
    p = tails.t_sf_two_sided(t, df)
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()
    exact = df == 1  # Cauchy, exact form
    assert np.allclose(p[exact], 2 * np.arctan2(1, t[exact]) / np.pi, rtol=1e-9, atol=1e-14)
    exact = df == 2
    x = t[exact]
    assert np.allclose(p[exact], 2 / ((x * x + 2) + x * np.sqrt(x * x + 2)), rtol=1e-9, atol=1e-14)
