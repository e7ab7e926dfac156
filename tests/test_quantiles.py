import numpy as np
import pytest

from volpanel.operators import folds, quantiles

YEARS = [2011, 2012, 2014]


def test_quantiles_of_nested_folds_equal_numpy(spark, monkeypatch):
    """Ties, a constant, far outliers, NULLs, an empty column and one value; few bands so that many rounds are needed."""
    r, rows = np.random.default_rng(2), []
    for s, n in (("a", 700), ("b", 90), ("c", 1)):
        for i in range(n):
            rows.append((s, int(r.integers(2009, 2015)), float(r.normal()), float(r.integers(0, 4)), 5.0, float(r.normal() * 10.0 ** r.integers(-8, 300)),
                         None if i % 3 else float(i), None, 1e308 if i % 2 else -1e308))
    names = ["x", "ties", "one", "wild", "gaps", "none", "ends"]
    df = spark.createDataFrame(rows, "s string, fit_from int, " + ", ".join(f"{c} double" for c in names))
    train = folds.bucketed(df.selectExpr("*", "1D as y"), YEARS)
    monkeypatch.setattr(quantiles, "BANDS", 64)
    got = {(g["s"], g["test_year"], g["feature"]): g for g in quantiles.fold_quantiles(train, names, [0.005, 0.5, 0.995], YEARS, ["s"]).collect()}
    seen = 0
    for s in "abc":
        for year in YEARS:
            for j, c in enumerate(names):
                v = np.array([w[2 + j] for w in rows if w[0] == s and w[1] <= year and w[2 + j] is not None], float)
                if not len(v):
                    assert (s, year, c) not in got
                    continue
                seen += 1
                g = got[s, year, c]
                assert (g["n"], g["lo"], g["hi"]) == (len(v), v.min(), v.max())
                for q, value in zip((0.005, 0.5, 0.995), g["q"], strict=True):
                    p = (len(v) - 1) * q
                    low, high = np.sort(v)[[int(np.floor(p)), int(np.ceil(p))]]
                    assert value == pytest.approx(low + (high - low) * (p - np.floor(p)), rel=1e-12, abs=1e-300) or not np.isfinite(high - low)
    assert seen > 40


def test_no_rows(spark):
    df = spark.createDataFrame([], "s string, fit_from int, x double")
    assert quantiles.fold_quantiles(df, ["x"], [0.5], YEARS, ["s"]).collect() == []
