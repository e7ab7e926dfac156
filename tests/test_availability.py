"""What the spoiled variants show, and how few rows they hold."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from volpanel.operators import robust
from volpanel.operators.alignment import release_monday
from volpanel.operators.panel import number_rows

N = 420


def panel(spark):
    r, rows = np.random.default_rng(1), []
    for i in range(N):
        rows.append(("s", dt.date(2010, 1, 1) + dt.timedelta(days=i), *[float(100 + v) for v in r.normal(0, 3, 4)]))
    return number_rows(spark.createDataFrame(rows, "series_id string, obs_date date, price double, implied double, idx_a double, idx_b double"))


def test_hidden_rows_are_counted_and_published_features_hold(spark):
    numbered = panel(spark)
    got = {r["t"]: r for r in robust.availability_sensitivity(numbered, F.col("row_no").isin(5, 200, 300, N - 1)).collect()}
    dates = {r["row_no"]: (r["obs_date"], r["p"]) for r in numbered.withColumn("p", release_monday(F.col("obs_date"))).collect()}
    for t, r in got.items():
        cut = dates[t - 1][0]
        assert r["n_perturbed"] == sum(p > cut for _, p in dates.values())
        assert r["n_changed_published"] == 0
        assert r["control_changed"] == (cut.isoweekday() != 1)
    assert set(got) == {5, 200, 300, N - 1}


def test_a_look_ahead_shows(spark, monkeypatch):
    real = robust.features_as_published
    seen = []

    def ahead(df, published, keys):
        seen.append(df)
        return real(df.withColumn(published, F.date_sub(published, 60)), published, keys)

    monkeypatch.setattr(robust, "features_as_published", ahead)
    got = robust.availability_sensitivity(panel(spark), F.col("row_no").isin(200)).first()
    assert got["n_changed_published"] > 0
    assert all(df.count() == 2 * robust.REACH + 1 for df in seen)
