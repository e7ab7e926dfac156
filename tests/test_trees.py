"""Node tables against an independent learner, and what the search shows its candidates."""

import datetime as dt
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from volpanel.operators import boosting as bo
from volpanel.operators import folds, search, trees

DAYS = 4 * 260


def series(name="s", horizon=5, seed=0):
    """Four years of 260 rows; three features, one of which matters."""
    r, out = np.random.default_rng(seed), []
    for i in range(DAYS):
        year, later = 2009 + i // 260, 2009 + (i + horizon) // 260
        f = [float(v) for v in r.normal(0, 1, 2)] + [float(i % 5)]
        out.append((name, dt.date(year, 1, 1) + dt.timedelta(days=i % 260), i, year, horizon, 0.02 + 0.004 * (f[0] > 0.3) + 0.001 * abs(f[1]),
                    0.01 if i >= 5 else None, later + 1 if i + horizon < DAYS else None, *f))
    return out


SCHEMA = "series_id string, obs_date date, row_no long, year int, horizon int, y double, past_vol double, fit_from int, a double, b double, c double"
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(series() + series("t", 22, 1), SCHEMA)


@pytest.fixture(scope="module")
def fitted(rows):
    kept = trees.tree_rows(rows, FEATURES, "level")
    return kept, bo.stage(bo.fit_nodes(kept, [2011, 2012]), "nodes")


def slow_trees(x, y, row_no, p, width):
    """The learner once more: plain loops over rows and thresholds, exact fractions for gains."""
    n = len(y)
    cuts = [[sorted(v[j] for v in x)[k * n // 32] for k in range(1, 32)] for j in range(width)]
    base = int(np.floor(sum(y) / n + 0.5))
    r, out = [v - base for v in y], {}
    keep = lambda item, tree: bool(bo.drawn(np.array([item]), tree)[0])
    for tree in range(p["trees"]):
        rows = [i for i in range(n) if keep(row_no[i], tree)]
        feats = [j for j in range(width) if keep(1000003 + j, tree)]

        def split(node, inside, drawn, depth, tree=tree, feats=feats):
            g = sum(r[i] for i in drawn)
            value = int(np.floor(p["step"] * (g / (len(drawn) + 1.0)) + 0.5))
            best = (0, None, None)
            for j in feats if depth < p["depth"] else []:
                for t in cuts[j]:
                    left = [i for i in drawn if x[i][j] < t]
                    if p["min_rows"] <= len(left) <= len(drawn) - p["min_rows"]:
                        gl = sum(r[i] for i in left)
                        gain = Fraction(gl * gl, len(left) + 1) + Fraction((g - gl) ** 2, len(drawn) - len(left) + 1) - Fraction(g * g, len(drawn) + 1)
                        if gain > best[0]:
                            best = (gain, j, t)
            out[tree, node] = (best[1], best[2], value, len(drawn))
            if best[1] is None:
                return {i: value for i in inside}
            go = lambda ids, right: [i for i in ids if (x[i][best[1]] >= best[2]) == right]
            return split(2 * node, go(inside, False), go(drawn, False), depth + 1) | split(2 * node + 1, go(inside, True), go(drawn, True), depth + 1)

        for i, v in split(1, range(n), rows, 0).items():
            r[i] -= v
    return base, out


def test_nodes_equal_a_plain_learner():
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 50, (120, 3))
    y = (x[:, 0] > 20) * 1000 + rnd.integers(0, 300, 120)
    row_no = np.arange(120) * 3
    p = {"trees": 6, "depth": 3, "step": 0.3, "min_rows": 5}
    nodes, base = bo.grow(x, y, row_no, p)
    want_base, want = slow_trees(x.tolist(), y.tolist(), row_no.tolist(), p, 3)
    assert base == want_base
    assert {(t, k): (j, c, v, n) for t, k, j, c, v, n in nodes} == want


def test_forecasts_follow_the_node_table(fitted):
    kept, nodes = fitted
    got = bo.score(kept, nodes, [2011, 2012]).filter("series_id = 's'").collect()
    table = {}
    for n in nodes.filter("series_id = 's'").collect():
        table.setdefault(n["test_year"], {})[n["tree"], n["node"]] = n
    feats = {r["row_no"]: bo.units(r["x"], bo.X_UNIT).tolist() for r in kept.filter("series_id = 's'").collect()}
    for g in got[::97]:
        t = table[g["test_year"]]
        raw = t[-1, 0]["value"]
        for tree in range(1 + max(k for k, _ in t)):
            k = 1
            while t[tree, k]["feature"] is not None:
                k = 2 * k + (feats[g["row_no"]][t[tree, k]["feature"]] >= t[tree, k]["threshold"])
            raw += t[tree, k]["value"]
        assert g["raw"] == raw / bo.UNIT
    train = kept.filter("series_id = 's' and fit_from <= 2011").count()
    assert sum(g["in_train"] for g in got if g["test_year"] == 2011) == train
    assert not any(g["in_train"] and g["row_no"] >= 2 * 260 - 5 for g in got if g["test_year"] == 2011)


def test_learning_does_not_depend_on_the_layout(spark, rows, fitted):
    again = bo.fit_nodes(trees.tree_rows(rows.repartition(7).orderBy(F.rand(3)), FEATURES, "level"), [2011, 2012])
    assert again.exceptAll(fitted[1]).count() == fitted[1].exceptAll(again).count() == 0


def test_losses_fall_to_those_of_the_forecasts(fitted):
    kept, nodes = fitted
    h = bo.loss_history(kept, nodes, [2011, 2012])
    last = {(r["series_id"], r["test_year"]): r["l"] for r in h.groupBy("series_id", "test_year").agg(F.max_by("loss", "epoch").alias("l")).collect()}
    final = bo.score(kept, nodes, [2011, 2012]).filter("in_train").groupBy("series_id", "test_year").agg(F.avg(F.pow(F.col("label") - F.col("raw"), 2)).alias("l"))
    for r in final.collect():
        assert last[r["series_id"], r["test_year"]] == pytest.approx(r["l"], rel=1e-6)
    first = {(r["series_id"], r["test_year"]): r["loss"] for r in h.filter("epoch = 0").collect()}
    assert all(last[k] < 0.5 * first[k] for k in first if k[0] == "s")


def test_attributions_add_up_and_find_the_feature(fitted):
    kept, nodes = fitted
    a = bo.attributions(kept, nodes, FEATURES, [2011, 2012])
    per_row = a.groupBy("series_id", "test_year", "row_no").agg(F.first("raw").alias("raw"), (F.first("common") + F.sum("attribution")).alias("t"))
    assert per_row.filter("abs(raw - t) > 1e-9").count() == 0 and per_row.count() == 2 * 2 * 260  # two series, two test years
    size = {r["feature"]: r["m"] for r in a.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("m")).collect()}
    assert size["a"] > 2 * size["b"] > 2 * size["c"]
    o = {r["feature"]: r["m"] for r in bo.occlusion(kept, nodes, FEATURES, [2011, 2012]).groupBy("feature").agg(F.avg("mean_abs").alias("m")).collect()}
    assert o["a"] > o["b"] > o["c"]


def test_validation_rows_are_not_learned_from(rows):
    """Training before the validation years; a label that only these years hold moves the score, not the fit."""
    bo_rows = trees.tree_rows(rows.filter("series_id = 's'"), FEATURES, "level")
    pdf = bo_rows.toPandas()
    x, row_no = bo._arrays(pdf)
    fit_from, year = pdf["fit_from"].to_numpy(float), pdf["year"].to_numpy()
    own, val = fit_from <= 2011, (year >= 2011) & (fit_from <= 2012)
    assert row_no[own].max() == 2 * 260 - 6 and row_no[val].min() == 2 * 260
    y = bo.units(pdf["y"], bo.UNIT)
    raws = bo.curve(x[own], y[own], row_no[own], x[val], {"trees": 12, "depth": 2, "step": 0.1, "min_rows": 5})
    for n in (1, 5, 12):
        nodes, base = bo.grow(x[own], y[own], row_no[own], {"trees": n, "depth": 2, "step": 0.1, "min_rows": 5})
        table = bo.pd.DataFrame([(-1, 0, None, None, base, 1), *nodes], columns=["tree", "node", "feature", "threshold", "value", "n_rows"])
        assert (bo.Forest(table).predict(x[val]) == raws[n - 1]).all()


def test_search_halves_and_refits_the_best(rows):
    own = rows.filter("series_id = 's'")
    kept = trees.tree_rows(own, FEATURES, "level")
    spans = folds.validation_span(own, [2012])
    t = bo.search_trials(kept, spans, [2012], lambda tier: [dict(p, trees=24) for p in trees.candidates(tier, 4)], "level").collect()
    assert [sum(r["round"] == k for r in t) for k in (1, 2)] == [4, 2]
    first = sorted((r["val_rmse"], r["trial"]) for r in t if r["round"] == 1)
    assert {r["trial"] for r in t if r["round"] == 2} == {i for _, i in first[:2]}
    assert all(r["trees"] <= (6 if r["round"] == 1 else 24) for r in t)
    best = bo.chosen(own.sparkSession.createDataFrame([tuple(r) for r in t], bo.search_trials(kept, spans, [2012], lambda _: [], "level").schema)).first()
    assert best["val_rmse"] == min(r["val_rmse"] for r in t)
    preds, trials = trees.validated_search(kept, spans, [2012], 2012, 2, "level")
    assert preds.count() == 260 and trials.count() >= 3


def test_levels_keep_rows_without_past_volatility(rows):
    own = rows.filter("series_id = 's'")
    assert trees.tree_rows(own, ["a"], "level").count() == DAYS and trees.tree_rows(own, ["a"], "ratio").count() == DAYS - 5


def test_empty_and_too_small(spark, rows):
    none = trees.tree_rows(rows.filter("false"), FEATURES, "level")
    assert bo.fit_nodes(none, [2012]).count() == 0
    few = trees.tree_rows(rows.filter("row_no < 3"), FEATURES, "level")
    nodes = bo.fit_nodes(few, [2008, 2012])
    assert {r["test_year"] for r in nodes.collect()} == {2012}
    assert bo.score(few, nodes, [2008, 2012]).filter("not in_train").count() == 0


def test_signal_of_ties_and_of_one_trial(spark):
    t = spark.createDataFrame([(5, 2012, 1, 0.5), (5, 2012, 0, 0.5), (5, 2013, 4, 0.25)], "horizon int, test_year int, trial int, val_rmse double")
    got = {r["test_year"]: r for r in search.selection_signal(t).collect()}
    assert got[2012]["best_trial"] == 0 and got[2012]["signal_pct"] == 0 and got[2012]["weak"] == 1
    assert got[2013]["n_trials"] == 1 and got[2013]["median"] == got[2013]["worst"] == 0.25
