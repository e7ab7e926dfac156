"""Boosted regression trees per series, horizon and fold, kept as a node table.

Groups are (series, horizon, ...): one row a day, so a group is bounded by the calendar. All folds of a group
are fitted in its task from one copy of its rows, as training sets are nested. Everything is exact
integer arithmetic on values rounded to fixed units: sums do not depend on the order of rows, so a
forecast is the same on any cluster, and SQL can follow it digit by digit.

One tree (``params``: trees, depth, step, min_rows):

* A feature has BINS - 1 thresholds, the training values at ranks k*n div BINS; values from the threshold on go right.
* Rows and features are drawn for each tree by :func:`drawn`, a fixed share of both.
* A node splits where G_l^2/(n_l + L2) + G_r^2/(n_r + L2) - G^2/(n + L2) is greatest and above 0, G sums of residuals, both sides with
  ``min_rows`` rows; ties to the first feature, then the lowest threshold.
* A node's value is step * G/(n + L2), rounded to units; leaves are taken off the residuals of all rows.

Node table: ``*keys, test_year, tree, node, feature, threshold, value, n_rows``; node 1 is a root, 2k and 2k+1 the sides of
k, ``feature`` is NULL at leaves. Tree -1 holds the mean that training starts from.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel import config as C
from volpanel.sources.stage import stage

KEYS = ("series_id", "horizon")
#: Bins of a feature, units of labels and features, weight of the L2 penalty, drawn share in thousandths.
BINS, UNIT, X_UNIT, L2, SHARE = 32, 1e9, 1e8, 1.0, 800
#: Modulus and factor of the draws (fixed values).
PRIME, FACTOR = 2147483647, 48271
NODES = ("test_year int, tree int, node int, feature int, threshold long, value long, n_rows long")


def drawn(items: np.ndarray, tree: int, share: int = SHARE) -> np.ndarray:
    a = (items * 7919 + tree * 104729 + 17) % PRIME
    for _ in range(3):
        a = (a * FACTOR + items) % PRIME
    return a % 1000 < share


def units(v, unit: float) -> np.ndarray:
    return np.floor(np.asarray(v, np.float64) * unit + 0.5).astype(np.int64)


def thresholds(x: np.ndarray) -> np.ndarray:
    """(BINS - 1, features) training values at fixed ranks."""
    return np.sort(x, axis=0)[np.arange(1, BINS) * len(x) // BINS]


def bin_codes(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many thresholds a value reaches."""
    return np.stack([np.searchsorted(cuts[:, j], x[:, j], side="right") for j in range(x.shape[1])], 1)


def tier_params(n_effective: float) -> tuple[str, dict]:
    for least, name, params in C.TIERS:
        if n_effective >= least:
            return name, params
    raise AssertionError("the last tier starts at zero")


def grow(x: np.ndarray, y: np.ndarray, row_no: np.ndarray, params: dict) -> tuple[list, int]:
    """(node rows (tree, node, feature, threshold, value, n), base) of one training set."""
    n, width = x.shape
    cuts = thresholds(x)
    codes = bin_codes(x, cuts)
    base = int(np.floor(float(y.sum()) / n + 0.5))
    r = (y - base).astype(np.float64)  # sums of integers below 2^53 are exact
    every, out = np.arange(n), []
    for tree in range(params["trees"]):
        rows = np.flatnonzero(drawn(row_no, tree, params.get("share", SHARE)))
        feats = np.flatnonzero(drawn(1000003 + np.arange(width), tree))
        node = np.ones(n, np.int64)
        at = codes[np.ix_(rows, feats)] + np.arange(len(feats)) * BINS
        open_nodes, rs, splits = [1], r[rows], []
        for _ in range(params["depth"]):
            local = np.full(2 << params["depth"], -1)
            local[open_nodes] = np.arange(len(open_nodes))
            here = local[node[rows]]
            used = here >= 0
            if not used.any() or not len(feats):
                break
            cell = (at[used] + here[used][:, None] * (len(feats) * BINS)).ravel()
            shape = (len(open_nodes), len(feats), BINS)
            g = np.bincount(cell, np.repeat(rs[used], len(feats)), np.prod(shape)).reshape(shape).cumsum(2)
            c = np.bincount(cell, minlength=np.prod(shape)).reshape(shape).cumsum(2).astype(np.float64)
            gl, cl, gt, ct = g[:, :, :-1], c[:, :, :-1], g[:, :, -1:], c[:, :, -1:]
            gr, cr = gt - gl, ct - cl
            gain = gl * gl / (cl + L2) + gr * gr / (cr + L2) - gt * gt / (ct + L2)
            gain[(cl < params["min_rows"]) | (cr < params["min_rows"])] = -1.0
            best = gain.reshape(len(open_nodes), -1).argmax(1)
            split = {}
            for i, k in enumerate(open_nodes):
                j, b = divmod(int(best[i]), BINS - 1)
                if gain[i, j, b] > 0:
                    split[k] = (int(feats[j]), b + 1)
            if not split:
                break
            feature, cut = np.zeros(2 << params["depth"], np.int64), np.full(2 << params["depth"], -1)
            for k, (j, b) in split.items():
                feature[k], cut[k] = j, b
                splits.append((k, j, int(cuts[b - 1, j])))
            moved = cut[node] >= 0
            node = np.where(moved, 2 * node + (codes[every, feature[node]] >= cut[node]), node)
            open_nodes = [m for k in split for m in (2 * k, 2 * k + 1)]
        size = 2 << params["depth"]
        g, c = np.bincount(node[rows], rs, size), np.bincount(node[rows], minlength=size)
        for k in range(size // 2 - 1, 0, -1):  # sums of inner nodes
            g[k] += g[2 * k] + g[2 * k + 1]
            c[k] += c[2 * k] + c[2 * k + 1]
        value = np.floor(params["step"] * (g / (c + L2)) + 0.5)
        r -= value[node]
        leaves = [(int(k), None, None) for k in np.unique(node)]
        out += [(tree, k, j, cut, int(value[k]), int(c[k])) for k, j, cut in splits + leaves]
    return out, base


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return units(np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1), X_UNIT), pdf["row_no"].to_numpy(np.int64)


def _label(labels: list, k: int) -> np.ndarray:
    """Labels of fold k: one for all folds, or one for each."""
    return np.array([np.nan if v is None or len(v) == 0 else (v[k] if len(v) > 1 else v[0]) for v in labels], np.float64)


def _schema(rows: DataFrame, keys, ddl: str) -> T.StructType:
    extra = rows.sparkSession.createDataFrame([], ddl).schema
    return T.StructType([*[rows.schema[k] for k in keys], *extra.fields])


def fold_nodes(x, row_no, fit_from, y, year: int, horizon: int, params: dict | None) -> list:
    """Node rows of one fold; the tier's parameters unless others are given."""
    own = (fit_from <= year) & np.isfinite(y)
    if not own.any():
        return []
    nodes, base = grow(x[own], units(y[own], UNIT), row_no[own], params or tier_params(own.sum() / horizon)[1])
    return [(year, -1, 0, None, None, base, int(own.sum())), *[(year, *n) for n in nodes]]


def fit_nodes(rows: DataFrame, test_years, keys=KEYS, params: dict | None = None) -> DataFrame:
    """The node table of all groups and folds.

    ``rows``: keys, ``row_no``, ``fit_from``, ``x`` (features) and ``labels``, an array with one label for all folds
    or one per test year. A row trains in folds from ``fit_from`` on, where it has a label. The tier follows the
    training rows over the horizon unless ``params`` are given; a fold without training rows has no nodes.
    """
    years, keys = [int(y) for y in test_years], list(keys)

    def run(key, pdf):
        pdf = pdf.sort_values("row_no", kind="stable")
        x, row_no = _arrays(pdf)
        horizon, fit_from, out = dict(zip(keys, key, strict=True))["horizon"], pdf["fit_from"].to_numpy(np.float64), []
        for k, year in enumerate(years):
            out += fold_nodes(x, row_no, fit_from, _label(pdf["labels"].tolist(), k), year, horizon, params)
        return _frame(key, keys, out, ["test_year", "tree", "node", "feature", "threshold", "value", "n_rows"])

    df = rows.select(*keys, "row_no", "fit_from", "x", "labels")
    return df.groupBy(*keys).applyInPandas(run, _schema(rows, keys, NODES))


def _frame(key, keys, out: list, columns: list) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=columns)
    if "threshold" in df:  # a node table: NULL at leaves
        df = df.astype({"feature": "Int64", "threshold": "Int64"})
    for i, (k, v) in enumerate(zip(keys, key, strict=True)):
        df.insert(i, k, v)
    return df


class Forest:
    """The trees of one fold, from its part of the node table."""

    def __init__(self, nodes: pd.DataFrame):
        mean = nodes["tree"].to_numpy() == -1
        self.base = int(nodes.loc[mean, "value"].iloc[0])
        trees = nodes[~mean]
        self.n, size = int(trees["tree"].max()) + 1 if len(trees) else 0, int(trees["node"].max()) + 1 if len(trees) else 2
        self.feature, self.cut, self.value = np.full((self.n, size), -1), np.zeros((self.n, size), np.int64), np.zeros((self.n, size), np.int64)
        at = trees["tree"].to_numpy(np.int64), trees["node"].to_numpy(np.int64)
        self.feature[at] = trees["feature"].astype("Int64").fillna(-1).to_numpy(np.int64)
        self.cut[at] = trees["threshold"].astype("Int64").fillna(0).to_numpy(np.int64)
        self.value[at] = trees["value"].to_numpy(np.int64)
        self.depth = size.bit_length() - 1

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tree, nodes of the rows, features that led there or -1) step by step, the root first."""
        every = np.arange(len(x))
        for t in range(self.n):
            node = np.ones(len(x), np.int64)
            yield t, node, np.full(len(x), -1)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + (x[every, f] >= self.cut[t, node]), node)
                yield t, node, f

    def staged(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The forecast before the first tree and after each, in units."""
        raw = np.full(len(x), self.base, np.int64)
        yield raw
        at, last = None, 0
        for t, node, _ in self.walk(x):
            if t != last:
                raw = raw + self.value[last, at]
                yield raw
                last = t
            at = node
        if self.n:
            yield raw + self.value[last, at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        *_, raw = self.staged(x)
        return raw

    def contributions(self, x: np.ndarray, width: int) -> tuple[int, np.ndarray]:
        """(common part, parts by feature): the change of the node value at each step, so all add up to the forecast."""
        parts, every, common = np.zeros((len(x), width), np.int64), np.arange(len(x)), self.base
        before = None
        for t, node, f in self.walk(x):
            if (f < 0).all() and (node == 1).all():
                common += int(self.value[t, 1])
            else:
                moved = f >= 0
                parts[every[moved], f[moved]] += (self.value[t, node] - self.value[t, before])[moved]
            before = node
        return common, parts


def _folds(years, pdf: pd.DataFrame, nodes: pd.DataFrame):
    """(fold index, year, trees, rows in training, rows of the test year)."""
    fit_from, year_of = pdf["fit_from"].to_numpy(np.float64), pdf["year"].to_numpy()
    by = dict(list(nodes.groupby("test_year")))
    for k, year in enumerate(years):
        if year in by:
            y = _label(pdf["labels"].tolist(), k)
            yield k, year, Forest(by[year]), (fit_from <= year) & np.isfinite(y), year_of == year, y


def _cogrouped(rows: DataFrame, nodes: DataFrame, keys, fn, ddl: str) -> DataFrame:
    left = rows.select(*keys, "row_no", "year", "fit_from", "x", "labels")
    schema = _schema(rows, keys, ddl)
    names = [f.name for f in schema.fields][len(keys):]

    def run(key, pdf, trees):
        out = list(fn(pdf.sort_values("row_no", kind="stable"), trees)) if len(pdf) and len(trees) else []
        return _frame(key, keys, out, names)

    return left.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInPandas(run, schema)


def score(rows: DataFrame, nodes: DataFrame, test_years, keys=KEYS) -> DataFrame:
    """``*keys, test_year, row_no, in_train, label, raw``: training and test rows of every fold with their forecasts."""
    years = [int(y) for y in test_years]

    def run(pdf, trees):
        x, row_no = _arrays(pdf)
        for _, year, forest, train, test, y in _folds(years, pdf, trees):
            own = np.flatnonzero(train | test)
            raw = forest.predict(x[own]) / UNIT
            for i, v in zip(own.tolist(), raw.tolist(), strict=True):
                yield year, int(row_no[i]), bool(train[i]), float(y[i]) if np.isfinite(y[i]) else None, v

    return _cogrouped(rows, nodes, list(keys), run, "test_year int, row_no long, in_train boolean, label double, raw double")


def loss_history(rows: DataFrame, nodes: DataFrame, test_years, keys=KEYS) -> DataFrame:
    """``*keys, test_year, epoch, loss``: the mean squared training error before the first tree (epoch 0) and after each."""
    years = [int(y) for y in test_years]

    def run(pdf, trees):
        x, _ = _arrays(pdf)
        for _, year, forest, train, _, y in _folds(years, pdf, trees):
            target = units(y[train], UNIT)
            for epoch, raw in enumerate(forest.staged(x[train])):
                yield year, epoch, float(np.mean(((target - raw) / UNIT) ** 2))

    return _cogrouped(rows, nodes, list(keys), run, "test_year int, epoch int, loss double")


def attributions(rows: DataFrame, nodes: DataFrame, features, test_years, keys=KEYS) -> DataFrame:
    """``*keys, test_year, row_no, raw, common, feature, x, attribution`` of the test rows; a row's attributions and
    ``common`` add up to ``raw``."""
    years, names = [int(y) for y in test_years], list(features)

    def run(pdf, trees):
        x, row_no = _arrays(pdf)
        for _, year, forest, _, test, _ in _folds(years, pdf, trees):
            own = np.flatnonzero(test)
            raw = forest.predict(x[own])
            common, parts = forest.contributions(x[own], len(names))
            for i, total, p in zip(own.tolist(), raw.tolist(), (parts / UNIT).tolist(), strict=True):
                yield year, int(row_no[i]), total / UNIT, common / UNIT, pdf["x"].iloc[i], p

    wide = _cogrouped(rows, nodes, list(keys), run, "test_year int, row_no long, raw double, common double, x array<double>, parts array<double>")
    named = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("x"), F.col("parts").alias("attribution"))
    return wide.select(*keys, "test_year", "row_no", "raw", "common", F.inline(named).alias("feature", "x", "attribution"))


def occlusion(rows: DataFrame, nodes: DataFrame, features, test_years, keys=KEYS) -> DataFrame:
    """``*keys, test_year, feature, mean_abs``: mean change of the test forecasts when a feature takes its training mean."""
    years, names = [int(y) for y in test_years], list(features)

    def run(pdf, trees):
        x, _ = _arrays(pdf)
        for _, year, forest, train, test, _ in _folds(years, pdf, trees):
            own, mean = x[test], np.floor(x[train].mean(0) + 0.5).astype(np.int64)
            full = forest.predict(own)
            for j, name in enumerate(names):
                held = own.copy()
                held[:, j] = mean[j]
                if len(own):
                    yield year, name, float(np.abs(forest.predict(held) - full).mean() / UNIT)

    return _cogrouped(rows, nodes, list(keys), run, "test_year int, feature string, mean_abs double")


def curve(x, y, row_no, val_x, params: dict) -> np.ndarray:
    """Forecasts of the validation rows after 1, 2, ... trees of one fit, in units."""
    nodes, base = grow(x, y, row_no, params)
    table = pd.DataFrame([(-1, 0, None, None, base, len(y)), *nodes], columns=["tree", "node", "feature", "threshold", "value", "n_rows"])
    return np.array(list(Forest(table).staged(val_x))[1:])


def validation_score(raw: np.ndarray, y: np.ndarray, label: np.ndarray, past_vol: np.ndarray, horizon: int, mode: str):
    """(raw smearing, shrunk smearing, RMSE) of validation forecasts; levels have a smearing of 1."""
    if mode == "level":
        return 1.0, 1.0, float(np.sqrt(np.mean((y - raw) ** 2)))
    whole = float(np.mean(np.exp(label - raw)))
    n = len(y) / horizon
    shrunk = 1 + n / (n + C.SMEARING_K) * (whole - 1)
    return whole, shrunk, float(np.sqrt(np.mean((y - np.exp(raw) * shrunk * (past_vol if mode == "ratio" else 1.0)) ** 2)))


TRIALS = ("test_year int, trial int, round int, tier string, trees int, depth int, step double, min_rows int, share int, n_train int, n_val int, "
          "smearing_raw double, smearing double, val_rmse double")


def search_trials(rows: DataFrame, spans: DataFrame, test_years, candidates, mode: str = "ratio", keys=KEYS) -> DataFrame:
    """One row per candidate and round: its best number of trees on the embargoed validation years of each fold.

    ``candidates(tier)`` lists parameter sets. A fit serves all tree counts up to its own: its staged forecasts are
    scored after every tree. In the first round every candidate grows a quarter of its trees, in the second the
    better half grows all. Training rows are those whose target ends before the validation years
    (``fit_from`` up to the first); scores include the shrunk smearing. Folds with too few rows have no trials.
    """
    years, keys = [int(y) for y in test_years], list(keys)
    cuts = spans.select(*keys, "test_year", (F.col("test_year") - F.col("n_val_years")).alias("first_val"))
    left = rows.select(*keys, "row_no", "year", "fit_from", "x", "labels", "y", "past_vol")

    def fold(pdf, x, row_no, horizon, k, year, first):
        y = _label(pdf["labels"].tolist(), k)
        fit_from, level, past = pdf["fit_from"].to_numpy(np.float64), pdf["y"].to_numpy(np.float64), pdf["past_vol"].to_numpy(np.float64)
        proper, val = (fit_from <= first) & np.isfinite(y), (pdf["year"].to_numpy() >= first) & (fit_from <= year) & np.isfinite(y)
        n, m = int(proper.sum()), int(val.sum())
        if n < C.MIN_TRAIN_ROWS or not m or n / horizon < C.SEARCH_MIN_EFFECTIVE or m / horizon < C.VAL_MIN_EFFECTIVE:
            return
        tier, done = tier_params(n / horizon)[0], []
        picks = list(enumerate(candidates(tier)))
        for turn, part in ((1, 0.25), (2, 1.0)):
            scores = []
            for i, p in picks:
                raws = curve(x[proper], units(y[proper], UNIT), row_no[proper], x[val], dict(p, trees=max(1, int(p["trees"] * part)))) / UNIT
                each = [validation_score(raw, level[val], y[val], past[val], horizon, mode) for raw in raws]
                best = min(range(len(each)), key=lambda t: each[t][2])
                scores.append((each[best][2], i, p))
                done.append((year, i, turn, tier, best + 1, p["depth"], p["step"], p["min_rows"], p["share"], n, m, *each[best]))
            picks = [(i, p) for _, i, p in sorted(scores, key=lambda s: s[:2])[:max(1, len(scores) // 2)]]
        yield from done

    def run(key, pdf, own):
        out = []
        if len(pdf) and len(own):
            pdf = pdf.sort_values("row_no", kind="stable")
            x, row_no = _arrays(pdf)
            horizon, first = dict(zip(keys, key, strict=True))["horizon"], dict(zip(own["test_year"], own["first_val"], strict=True))
            for k, year in enumerate(years):
                if year in first:
                    out += fold(pdf, x, row_no, horizon, k, year, first[year])
        return _frame(key, keys, out, [c.split()[0] for c in TRIALS.split(", ")])

    return left.groupBy(*keys).cogroup(cuts.groupBy(*keys)).applyInPandas(run, _schema(rows, keys, TRIALS))


def chosen(trials: DataFrame, keys=KEYS) -> DataFrame:
    """The trial with the least validation RMSE of each fold; ties to the first trial of the later round."""
    best = F.min_by(F.struct("trial", "trees", "depth", "step", "min_rows", "share", "smearing", "val_rmse"),
                    F.struct("val_rmse", F.negative("round"), "trial"))
    return trials.groupBy(*keys, "test_year").agg(best.alias("b")).select(*keys, "test_year", "b.*")


def refit(rows: DataFrame, picks: DataFrame, test_years, keys=KEYS) -> DataFrame:
    """The node table of whole training sets with the parameters chosen per fold; other folds keep their tier's."""
    years, keys = [int(y) for y in test_years], list(keys)

    def run(key, pdf, own):
        out, by = [], {r.test_year: {"trees": r.trees, "depth": r.depth, "step": r.step, "min_rows": r.min_rows, "share": r.share} for r in own.itertuples()}
        if len(pdf):
            pdf = pdf.sort_values("row_no", kind="stable")
            x, row_no = _arrays(pdf)
            horizon, fit_from = dict(zip(keys, key, strict=True))["horizon"], pdf["fit_from"].to_numpy(np.float64)
            for k, year in enumerate(years):
                out += fold_nodes(x, row_no, fit_from, _label(pdf["labels"].tolist(), k), year, horizon, by.get(year))
        return _frame(key, keys, out, ["test_year", "tree", "node", "feature", "threshold", "value", "n_rows"])

    left = rows.select(*keys, "row_no", "fit_from", "x", "labels")
    return left.groupBy(*keys).cogroup(picks.groupBy(*keys)).applyInPandas(run, _schema(rows, keys, NODES))


def smearing(scored: DataFrame, rows: DataFrame, keys=KEYS) -> DataFrame:
    """Per fold: mean of exp(residual), training size, mean and floor of the target."""
    s = scored.filter("in_train").join(rows.select(*keys, "row_no", "y"), [*keys, "row_no"])
    return s.groupBy(*keys, "test_year").agg(
        F.avg(F.exp(F.col("label") - F.col("raw"))).alias("smearing"), F.min("y").alias("floor"), F.avg("y").alias("train_mean"),
        F.count(F.lit(1)).alias("n_train"))


def stored(rows: DataFrame, features, labels, *extra: str, keys=KEYS) -> DataFrame:
    """The rows of :func:`fit_nodes` as a stage table: features packed once, next to the columns named."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    base = [c for c in dict.fromkeys([*keys, "obs_date", "row_no", "year", "fit_from", "y", "past_vol", *extra])]
    return stage(rows.select(*base, x, labels.alias("labels")), "boosting_rows")
