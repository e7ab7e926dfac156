"""Distribution tails, vectorised over already aggregated rows.

Spark has no erf or incomplete beta and gamma, so these pandas UDFs finish
test tables (one row per test), never raw rows.
"""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, "float64")
    return np.array([fn(v) for v in x.ravel()], "float64").reshape(x.shape)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, "float64") / math.sqrt(2.0))


def _beta_fraction(a, b, x, steps: int = 100_000):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h, done = d.copy(), np.zeros(x.shape, bool)
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = np.where(done, h, h * d * c)
        done |= np.abs(d * c - 1.0) < 4e-15
        if done.all():
            return h
    raise ArithmeticError("incomplete beta did not converge")


def beta_inc(a, b, x, y=None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where the caller knows it better than x tells."""
    y = 1 - np.asarray(x, "float64") if y is None else y
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, "float64") for v in (a, b, x, y)))
    out = np.where(y <= 0, 1.0, 0.0)
    mid = (x > 0) & (y > 0)
    if mid.any():
        a, b, x, y = a[mid], b[mid], x[mid], y[mid]
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + np.where(x < y, a * np.log(x), a * np.log1p(-y)) + b * np.log(y))
        swap = x > (a + 1) / (a + b + 2)
        r = np.empty_like(x)
        # the fraction converges fast on its own side only
        for side, p, q, z in ((~swap, a, b, x), (swap, b, a, y)):
            if side.any():
                r[side] = front[side] * _beta_fraction(p[side], q[side], z[side]) / p[side]
        r[swap] = 1 - r[swap]
        out = out.astype("float64")
        out[mid] = r
    return out


#: Degrees of freedom from which t is normal to double precision at any usable t.
NORMAL_DF = 1e7


def t_sf_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); NaN for a NaN statistic or no degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, "float64"), np.asarray(df, "float64"))
    ok, far = (df > 0) & ~np.isnan(t), df >= NORMAL_DF
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        use = ok & ~far & np.isfinite(t)
        x, y = np.where(use, df / (df + t * t), 0.0), np.where(use, t * t / (df + t * t), 1.0)
        out = np.where(far, _erfc(np.abs(t) / math.sqrt(2.0)), beta_inc(np.where(ok & ~far, df, 1.0) / 2, 0.5, x, y))
    return np.where(ok, out, np.nan)


def _nullable(values: np.ndarray) -> pd.Series:
    """NaN, the mark of a test that cannot be made, as NULL."""
    return pd.Series(pd.array(values, dtype="Float64")).where(~np.isnan(values), None).astype(object)


def gamma_sf(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma Q(a, x): series below a+1, fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, "float64"), np.asarray(x, "float64"))
    out = np.ones(x.shape)
    for i in np.ndindex(x.shape):
        ai, xi = float(a[i]), float(x[i])
        if not xi > 0:
            continue
        front = math.exp(-xi + ai * math.log(xi) - math.lgamma(ai))
        if xi < ai + 1:
            term = total = 1.0 / ai
            n = ai
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= xi / n
                total += term
            out[i] = 1 - front * total
        else:
            b = xi + 1 - ai
            c, d = 1e300, 1 / b
            h = d
            for k in range(1, 1_000_000):
                an = -k * (k - ai)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 4e-15:
                    break
            else:
                raise ArithmeticError("incomplete gamma did not converge")
            out[i] = front * h
    return out


@F.pandas_udf(T.DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(_normal_cdf(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(lambda v: inv(v) if 0 < v < 1 else float("nan"))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|)."""
    return _nullable(t_sf_two_sided(t.to_numpy("float64"), df.to_numpy("float64")))


@F.pandas_udf(T.DoubleType())
def t_one_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T >= t)."""
    half = 0.5 * t_sf_two_sided(t.to_numpy("float64"), df.to_numpy("float64"))
    return _nullable(np.where(t.to_numpy("float64") >= 0, half, 1 - half))


@F.pandas_udf(T.DoubleType())
def t_cdf(t: pd.Series, df: pd.Series) -> pd.Series:
    half = 0.5 * t_sf_two_sided(t.to_numpy("float64"), df.to_numpy("float64"))
    return _nullable(np.where(t.to_numpy("float64") >= 0, 1 - half, half))


@F.pandas_udf(T.DoubleType())
def chi2_sf(q: pd.Series, df: pd.Series) -> pd.Series:
    q, df = q.to_numpy("float64"), df.to_numpy("float64")
    ok = (df > 0) & ~np.isnan(q)
    return _nullable(np.where(ok, gamma_sf(np.where(ok, df, 1.0) / 2, np.where(ok, q, 0.0) / 2), np.nan))


def binom_cdf(k, n, p) -> np.ndarray:
    """P(X <= k); k below 0 gives 0."""
    k, n, p = (np.asarray(v, "float64") for v in (k, n, p))
    k = np.broadcast_to(k, np.broadcast_shapes(k.shape, n.shape, p.shape)).copy()
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, beta_inc(np.maximum(n - k, 1e-9), np.maximum(k, 0) + 1, 1 - p)))


def _lower_critical(top: int, alpha: float) -> np.ndarray:
    """For n = 0..top the largest k with 2 P(X <= k | p = 1/2) <= alpha; -1 if none."""
    out = np.full(top + 1, -1, "int64")
    n = np.arange(top + 1)
    k = np.full(top + 1, -1, "int64")
    guess = np.maximum(np.floor(n / 2 - 1.5 * np.sqrt(n) - 2), -1).astype("int64")
    k = guess
    while True:
        up = 2 * binom_cdf(k + 1, n, 0.5) <= alpha
        up &= k + 1 < n / 2
        if not up.any():
            break
        k = np.where(up, k + 1, k)
    while True:
        down = (k >= 0) & (2 * binom_cdf(k, n, 0.5) > alpha)
        if not down.any():
            break
        k = np.where(down, k - 1, k)
    out[:] = k
    return out


def sign_power_values(n: np.ndarray, p: np.ndarray, critical: np.ndarray) -> np.ndarray:
    """Power of the exact two-sided sign test at true rate p."""
    k = critical[n]
    low = np.where(k >= 0, binom_cdf(k, n, p), 0.0)
    high = np.where(k >= 0, binom_cdf(k, n, 1 - p), 0.0)
    return low + high


def sign_tools(alpha: float, target: float, top: int):
    """(minimum significant wins, power, required folds) as pandas UDFs."""
    @F.pandas_udf(T.IntegerType())
    def min_wins(n: pd.Series) -> pd.Series:
        crit = _lower_critical(int(n.max()), alpha)
        k = crit[n.to_numpy("int64")]
        return pd.Series(np.where(k >= 0, n.to_numpy() - k, np.nan)).astype("Int32")

    @F.pandas_udf(T.DoubleType())
    def power(n: pd.Series, p: pd.Series) -> pd.Series:
        crit = _lower_critical(int(n.max()), alpha)
        return pd.Series(sign_power_values(n.to_numpy("int64"), p.to_numpy("float64"), crit))

    @F.pandas_udf(T.IntegerType())
    def required(n: pd.Series, p: pd.Series) -> pd.Series:
        crit = _lower_critical(top, alpha)
        sizes = np.arange(top + 1)
        found = {}
        for start, rate in set(zip(n.astype(int), p.astype(float))):
            if abs(rate - 0.5) < 1e-9:
                found[(start, rate)] = None
                continue
            at = sizes[max(start, 5):]
            enough = sign_power_values(at, np.full(len(at), rate), crit) >= target
            found[(start, rate)] = int(at[np.argmax(enough)]) if enough.any() else None
        return pd.Series([found[(int(a), float(b))] for a, b in zip(n, p)], dtype="Int32")

    return min_wins, power, required
