"""Fixed values of the evaluation design.

These must equal the published design for results to be comparable; none of
them is tuned here.
"""

# Horizons in rows, test design.
HORIZONS = (5, 22, 66, 126)
LONG_HORIZONS = (66, 126)          # the partial final year is left out here
FIRST_TEST_YEAR = 2012
LAST_TEST_YEAR = 2026

# Feature windows and thresholds.
LAGS = (1, 2, 3, 4, 5)
EMA_SPANS = (5, 10, 20)
VOL_WINDOWS = (5, 20, 60, 126)
Z_WINDOW = 60
SPIKE_Z = 2.0
REGIME_Z = 1.0
RATIO_EPS = 1e-9
CORR_THRESHOLD = 0.95

# Preprocessing and models.
WINSOR = (0.005, 0.995)
LOG_FLOOR = 1e-4
SMEARING_K = 10.0
SMEARING_WEAK = 1.02
VAL_MIN_EFFECTIVE = 3.0
MAX_VAL_YEARS = 6
SEARCH_MIN_EFFECTIVE = 10.0
MIN_TRAIN_ROWS = 200
SIGNAL_WEAK_PCT = 5.0
BLEND_WEIGHT = 0.5

# Capacity tiers (minimum effective observations, parameters).
TIERS = (
    (100.0, "high", {"trees": 400, "depth": 4, "min_rows": 1, "step": 0.05}),
    (30.0, "mid", {"trees": 150, "depth": 3, "min_rows": 20, "step": 0.05}),
    (0.0, "low", {"trees": 80, "depth": 2, "min_rows": 50, "step": 0.05}),
)

# Search bounds per tier (trees, depth, step, min_rows, subsample).
SEARCH_BOUNDS = {
    "high": {"trees": (200, 800), "depth": (3, 6), "step": (0.02, 0.15),
             "min_rows": (1, 20), "subsample": (0.6, 1.0)},
    "mid": {"trees": (60, 300), "depth": (2, 4), "step": (0.02, 0.10),
            "min_rows": (5, 50), "subsample": (0.6, 1.0)},
    "low": {"trees": (30, 150), "depth": (1, 3), "step": (0.01, 0.08),
            "min_rows": (20, 100), "subsample": (0.5, 0.9)},
}

# Regressors of the linear family, by variant.
HAR = ("har_daily", "price_vol5", "price_vol20")
HAR_VARIANTS = {
    "har": HAR,
    "har_implied": HAR + ("implied_lag1",),
    "har_index": HAR + ("idx_a_lag1", "idx_b_lag1"),
    "har_x": HAR + ("implied_lag1", "idx_a_lag1", "idx_b_lag1"),
}

# Tests.
ALPHA = 0.05
TARGET_POWER = 0.80
MAX_POWER_FOLDS = 5000
