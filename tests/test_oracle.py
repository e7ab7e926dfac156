"""Registered queries against their DuckDB statements at the smallest scale.

``VOLPANEL_ALL=1`` runs every query with a statement; the default is one of each kind.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare
from conftest import SF

CORE = """row_numbers lags forward_realized_vol rolling_vol ema feature_matrix features_as_published cumulative_counts
high_corr_pairs har_variants log_har_variants fold_metrics fold_mean walk_forward_comparison pooled_r2_oos qlike
loss_concentration fold_leakage inner_validation_split winsor_and_minmax newey_west diebold_mariano clark_west
adjusted_p_values sign_power ljung_box classify_gaps window_exposure contract_expiry roll_rows vintage_meta first_release
duplicate_keys out_of_order_rows same_table table_fingerprint read_observations asof_join regime_split tail_robustness
clean_return_lags clean_rolling_vol empty_mask_is_baseline garch_grid garch_forecast rank_stability
convergence_label suffix_minimum search_trials validated_search selection_signal best_in_family fold_correlation
near_floor markedly_low revisions_by mean_acf ratio_summary""".split()

ORACLES = entry.oracle_sql()
NAMES = list(ORACLES) if os.environ.get("VOLPANEL_ALL") else CORE


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches(spark, con, name):
    result, _, _ = compare(spark, con, SF, name, entry.queries()[name], ORACLES[name])
    assert result.startswith("ok"), result
