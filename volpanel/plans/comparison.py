"""Predictions to the table of forecast comparison tests."""

from pyspark.sql import DataFrame

from volpanel.operators import stattests as st
from volpanel.sources.stage import stage


def comparison_table(preds: DataFrame, pairs, primary, ties: str = "loss") -> DataFrame:
    """Diebold-Mariano and sign tests of every pair, corrected inside each family of each series."""
    losses = stage(st.loss_diff(preds, pairs), "losses")  # read by both tests
    t = st.diebold_mariano(losses).join(st.sign_test(losses, ties), list(st.KEYS))
    t = t.withColumn("family", st.family_label(primary))
    for p in ("p_hln", "p_sign"):
        t = st.adjust(t, p, ["series_id", "family"])
    return st.direction_agreement(t.withColumn("stars", st.stars("p_hln")))
