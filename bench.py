"""Headline timings. Prints one JSON line.

Every query starts from the raw tables: stage tables of earlier queries are
forgotten before each run, so none is timed on another's work. The steps under
STORED are timed alone on stored forecasts, which are written before the clock starts.
"""

import json
import os
import time

from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import fixtures as fx
from volpanel.operators import features as ft
from volpanel.operators import boosting, folds, garch, metrics, robust, stattests, trees
from volpanel.operators.asof import asof_join
from volpanel.operators.panel import number_rows
from volpanel.plans import walkforward as wf
from volpanel.session import local_session
from volpanel.sources.stage import stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
H, YEARS, PARTIAL = fx.HORIZONS, fx.TEST_YEARS, fx.PARTIAL_YEAR


def run(df):
    df.write.format("noop").mode("overwrite").save()


def numbered(spark):
    return number_rows(stage(fx.observations(spark, SF_DIR, by_nation=True), "observations"))


def panel(spark):
    run(numbered(spark))


def features(spark):
    run(ft.build_features(numbered(spark)))


def walk_forward(spark):
    frame = stage(folds.model_frame(numbered(spark), H), "model_frame")
    run(metrics.fold_mean(metrics.fold_metrics(wf.level_predictions(frame, H, YEARS, PARTIAL))))


def log_models(spark):
    frame = stage(folds.model_frame(numbered(spark), H), "model_frame")
    run(wf.log_predictions(frame, H, YEARS, PARTIAL))


def comparison_tests(spark):
    frame = stage(folds.model_frame(numbered(spark), H), "model_frame")
    preds = stage(wf.level_predictions(frame, H, YEARS, PARTIAL, variants={k: C.HAR_VARIANTS[k] for k in ("har", "har_x")}), "preds")
    d = stage(stattests.loss_diff(preds, [("har", "har_x"), ("har_x", "past_vol")]), "losses")
    t = stattests.diebold_mariano(d).join(stattests.sign_test(d), list(stattests.KEYS))
    run(stattests.adjust(t.withColumn("family", F.lit("primary")), "p_hln", ["series_id", "family"]))


def variance_grid(spark):
    frame = stage(folds.model_frame(numbered(spark), H).select("series_id", "row_no", "year", "ret"), "returns")
    run(garch.fit_grid(garch.decay_table(frame), garch.fold_parameters(frame, YEARS)))


def asof(spark):
    e = fx.table(spark, SF_DIR, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view_id"))
    run(asof_join(left, right, ["user_id"], "ts", "vt", ["view_id"], tie=("view_id",)))


def tree_levels(spark):
    """80 folds of boosted trees at their tiers' sizes, scored (one series per order priority)."""
    frame = stage(folds.model_frame(number_rows(stage(fx.observations(spark, SF_DIR), "observations")), H), "model_frame")
    kept = trees.tree_rows(wf.level_rows(frame, H, ["series_id"]), wf.XS, "level")
    nodes = stage(boosting.fit_nodes(kept, YEARS), "nodes")
    run(trees.gbt_by_fold(kept, nodes, YEARS, PARTIAL, "level"))


PAIRS = [("har", "har_x"), ("har_x", "past_vol")]


def test_stage(preds):
    d = stage(stattests.loss_diff(preds, PAIRS), "losses")
    t = stattests.diebold_mariano(d).join(stattests.sign_test(d), list(stattests.KEYS))
    run(stattests.adjust(t.withColumn("family", F.lit("primary")), "p_hln", ["series_id", "family"]))


def power(preds):
    d = stage(stattests.loss_diff(preds, PAIRS), "losses")
    run(stattests.required_sample(stattests.diebold_mariano(d), F.lit(250.0)))
    run(stattests.sign_power(stattests.sign_test(d)))


def regime_and_tail(preds):
    run(robust.regime_split(preds, "har", "har_x"))
    run(robust.tail_robustness(preds, "har", "har_x", YEARS[-2]))


STORED = {"test_stage": test_stage, "power": power, "regime_and_tail": regime_and_tail}
QUERIES = {"panel": panel, "features": features, "walk_forward": walk_forward, "log_models": log_models,
           "comparison_tests": comparison_tests, "variance_grid": variance_grid, "asof_join": asof, "tree_levels": tree_levels}


def main():
    spark = local_session("bench", CPUS, CPUS)
    fx.table(spark, SF_DIR, "orders").count()
    times = {}
    for name, fn in QUERIES.items():
        fx.forget()
        t0 = time.time()
        fn(spark)
        times[name] = round(time.time() - t0, 3)
    frame = stage(folds.model_frame(numbered(spark), H), "model_frame")
    preds = stage(wf.level_predictions(frame, H, YEARS, PARTIAL), "preds")
    rows, series = frame.count(), frame.select("series_id").distinct().count()
    for name, fn in STORED.items():
        t0 = time.time()
        fn(preds)
        times[name] = round(time.time() - t0, 3)
    events = fx.table(spark, SF_DIR, "events").count()
    rates = {"feature_rows": rows / times["features"], "fits": series * len(H) * len(YEARS) * len(C.HAR_VARIANTS) / times["walk_forward"],
             "tests": series * len(H) * len(PAIRS) / times["test_stage"], "asof_rows": events / times["asof_join"]}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "per_second": {k: round(v, 1) for k, v in rates.items()},
                      "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
