"""Validation, sources and sinks, and the relational operators."""

from pyspark.sql import functions as F

from volpanel.catalog import fixtures as fx
from volpanel.catalog import window_queries as wq
from volpanel.catalog.forecast_queries import fold_table, frame, level
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.operators import features as ft
from volpanel.operators import quality as ql
from volpanel.operators.panel import number_rows

H = fx.HORIZONS
OBS = ("series_id", "obs_date", "price", "implied", "idx_a", "idx_b")
KEY_SQL = wq.KEY_SQL


@query("schema_and_nulls", with_parts("SELECT c AS \"column\", n AS n_null, 0 AS n_schema_messages FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS n FROM obs" for c in OBS) + ")", "obs"))
def schema_and_nulls(spark, sf_dir):
    obs = fx.panel(spark, sf_dir).select(*OBS)
    return ql.null_counts(obs, OBS).withColumn("n_schema_messages", F.lit(len(ql.check_schema(obs, OBS))))


TEXT_SQL = "CASE WHEN l_discount > 0.09 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN l_tax > 0.07 THEN '31.02.1999' ELSE strftime(l_shipdate, '%d.%m.%Y') END"


@query("unparseable_dates", f"""SELECT l_orderkey, l_linenumber, t AS day_text FROM (SELECT *, {TEXT_SQL} AS t FROM lineitem) WHERE try_strptime(t, '%d.%m.%Y') IS NULL""")
def unparseable_dates(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    text = (F.when(F.col("l_discount") > 0.09, F.date_format("l_shipdate", "yyyy/MM/dd"))
            .when(F.col("l_tax") > 0.07, "31.02.1999").otherwise(F.date_format("l_shipdate", "dd.MM.yyyy")))
    return ql.unparseable_dates(li.select("l_orderkey", "l_linenumber", text.alias("day_text")), "day_text")


@query("duplicate_keys", with_parts("""SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, count(*) AS n FROM (
SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE price > 150000) GROUP BY ALL HAVING count(*) > 1""", "obs"))
def duplicate_keys(spark, sf_dir):
    obs = fx.panel(spark, sf_dir).select(*OBS)
    return ql.duplicate_keys(obs.unionByName(obs.filter("price > 150000")), ["series_id", "obs_date"])


@query("out_of_order_rows", """SELECT series_id, count(*) AS n, min(o_orderkey) AS first_row FROM (
SELECT o_orderpriority AS series_id, o_orderkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS bad FROM orders) WHERE bad GROUP BY ALL""")
def out_of_order_rows(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_id"), "o_orderkey", "o_orderdate")
    return ql.out_of_order(o, ["series_id"], "o_orderkey", "o_orderdate", 5000).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_row"))


@query("anchor_value", with_parts("""SELECT count(*) AS n_found, count(*) FILTER (WHERE abs(implied - 25.5) < 5) AS n_matching FROM obs WHERE obs_date = DATE '1998-01-05'""", "obs"))
def anchor_value(spark, sf_dir):
    return ql.anchor_value(fx.panel(spark, sf_dir), F.col("obs_date") == F.lit("1998-01-05").cast("date"), "implied", 25.5, 5)


@query("argmax_row", with_parts(f"SELECT series_id, {rd('max(price) + 0.0000314159265', 2)} AS price, CAST(arg_max(obs_date, price) AS VARCHAR) AS obs_date FROM obs GROUP BY ALL", "obs"))
def argmax_row(spark, sf_dir):
    out = ql.argmax_row(fx.panel(spark, sf_dir), "price", ["obs_date"], ["series_id"])
    return out.withColumn("price", F.round(F.col("price") + 0.0000314159265, 2) + 0.0)


@query("long_gaps", with_parts("""SELECT series_id, CAST(prev_date AS VARCHAR) AS prev_date, CAST(obs_date AS VARCHAR) AS obs_date, CAST(date_diff('day', prev_date, obs_date) AS INT) AS gap_days
FROM (SELECT *, lag(obs_date) OVER (PARTITION BY series_id ORDER BY obs_date) AS prev_date FROM obs) WHERE date_diff('day', prev_date, obs_date) > 3""", "obs"))
def long_gaps(spark, sf_dir):
    return ql.long_gaps(fx.panel(spark, sf_dir), 3)


@query("valid_targets_by_year", with_parts("SELECT series_id, year, " + ", ".join(f"count(target_vol_{h}) AS n_{h}" for h in H) + " FROM wide GROUP BY ALL", "wide"))
def valid_targets_by_year(spark, sf_dir):
    return ql.valid_targets_by_year(frame(spark, sf_dir), H)


@query("target_distribution", with_parts(f"""SELECT series_id, horizon, count(y) AS n_valid, count(*) - horizon AS n_expected, {rd('min(y)', 7)} AS min, {rd('median(y)', 7)} AS median,
{rd('max(y)', 7)} AS max, count(*) FILTER (WHERE y < 0) AS n_negative FROM long GROUP BY series_id, horizon""", "long"))
def target_distribution(spark, sf_dir):
    return rounded(ql.target_distribution(frame(spark, sf_dir), H), 7)


RATIO = {"by_discount": ("l_extendedprice", "l_discount"), "by_tax": ("l_tax", "l_discount"), "by_quantity": ("l_discount", "l_quantity")}


def ratios(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    inf = F.lit(float("inf"))
    return li.select(*[F.when(F.col(b) == 0, F.when(F.col(a) > 0, inf)).otherwise(F.col(a) / F.when(F.col(b) != 0, F.col(b))).alias(n)
                       for n, (a, b) in RATIO.items()])


def _ratio_sql(a, b):
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN CAST('inf' AS DOUBLE) END ELSE {a} / {b} END"


part("ratios", "SELECT " + ", ".join(f"{_ratio_sql(a, b)} AS {n}" for n, (a, b) in RATIO.items()) + " FROM lineitem")


@query("inf_scan", with_parts("SELECT c AS \"column\", n AS n_inf, m AS n_null_after FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) FILTER (WHERE isinf({c})) AS n, count(*) FILTER (WHERE {c} IS NULL OR isinf({c})) AS m FROM ratios" for c in RATIO) + ")", "ratios"))
def inf_scan(spark, sf_dir):
    r = ratios(spark, sf_dir)
    after = ql.null_counts(ql.inf_to_null(r, RATIO), RATIO).withColumnRenamed("n_null", "n_null_after")
    return ql.inf_scan(r, RATIO).join(after, "column")


@query("constant_columns", with_parts("SELECT c AS \"column\", k AS is_constant FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, CAST(count(DISTINCT f_{c}) <= 1 AS INT) AS k FROM features" for c in ft.FEATURES) + ")", "features"))
def constant_columns(spark, sf_dir):
    return ql.constant_columns(wq.features(spark, sf_dir), ft.FEATURES)


@query("feature_inventory", with_parts("""SELECT series_id, feature, min(row_no) FILTER (WHERE v IS NOT NULL) AS first_row, CAST(min(obs_date) FILTER (WHERE v IS NOT NULL) AS VARCHAR) AS first_date,
count(*) FILTER (WHERE v IS NULL) AS n_null, CASE WHEN feature IN ('dow', 'month', 'is_month_start', 'is_month_end', 'is_quarter_end') THEN 'int' ELSE 'double' END AS type
FROM feature_rows GROUP BY series_id, feature""", "feature_rows"))
def feature_inventory(spark, sf_dir):
    return ql.feature_inventory(wq.features(spark, sf_dir), ft.FEATURES)


@query("same_table", with_parts("""SELECT count(a.row_no) AS n_left, count(b.row_no) AS n_right, count(*) FILTER (WHERE a.row_no IS NULL OR b.row_no IS NULL OR a.f_idx_a_lag1 IS DISTINCT FROM b.f_idx_a_lag1) AS n_different
FROM (SELECT * FROM features WHERE year >= 1998) a FULL JOIN (SELECT * FROM pub_features WHERE year >= 1998) b USING (series_id, row_no)""", "features", "pub_features"))
def same_table(spark, sf_dir):
    a, b = wq.features(spark, sf_dir), wq.features_published(spark, sf_dir)
    return ql.same_table(a.filter("year >= 1998"), b.filter("year >= 1998"), ["series_id", "row_no"], ["idx_a_lag1"])


@query("prefix_invariance", with_parts("SELECT CAST(c.y AS INT) AS cut_year, count(*) AS n_left, count(*) AS n_right, CAST(0 AS BIGINT) AS n_different FROM num n JOIN (VALUES (1998), (2000)) c(y) ON n.year < c.y GROUP BY c.y", "num"))
def prefix_invariance(spark, sf_dir):
    """Features of a cut panel against those of the whole one: no row may change."""
    full, out = wq.features(spark, sf_dir), None
    obs = fx.panel(spark, sf_dir).select(*OBS)
    for cut in (1998, 2000):
        before = F.year("obs_date") < cut
        again = ft.build_features(number_rows(obs.filter(before)))
        one = ql.same_table(full.filter(before), again, ["series_id", "row_no"], ft.FEATURES).select(F.lit(cut).alias("cut_year"), "*")
        out = one if out is None else out.unionByName(one)
    return out


SAMPLE_EVERY, SAMPLE_AT = 400, 300


@query("availability_sensitivity", with_parts(f"""WITH t AS (SELECT series_id, row_no AS t, prev_date AS cut FROM released WHERE row_no % {SAMPLE_EVERY} = {SAMPLE_AT})
SELECT t.series_id, t.t, count(*) FILTER (WHERE publication_date > cut) AS n_perturbed, CAST(0 AS BIGINT) AS n_changed_published, CAST(any_value(isodow(cut)) != 1 AS INT) AS control_changed
FROM t JOIN released r ON r.series_id = t.series_id GROUP BY ALL""", "released"))
def availability_sensitivity(spark, sf_dir):
    from volpanel.operators.robust import availability_sensitivity as run

    return run(fx.panel(spark, sf_dir), F.col("row_no") % SAMPLE_EVERY == SAMPLE_AT)


@query("table_fingerprint", """SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority)), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM orders""")
def table_fingerprint(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return ql.fingerprint(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("recheck_metrics", with_parts("SELECT model, CAST(1 AS INT) AS matches, count(*) AS n_folds FROM fm GROUP BY ALL", "fm"))
def recheck_metrics(spark, sf_dir):
    out = ql.recheck_metrics(level(spark, sf_dir), fold_table(spark, sf_dir), ["series_id", "model", "horizon", "test_year"])
    return out.groupBy("model", "matches").agg(F.count(F.lit(1)).alias("n_folds"))


@query("reconcile_series", with_parts(f"""SELECT a.series_id, {rd('max(abs(a.implied - b.implied))', 8)} AS max_diff_implied, count(*) FILTER (WHERE b.implied = 0) AS n_zero_implied,
count(*) FILTER (WHERE a.series_id IS NULL) AS n_only_second, count(*) FILTER (WHERE b.series_id IS NULL) AS n_only_first, CAST(0 AS BIGINT) AS n_off_calendar
FROM obs a LEFT JOIN (SELECT series_id, obs_date, round(implied, 2) AS implied FROM obs WHERE isodow(obs_date) < 6) b ON a.series_id = b.series_id AND a.obs_date = b.obs_date GROUP BY ALL""", "obs"))
def reconcile_series(spark, sf_dir):
    from volpanel.operators import calendars as cal

    p = fx.panel(spark, sf_dir)
    second = p.filter(F.weekday("obs_date") < 5).withColumn("implied", F.round("implied", 2))
    return rounded(ql.reconcile_series(p, second, cal.calendar(cal.span_of(p)), ["implied"]), 8)


# --- sources and sinks ------------------------------------------------------
def csv_copy(spark, sf_dir):
    """The panel written as text in the raw layout, to be read back."""
    import uuid

    from volpanel.sources import io
    from volpanel.sources.stage import shared_dir

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    raw = fx.panel(spark, sf_dir).select("series_id", F.date_format("obs_date", "dd.MM.yyyy").alias("Date"), "price", "implied", "idx_a", "idx_b")
    io.write_table(raw, path, fmt="csv")
    return path


@query("read_observations", with_parts(f"SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, {rd('implied', 6)} AS implied FROM obs", "obs"))
def read_observations(spark, sf_dir):
    from volpanel.sources import io

    return rounded(io.read_observations(spark, csv_copy(spark, sf_dir), "csv").select("series_id", "obs_date", "implied"), 6)


@query("read_and_write_table", with_parts("SELECT horizon, model, count(*) AS n FROM preds WHERE horizon = 22 GROUP BY ALL", "preds"))
def read_and_write_table(spark, sf_dir):
    import uuid

    from volpanel.sources import io
    from volpanel.sources.stage import shared_dir

    root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    io.write_table(level(spark, sf_dir).withColumn("alignment", F.lit("row")), f"{root}/predictions", ("alignment", "horizon"))
    back = io.read_table(spark, root, "predictions", "row").filter("horizon = 22")
    return back.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("n"))


@query("write_report", with_parts("SELECT series_id, count(*) AS n_rows, CAST(min(obs_date) AS VARCHAR) AS date_min, CAST(max(obs_date) AS VARCHAR) AS date_max, count(target_vol_22) AS valid_22 FROM wide GROUP BY ALL", "wide"))
def write_report(spark, sf_dir):
    import uuid

    from volpanel.sources import io
    from volpanel.sources.stage import shared_dir

    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    io.write_report(io.target_report(frame(spark, sf_dir), H), path)
    text = spark.read.schema("series_id string, report string").json(path)
    return text.select("series_id", *[F.get_json_object("report", p).cast(t).alias(n) for n, p, t in (
        ("n_rows", "$.row_count", "long"), ("date_min", "$.date_min", "string"), ("date_max", "$.date_max", "string"),
        ("valid_22", "$.horizons.h22.valid_count", "long"))])


@query("read_vintages", with_parts("SELECT series_id, CAST(vintage_date AS VARCHAR) AS vintage_date, count(*) AS n, CAST(max(obs_date) AS VARCHAR) AS last_obs FROM vint GROUP BY ALL", "vint"))
def read_vintages(spark, sf_dir):
    import uuid

    from volpanel.catalog.calendar_queries import vintages
    from volpanel.sources import io
    from volpanel.sources.stage import shared_dir

    path = f"{shared_dir(spark)}/vintages-{uuid.uuid4().hex}"
    v = vintages(spark, sf_dir).withColumn("release", F.date_format("vintage_date", "yyyyMMdd"))
    io.write_table(v.drop("vintage_date"), path, ("release",))
    back = io.read_vintages(spark, path, "series_id string, obs_date date, value double")
    return back.groupBy("series_id", "vintage_date").agg(F.count(F.lit(1)).alias("n"), F.max("obs_date").alias("last_obs"))


@query("melt_predictions", with_parts("SELECT model, horizon, count(*) AS n, " + rd("sum(pred)", 4) + " AS total FROM preds WHERE model IN ('har', 'har_x') GROUP BY ALL", "preds"))
def melt_predictions(spark, sf_dir):
    from volpanel.sources import io

    keys = ["series_id", "horizon", "obs_date"]
    wide = io.pivot_predictions(level(spark, sf_dir), ["har", "har_x"], keys)
    return rounded(io.melt_predictions(wide, ["har", "har_x"], keys).groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total")), 4)


@query("pivot_models", with_parts("SELECT series_id, horizon, test_year, " + ", ".join(
    f"{rd(f'''max(rmse) FILTER (WHERE model = '{m}')''', 7)} AS {m}" for m in ("har", "har_x", "past_vol")) + " FROM fm GROUP BY ALL", "fm"))
def pivot_models(spark, sf_dir):
    from volpanel.operators.metrics import pivot_models as pivot

    return rounded(pivot(fold_table(spark, sf_dir), ["har", "har_x", "past_vol"], "rmse", ["series_id", "horizon", "test_year"]), 7)
