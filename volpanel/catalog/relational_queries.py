"""Joins, set operations, projections and predicates over the panel and the event stream."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.catalog import fixtures as fx
from volpanel.catalog import forecast_sql as fs  # noqa: F401
from volpanel.catalog.forecast_queries import fold_table, frame, level, logs, rows
from volpanel.catalog.registry import query, rounded
from volpanel.catalog.sql import part, rd, with_parts
from volpanel.operators import features as ft
from volpanel.operators import folds, quality, relational
from volpanel.operators.asof import asof_join

H, YEARS = fx.HORIZONS, fx.TEST_YEARS


# --- joins ----------------------------------------------------------------------
@query("asof_join", """SELECT p.event_id, p.user_id, round(p.value, 4) AS value, v.event_id AS view_id, round(v.value, 4) AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof(spark, sf_dir):
    """Each purchase takes the user's latest view at or before it."""
    e = fx.table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    out = asof_join(left, right, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], tie=("view_id",))
    return rounded(out.select("event_id", "user_id", "value", "view_id", "view_value"), 4)


@query("inner_join_on_date", """WITH a AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS price FROM orders GROUP BY ALL),
b AS (SELECT o_orderpriority AS series_id, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT series_id, CAST(d AS VARCHAR) AS obs_date, round(shipped, 6) + 0.0 AS shipped FROM a JOIN b USING (series_id, d)""")
def inner_join_on_date(spark, sf_dir):
    """Two series tables merged on the day: a day missing in either drops out."""
    o, li = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem")
    a = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date")).agg(F.avg("o_totalprice").alias("price"))
    b = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("l_shipdate").alias("obs_date"))
         .agg(F.avg("l_quantity").alias("shipped")))
    return rounded(a.join(b, ["series_id", "obs_date"]).select("series_id", "obs_date", "shipped"), 6)


@query("join_predictions_same_target", with_parts("SELECT count(*) AS n, round(max(abs(a.y_true - b.y_true)), 9) AS max_difference FROM p_har a JOIN p_har_x_log b USING (series_id, horizon, obs_date)", "p_har", "p_har_x_log"))
def join_predictions_same_target(spark, sf_dir):
    out = relational.same_target(level(spark, sf_dir).filter("model = 'har'"), logs(spark, sf_dir).filter("model = 'har_x_log'"), ["series_id", "horizon", "obs_date"])
    return rounded(out, 9)


@query("left_join_metrics", with_parts(f"SELECT a.series_id, a.horizon, a.test_year, {rd('a.rmse', 7)} AS rmse_har, {rd('b.rmse', 7)} AS rmse_other FROM (SELECT * FROM fm WHERE model = 'har') a LEFT JOIN (SELECT * FROM fm WHERE model = 'har_x' AND test_year >= 2000) b USING (series_id, horizon, test_year)", "fm"))
def left_join_metrics(spark, sf_dir):
    k = ["series_id", "horizon", "test_year"]
    m = fold_table(spark, sf_dir)
    a = m.filter("model = 'har'").select(*k, F.col("rmse").alias("rmse_har"))
    b = m.filter("model = 'har_x' and test_year >= 2000").select(*k, F.col("rmse").alias("rmse_other"))
    return rounded(a.join(b, k, "left"), 7)


@query("full_outer_with_indicator", with_parts("""SELECT CASE WHEN a.series_id IS NULL THEN 'right_only' WHEN b.series_id IS NULL THEN 'left_only' ELSE 'both' END AS indicator, count(*) AS n
FROM (SELECT * FROM fm WHERE model = 'har' AND test_year <= 2000) a FULL JOIN (SELECT * FROM fm WHERE model = 'har_x' AND test_year >= 1999) b
ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.test_year = b.test_year GROUP BY ALL""", "fm"))
def full_outer_with_indicator(spark, sf_dir):
    k = ["series_id", "horizon", "test_year"]
    m = fold_table(spark, sf_dir)
    j = relational.both_sides(m.filter("model = 'har' and test_year <= 2000").select(*k), m.filter("model = 'har_x' and test_year >= 1999").select(*k), k)
    return j.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))


@query("validated_join", with_parts(f"SELECT p.series_id, p.model, p.horizon, p.test_year, count(*) AS n, {rd('avg(p.pred / m.rmse)', 6)} AS scaled FROM preds p JOIN fm m USING (series_id, model, horizon, test_year) GROUP BY ALL", "preds", "fm"))
def validated_join(spark, sf_dir):
    k = ["series_id", "model", "horizon", "test_year"]
    j = quality.join_validated(level(spark, sf_dir).select(*k, "pred"), fold_table(spark, sf_dir).select(*k, "rmse"), k, validate="m:1")
    return rounded(j.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pred") / F.col("rmse")).alias("scaled")), 6)


@query("semi_and_anti_join", """SELECT count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS n_with, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_without FROM customer""")
def semi_and_anti_join(spark, sf_dir):
    c, o = fx.table(spark, sf_dir, "customer"), fx.table(spark, sf_dir, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    a = c.join(o, on, "left_semi").select(F.lit(1).alias("w"))
    b = c.join(o, on, "left_anti").select(F.lit(0).alias("w"))
    return a.unionByName(b).agg(F.count_if(F.col("w") == 1).alias("n_with"), F.count_if(F.col("w") == 0).alias("n_without"))


@query("rows_by_folds", with_parts("""SELECT n.series_id, f.test_year, count(*) FILTER (WHERE n.year < f.test_year) AS n_train, count(*) FILTER (WHERE n.year = f.test_year) AS n_test
FROM num n JOIN (VALUES (1998), (1999), (2000), (2001)) f(test_year) ON n.year <= f.test_year GROUP BY ALL""", "num"))
def rows_by_folds(spark, sf_dir):
    """The range join of rows and folds, as yearly counts that meet the folds afterwards."""
    years = F.array(*[F.lit(y) for y in YEARS])
    n = fx.panel(spark, sf_dir).groupBy("series_id", "year").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("test_year", F.explode(F.filter(years, lambda y: y >= F.col("year"))))
    return n.groupBy("series_id", "test_year").agg(
        F.sum(F.when(F.col("year") < F.col("test_year"), F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("year") == F.col("test_year"), F.col("n")).otherwise(0)).alias("n_test"))


@query("expand_dimensions", with_parts("SELECT series_id, h AS horizon, v AS variant, count(*) AS n FROM num, (VALUES (5), (22), (66), (126)) a(h), (VALUES ('a'), ('b')) b(v) GROUP BY ALL", "num"))
def expand_dimensions(spark, sf_dir):
    """Every row for every horizon and variant: literal lists unfold in the row, nothing is shuffled."""
    df = relational.expand(relational.expand(fx.panel(spark, sf_dir).select("series_id"), "horizon", H), "variant", ["a", "b"])
    return df.groupBy("series_id", "horizon", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("dictionary_lookup", with_parts("SELECT CASE WHEN model LIKE 'har%' THEN 'regression' WHEN model = 'past_vol' THEN 'persistence' ELSE 'mean' END AS role, count(*) AS n FROM preds GROUP BY ALL", "preds"))
def dictionary_lookup(spark, sf_dir):
    roles = {"har": "regression", "har_implied": "regression", "har_index": "regression", "har_x": "regression", "past_vol": "persistence"}
    return relational.lookup(level(spark, sf_dir), "model", "role", roles, "mean").groupBy("role").agg(F.count(F.lit(1)).alias("n"))


# --- projections and predicates ----------------------------------------------------
@query("project_and_rename", with_parts(f"SELECT series_id AS name, CAST(obs_date AS VARCHAR) AS day, {rd('implied', 6)} AS value, 'row' AS alignment FROM obs", "obs"))
def project_and_rename(spark, sf_dir):
    df = fx.panel(spark, sf_dir).select("series_id", "obs_date", "implied").withColumnsRenamed({"series_id": "name", "obs_date": "day", "implied": "value"})
    return rounded(df.withColumn("alignment", F.lit("row")), 6)


@query("complete_cases", with_parts("""SELECT series_id, horizon, count(*) FILTER (WHERE y IS NOT NULL AND har_daily IS NOT NULL AND price_vol5 IS NOT NULL AND price_vol20 IS NOT NULL) AS n_har,
count(*) FILTER (WHERE y IS NOT NULL AND past_vol IS NOT NULL) AS n_past FROM long GROUP BY ALL""", "long"))
def complete_cases(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.groupBy("series_id", "horizon").agg(F.count_if(folds.complete(["y", *C.HAR])).alias("n_har"),
                                                F.count_if(folds.complete(["y", "past_vol"])).alias("n_past"))


@query("predicates", with_parts("SELECT series_id, count(*) AS n FROM num WHERE year BETWEEN 1998 AND 2000 AND month(obs_date) IN (1, 6, 12) AND implied > 20 AND NOT (isodow(obs_date) > 5) GROUP BY ALL", "num"))
def predicates(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    p = p.filter(F.col("year").between(1998, 2000) & F.month("obs_date").isin(1, 6, 12) & (F.col("implied") > 20) & ~(F.weekday("obs_date") > 4))
    return p.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


@query("null_safe_flags", with_parts("SELECT series_id, count(*) FILTER (WHERE ret > 0.5) AS n_one, count(*) FILTER (WHERE ret <= 0.5) AS n_zero, count(*) FILTER (WHERE ret IS NULL) AS n_null FROM rets GROUP BY ALL", "rets"))
def null_safe_flags(spark, sf_dir):
    f = frame(spark, sf_dir).withColumn("flag", ft.flag_null_safe(F.col("ret") > 0.5, F.col("ret")))
    return f.groupBy("series_id").agg(F.count_if(F.col("flag") == 1).alias("n_one"), F.count_if(F.col("flag") == 0).alias("n_zero"), F.count_if(F.col("flag").isNull()).alias("n_null"))


@query("finite_only", "SELECT count(*) AS n_all, count(*) FILTER (WHERE l_discount > 0) AS n_finite FROM lineitem")
def finite_only(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").withColumn("ratio", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.nullif("l_discount", F.lit(0.0))))
    return li.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(folds.finite("ratio")).alias("n_finite"))


@query("positive_guard", with_parts("SELECT 'pred' AS \"column\", count(*) FILTER (WHERE pred <= 0) AS n_not_positive FROM preds UNION ALL SELECT 'y_true', count(*) FILTER (WHERE y_true <= 0) FROM preds", "preds"))
def positive_guard(spark, sf_dir):
    return quality.positive_guard(quality.require_positive(level(spark, sf_dir), ["pred", "y_true"]), ["pred", "y_true"])


# --- sorts and set operations --------------------------------------------------------
@query("set_operations", """SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS n_both,
(SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_left, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) AS n_distinct""")
def set_operations(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(n))
    parts = one(o.intersect(c), "n_both").unionByName(one(c.exceptAll(o).distinct(), "n_left")).unionByName(one(o.distinct(), "n_distinct"))
    return parts.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("n_both", "n_left", "n_distinct")])


@query("symmetric_difference", with_parts("""SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CASE WHEN y > 0 THEN 'left' ELSE 'right' END AS side FROM (
SELECT series_id, obs_date, 1 AS y FROM (SELECT series_id, obs_date FROM num WHERE month(obs_date) <= 6 EXCEPT SELECT series_id, obs_date FROM num WHERE year >= 1998)
UNION ALL SELECT series_id, obs_date, -1 FROM (SELECT series_id, obs_date FROM num WHERE year >= 1998 EXCEPT SELECT series_id, obs_date FROM num WHERE month(obs_date) <= 6))""", "num"))
def symmetric_difference(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return relational.symmetric_difference(p.filter(F.month("obs_date") <= 6), p.filter("year >= 1998"), ["series_id", "obs_date"])


@query("align_to_key_list", with_parts("SELECT s.series_id, CAST(m.m AS INT) AS month, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT series_id FROM num) s CROSS JOIN range(1, 13) m(m) LEFT JOIN (SELECT series_id, month(obs_date) AS m, count(*) AS n FROM num WHERE year = 2001 GROUP BY ALL) c ON c.series_id = s.series_id AND c.m = m.m", "num"))
def align_to_key_list(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    dim = relational.expand(p.select("series_id").distinct(), "month", list(range(1, 13)))
    n = p.filter("year = 2001").groupBy("series_id", F.month("obs_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return relational.align_to_keys(n, dim, ["series_id", "month"], ["n"])


@query("first_per_group", with_parts("SELECT series_id, year, CAST(min(obs_date) AS VARCHAR) AS first_day FROM num GROUP BY ALL", "num"))
def first_per_group(spark, sf_dir):
    return fx.panel(spark, sf_dir).groupBy("series_id", "year").agg(F.min_by("obs_date", "row_no").alias("first_day"))


@query("counts_and_crosstab", with_parts("SELECT series_id, " + ", ".join(f"count(*) FILTER (WHERE isodow(obs_date) = {d + 1}) AS d{d}" for d in range(7)) + ", count(DISTINCT year) AS n_years FROM num GROUP BY ALL", "num"))
def counts_and_crosstab(spark, sf_dir):
    d = F.weekday("obs_date")
    return fx.panel(spark, sf_dir).groupBy("series_id").agg(*[F.count_if(d == i).alias(f"d{i}") for i in range(7)], F.count_distinct("year").alias("n_years"))


@query("share_of_total", with_parts(f"SELECT series_id, year, n, {rd('100.0 * n / sum(n) OVER (PARTITION BY series_id)', 6)} AS share_pct FROM (SELECT series_id, year, count(*) AS n FROM num GROUP BY ALL)", "num"))
def share_of_total(spark, sf_dir):
    n = fx.panel(spark, sf_dir).groupBy("series_id", "year").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.withColumn("share_pct", relational.share_of_total(n, "n", ["series_id"])), 6)


@query("suffix_minimum", with_parts(f"SELECT series_id, row_no, {rd('min(implied) OVER (PARTITION BY series_id ORDER BY row_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 6)} AS later_min FROM num", "num"))
def suffix_minimum(spark, sf_dir):
    from volpanel.operators.panel import CHUNK_ROWS, running_min

    out = running_min(fx.panel(spark, sf_dir), "implied", "later_min", ["series_id"], "row_no", F.floor(F.col("row_no") / CHUNK_ROWS), suffix=True)
    return rounded(out.select("series_id", "row_no", "later_min"), 6)


@query("last_value_by_window", with_parts(f"SELECT series_id, row_no, {rd('last_value(implied) OVER (PARTITION BY series_id, year ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 6)} AS year_end FROM num", "num"))
def last_value_by_window(spark, sf_dir):
    w = Window.partitionBy("series_id", "year").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rounded(fx.panel(spark, sf_dir).select("series_id", "row_no", F.last("implied").over(w).alias("year_end")), 6)
