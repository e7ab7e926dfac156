"""Checks that return rows: an empty result, or a zero count, means the table passed."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.panel import add_chunks, chunk_window, core_rows


def check_schema(df: DataFrame, expected) -> list[tuple[str, str]]:
    """(level, message): missing columns are errors, extra or reordered ones warnings."""
    expected, have = list(expected), df.columns
    out = [("error", f"missing column {c}") for c in expected if c not in have]
    out += [("warning", f"extra column {c}") for c in have if c not in expected]
    if not out and have != expected:
        out.append(("warning", "columns in another order"))
    return out


def null_counts(df: DataFrame, columns) -> DataFrame:
    return (df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null"))
                             for c in columns]).alias("r")).select(F.inline("r")))


def unparseable_dates(df: DataFrame, text: str, fmt: str = "dd.MM.yyyy") -> DataFrame:
    return df.filter(F.col(text).isNull() | F.try_to_timestamp(F.col(text), F.lit(fmt)).isNull())


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def out_of_order(df: DataFrame, keys, order: str, value: str, block: int = 100_000) -> DataFrame:
    """Rows whose value is below that of the row before them in ingest order.

    Rows compare inside blocks of ingest positions; the first row of a block
    compares with the last value of the block before, so a key of any size is
    spread over tasks.
    """
    keys = list(keys)
    rows = df.withColumn("_b", F.floor(F.col(order) / block))
    ends = (rows.groupBy(*keys, "_b").agg(F.max_by(value, order).alias("_end"))
            .select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry")))
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    prev = F.coalesce(F.lag(value).over(w), F.col("_carry"))
    return rows.join(ends, [*keys, "_b"]).withColumn("previous", prev).filter(
        F.col(value) < F.col("previous")).drop("_b", "_carry")


def anchor_value(df: DataFrame, where: Column, column: str, expected: float, tol: float) -> DataFrame:
    """Is a known record still there: rows found, and those within the tolerance."""
    return df.filter(where).agg(
        F.count(F.lit(1)).alias("n_found"),
        F.count_if(F.abs(F.col(column) - expected) < tol).alias("n_matching"))


def argmax_row(df: DataFrame, column: str, keep, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.max(column).alias(column), F.max_by(F.struct(*keep), F.struct(column, *keep)).alias("_r")).select(
        *keys, column, "_r.*")


def long_gaps(numbered: DataFrame, days: int, keys=("series_id",)) -> DataFrame:
    w = chunk_window(keys)
    df = add_chunks(numbered, back=1).withColumn("prev_date", F.lag("obs_date", 1).over(w))
    df = core_rows(df).withColumn("gap_days", F.datediff("obs_date", "prev_date"))
    return df.filter(F.col("gap_days") > days).select(*keys, "prev_date", "obs_date", "gap_days")


def valid_targets_by_year(frame: DataFrame, horizons, keys=("series_id",)) -> DataFrame:
    """Valid targets per year, one column per horizon, zeros where there are none."""
    return frame.groupBy(*keys, "year").agg(*[F.count(f"target_vol_{h}").alias(f"n_{h}") for h in horizons])


def target_distribution(frame: DataFrame, horizons, keys=("series_id",)) -> DataFrame:
    long = frame.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(int(h)).alias("horizon"), F.col(f"target_vol_{h}").alias("y")) for h in horizons])))
    return long.groupBy(*keys, "horizon").agg(
        F.count("y").alias("n_valid"), (F.count(F.lit(1)) - F.col("horizon")).alias("n_expected"),
        F.min("y").alias("min"), F.median("y").alias("median"), F.max("y").alias("max"),
        F.count_if(F.col("y") < 0).alias("n_negative"))


def inf_scan(df: DataFrame, columns) -> DataFrame:
    inf = float("inf")
    return (df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.abs(F.col(c)) == inf).alias("n_inf"))
                             for c in columns]).alias("r")).select(F.inline("r")))


def inf_to_null(df: DataFrame, columns) -> DataFrame:
    inf = float("inf")
    return df.withColumns({c: F.when(F.abs(F.col(c)) == inf, None).otherwise(F.col(c)) for c in columns})


def constant_columns(df: DataFrame, columns) -> DataFrame:
    """At most one distinct value: minimum equals maximum, so no distinct count is needed."""
    return (df.agg(F.array(*[F.struct(
        F.lit(c).alias("column"),
        F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("int").alias("is_constant")) for c in columns]).alias("r"))
        .select(F.inline("r")))


def feature_inventory(df: DataFrame, columns, keys=("series_id",)) -> DataFrame:
    """First row and date with a value, and NULL counts, of each feature."""
    rows = [F.struct(
        F.lit(c).alias("feature"), F.min(F.when(F.col(c).isNotNull(), F.col("row_no"))).alias("first_row"),
        F.min(F.when(F.col(c).isNotNull(), F.col("obs_date"))).alias("first_date"),
        F.count_if(F.col(c).isNull()).alias("n_null")) for c in columns]
    types = dict(df.dtypes)
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return (df.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))
            .withColumn("type", kinds[F.col("feature")]))


def table_differences(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Keys found on one side only, or with any column that is not the same (NULL equals NULL)."""
    keys, columns = list(keys), list(columns)
    x = a.select(*keys, F.struct(*columns).alias("_a"))
    y = b.select(*keys, F.struct(*columns).alias("_b"))
    j = x.join(y, keys, "full_outer")
    status = (F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left")
              .when(~F.col("_a").eqNullSafe(F.col("_b")), "differs"))
    return j.withColumn("status", status).filter(F.col("status").isNotNull()).select(*keys, "status")


def same_table(a: DataFrame, b: DataFrame, keys, columns) -> DataFrame:
    """Counts of rows on both sides and of differences."""
    keys, columns = list(keys), list(columns)
    j = a.select(*keys, F.struct(*columns).alias("_a")).join(
        b.select(*keys, F.struct(*columns).alias("_b")), keys, "full_outer")
    return j.agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"),
                 F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"))


def fingerprint(df: DataFrame, columns) -> DataFrame:
    """Order-free digest: row count and the sum of 48-bit pieces of each row's SHA-256."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    digest = F.sha2(text, 256)
    piece = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(piece).cast("string").alias("digest"))


def recheck_metrics(preds: DataFrame, metrics: DataFrame, keys, tol: float = 1e-9) -> DataFrame:
    """Folds whose stored RMSE or size is not what the predictions give, or that lack a partner."""
    keys = list(keys)
    e = F.col("y_true") - F.col("pred")
    again = preds.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("_rmse"), F.count(F.lit(1)).alias("_n"))
    j = metrics.select(*keys, "rmse", "n").join(again, keys, "full_outer")
    ok = (F.col("n") == F.col("_n")) & (F.abs(F.col("rmse") - F.col("_rmse")) <= tol * F.col("_rmse"))
    return j.withColumn("matches", F.coalesce(ok, F.lit(False)).cast("int"))


def reconcile_series(a: DataFrame, b: DataFrame, calendar: DataFrame, columns, keys=("series_id",)) -> DataFrame:
    """Second source against the first: largest difference, unmatched days, zero days, days off the calendar."""
    keys = [*keys, "obs_date"]
    j = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")).join(
        b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b")), keys, "full_outer")
    j = j.join(calendar.select(F.col("day").alias("obs_date"), F.lit(1).alias("_cal")), "obs_date", "left")
    return j.groupBy(*keys[:-1]).agg(
        *[F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias(f"max_diff_{c}") for c in columns],
        *[F.count_if(F.col(f"b_{c}") == 0).alias(f"n_zero_{c}") for c in columns],
        F.count_if(F.col("_a").isNull()).alias("n_only_second"), F.count_if(F.col("_b").isNull()).alias("n_only_first"),
        F.count_if(F.col("_cal").isNull()).alias("n_off_calendar"))


def require_unique(df: DataFrame, keys) -> DataFrame:
    """The table, with a runtime failure on any repeated key (the check of a 1:1 or m:1 join).

    The guard rides on an aggregation by key, so it also leaves the table
    partitioned for the join that follows.
    """
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*cols)).alias("_v"))
    ok = F.assert_true(F.col("_n") == 1, "join key is not unique")
    return g.filter(ok.isNull()).select(*keys, "_v.*")


def join_validated(left: DataFrame, right: DataFrame, keys, how: str = "inner", validate: str = "m:1") -> DataFrame:
    """Join whose right side (and, for 1:1, left side) must have unique keys."""
    right = require_unique(right, keys)
    if validate == "1:1":
        left = require_unique(left, keys)
    elif validate != "m:1":
        raise ValueError(f"validate must be '1:1' or 'm:1', not {validate!r}")
    return left.join(right, list(keys), how)


def positive_guard(df: DataFrame, columns) -> DataFrame:
    """Counts of values that are not above zero, per column."""
    return (df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) <= 0).alias("n_not_positive"))
                             for c in columns]).alias("r")).select(F.inline("r")))


def require_positive(df: DataFrame, columns) -> DataFrame:
    """The table, failing at run time on a value that is not above zero."""
    for c in columns:
        df = df.filter(F.assert_true(F.col(c).isNull() | (F.col(c) > 0), f"{c} must be positive").isNull())
    return df
