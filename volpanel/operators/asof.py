"""As-of joins: each left row takes the latest right row at or before its time.

One union and one ordered window, linear in the rows. Keys with more than
``HOT_ROWS`` rows are cut along time: rows are matched inside a slice, and a
slice whose first rows find nothing takes the last right row of the slices
before it. A hot key thus spreads over many tasks and no row is dropped.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.sources.stage import stage

HOT_ROWS = 500_000
BROADCAST_ROWS = 200_000


def _small(table: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a side table, count it, and mark it for broadcast if the count allows."""
    table = stage(table, name)
    n = table.count()
    return (F.broadcast(table) if n <= BROADCAST_ROWS else table), n


def _slices(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Add ``_slice``, monotone in ``_time``; NULL for keys small enough for one task.

    Hot keys number at most rows / hot_rows. Their table is counted first: with
    none (the usual case) the rows are shuffled once and nothing is joined.
    """
    hot, n_hot = _small(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                        .filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")), "hot_keys")
    if n_hot == 0:
        return rows.withColumn("_slice", F.lit(None).cast("struct<day:bigint,piece:bigint>"))
    rows = rows.join(hot, keys, "left")
    rows = rows.withColumn("_day", F.when(F.col("_hot"), F.floor(F.col("_time") / 86400.0).cast("long")))
    n = F.count(F.lit(1))
    pieces, _ = _small(rows.filter("_hot").groupBy(*keys, "_day").agg(F.ceil(n / hot_rows).cast("long").alias("_pieces"))
                       .filter("_pieces > 1"), "hot_days")
    rows = rows.join(pieces, [*keys, "_day"], "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    inside = F.floor((F.col("_time") / 86400.0 - F.col("_day")) * F.col("_pieces")).cast("long")
    return rows.withColumn("_slice", F.when(F.col("_hot"), F.struct(
        F.col("_day").alias("day"), inside.alias("piece")))).drop("_hot", "_day", "_pieces")


def _seconds(c):
    """Dates and timestamps as seconds; microseconds are kept."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def asof_join(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str,
              payload, tie=(), hot_rows: int | None = None) -> DataFrame:
    """Left join each row with the last right row whose time is <= its own.

    ``tie`` orders right rows of equal time; the last one wins. Left rows with a
    NULL time, or with no earlier right row, get NULLs.
    """
    keys, payload, tie = list(keys), list(payload), list(tie)
    right_cols = list(dict.fromkeys([*tie, *payload]))
    lcols = [c for c in left.columns if c not in keys]
    l_type = left.select(F.struct(*lcols).alias("s")).schema["s"].dataType
    r_type = right.select(F.struct(*right_cols).alias("s")).schema["s"].dataType
    rows = (left.select(*keys, _seconds(F.col(left_time)).alias("_time"), F.lit(1).alias("_side"),
                        F.struct(*lcols).alias("_l"), F.lit(None).cast(r_type).alias("_r"))
            .unionByName(right.filter(F.col(right_time).isNotNull())
                         .select(*keys, _seconds(F.col(right_time)).alias("_time"),
                                 F.lit(0).alias("_side"), F.lit(None).cast(l_type).alias("_l"),
                                 F.struct(*right_cols).alias("_r"))))
    rows = _slices(rows, keys, hot_rows or HOT_ROWS)
    # NULL times sort first, before every right row of the key's first slice
    order = [F.col("_time").asc_nulls_first(), "_side", *[f"_r.{t}" for t in tie]]
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (rows.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice")
            .agg(F.expr("max_by(_r, struct(_time" + "".join(f", _r.{t}" for t in tie)
                        + ")) filter (where _side = 0)").alias("_end"))
            .select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carry")))
    rows = rows.filter("_side = 1").join(ends, [*keys, "_slice"], "left")
    hit = F.when(F.col("_time").isNotNull(), F.coalesce("_hit", "_carry"))
    rows = rows.withColumn("_hit", hit)
    return rows.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols],
                       *[F.col(f"_hit.{p}").alias(p) for p in payload])
