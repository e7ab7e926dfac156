"""Index features aligned to the day they were published.

The block is built on the index's own rows first and mapped to trading rows
afterwards: row t takes the newest observation whose publication date is not
after the date of row t-1.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators import features as ft
from volpanel.operators.asof import asof_join


def release_monday(day: Column) -> Column:
    """First Monday on or after the day."""
    return F.next_day(F.date_sub(day, 1), "Mon")


def features_as_published(numbered: DataFrame, published: Column | str = "publication_date",
                          keys=("series_id",)) -> DataFrame:
    """The 65-column matrix with index features taken as of publication.

    ``numbered`` must hold the publication date of each row's index observation.
    """
    base = ft.causal_columns(numbered, ("price", "implied"), keys, previous_date=True)
    base = base.select(*keys, "obs_date", "year", "row_no", "prev_date", "har_daily",
                       *[c for c in ft.FEATURES if c in base.columns])
    block = ft.index_block(numbered, keys)
    names = ft.INDEX_BLOCK
    known = block.withColumnsRenamed({"row_no": "used_row", "obs_date": "used_date"})
    out = asof_join(base, known, keys, "prev_date", published, [*names, "used_row", "used_date"], tie=("used_row",))
    out = ft.derived_features(out)
    return out.select(*keys, "obs_date", "year", "row_no", "prev_date", "used_row", "used_date",
                      "har_daily", *ft.FEATURES)


def alignment_effect(a: DataFrame, b: DataFrame, columns, keys=("series_id", "row_no")) -> DataFrame:
    """Per column: rows that differ, and the first complete row in each version."""
    j = (a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
         .join(b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns]), list(keys)))
    aggs = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.count_if(~x.eqNullSafe(y)).alias("n_rows_differ"),
            F.min(F.when(x.isNotNull(), F.col("row_no"))).alias("first_valid_a"),
            F.min(F.when(y.isNotNull(), F.col("row_no"))).alias("first_valid_b")))
    return (j.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))
            .withColumn("changed", (F.col("n_rows_differ") > 0).cast("int")))


def effective_lag(aligned: DataFrame) -> DataFrame:
    """Age of the index observation each row uses, in rows and in calendar days."""
    return (aligned.filter(F.col("used_row").isNotNull())
            .select("*", F.datediff("obs_date", "used_date").alias("lag_days"),
                    (F.col("row_no") - F.col("used_row")).alias("lag_rows"),
                    F.datediff("obs_date", "prev_date").alias("plain_lag_days"),
                    F.date_format("obs_date", "EEEE").alias("weekday")))


def lag_summary(lags: DataFrame, *by: str) -> DataFrame:
    def four(c):
        return [F.min(c).cast("long").alias(f"{c}_min"), F.median(c).alias(f"{c}_median"),
                F.avg(c).alias(f"{c}_mean"), F.max(c).cast("long").alias(f"{c}_max")]
    return lags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *four("lag_days"), *four("lag_rows"),
        F.avg((F.col("lag_rows") > 1).cast("double")).alias("share_not_yet_published"))
