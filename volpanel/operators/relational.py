"""Thin relational helpers for shapes that recur."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys, order, k: int) -> DataFrame:
    """First k rows per key. Spark keeps only k rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def in_order(df: DataFrame, column: str, categories, *then: str) -> DataFrame:
    """Sort by the position of a category in a list, then by further columns."""
    names = F.array(*[F.lit(c) for c in categories])
    return df.withColumn("_rank", F.array_position(names, F.col(column))).orderBy("_rank", *then)


def align_to_keys(df: DataFrame, dimension: DataFrame, keys, zeros=()) -> DataFrame:
    """One row per key of the dimension; missing numbers become zero where asked."""
    out = dimension.join(df, list(keys), "left")
    return out.na.fill(0, list(zeros)) if zeros else out


def symmetric_difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys on one side only, with the side."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, list(keys), "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return j.select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def expand(df: DataFrame, name: str, values) -> DataFrame:
    """Every row once per value of a short literal list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def lookup(df: DataFrame, column: str, out: str, table: dict, default=None) -> DataFrame:
    """Label from a literal dictionary, as a map expression inside the row."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.coalesce(m[F.col(column)], F.lit(default)))


def both_sides(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Full outer join with an indicator: both, left_only, right_only."""
    x, y = a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both")
    return x.join(y, list(keys), "full_outer").withColumn("indicator", side).drop("_a", "_b")


def same_target(a: DataFrame, b: DataFrame, keys, y: str = "y_true") -> DataFrame:
    """Inner join of two prediction tables and the largest difference of their targets."""
    j = a.select(*keys, F.col(y).alias("_ya")).join(b.select(*keys, F.col(y).alias("_yb")), list(keys))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("_ya") - F.col("_yb"))).alias("max_difference"))


def share_of_total(df: DataFrame, value: str, keys) -> Column:
    return 100 * F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*keys)))
