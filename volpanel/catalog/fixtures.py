"""The test panels, derived in Spark from the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel import config as C
from volpanel.operators.panel import number_rows
from volpanel.sources.stage import stage

HORIZONS = C.HORIZONS
TEST_YEARS = (1998, 1999, 2000, 2001)
FIRST_TEST_YEAR = 1998
PARTIAL_YEAR = 2001

_staged: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, by_nation: bool = False) -> DataFrame:
    """One row per order priority (and nation) and day: D1 of the data model.

    Both aggregations combine before their shuffle, so a priority or an order
    date that holds a third of the facts costs one row per task. What leaves is
    bounded: one row per series and calendar day.
    """
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"),
                  F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("d")))
    orders = table(spark, sf_dir, "orders")
    series = F.col("o_orderpriority")
    if by_nation:
        orders = (orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
                  .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
        series = F.concat_ws("|", "o_orderpriority", "n_name")
    return (orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy(series.alias("series_id"), F.to_date("o_orderdate").alias("obs_date"))
            .agg(F.avg("o_totalprice").alias("price"), F.avg("q").alias("implied"),
                 F.avg("e").alias("idx_a"), F.avg("d").alias("idx_b")))


def remember(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """The stage table ``name`` of this session and input, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def forget() -> None:
    """Drop the memory of stage tables, so that the next use pays for them again."""
    _staged.clear()


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation panel with row numbers, as a stage table."""
    obs = remember(spark, sf_dir, "observations", lambda: observations(spark, sf_dir))
    return remember(spark, sf_dir, "panel", lambda: number_rows(obs))
