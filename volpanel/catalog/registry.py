"""The registry behind ``queries()`` and ``oracle_sql()``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the DuckDB statement it must equal."""
    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so results compare alike in every client."""
    return df.select([
        F.col(f"`{f.name}`").cast("string").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *columns: str, **special: int) -> DataFrame:
    """Round doubles (all of them if no names are given); ``special`` overrides digits."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({
        c: F.round(F.col(c), special.get(c, digits)) + F.lit(0.0) for c in [*names, *special]})
