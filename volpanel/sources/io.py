"""Readers and writers: explicit schemas, partition columns instead of file suffixes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATIONS = "series_id string, obs_date date, price double, implied double, idx_a double, idx_b double"
RAW_OBSERVATIONS = "series_id string, Date string, price double, implied double, idx_a double, idx_b double"


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet", date_format: str = "dd.MM.yyyy") -> DataFrame:
    """Observations in the D1 layout; text sources carry the date as ``DD.MM.YYYY``.

    Dates that do not parse become NULL and are found by ``quality.unparseable_dates``.
    """
    if fmt == "parquet":
        return spark.read.schema(OBSERVATIONS).parquet(path)
    raw = spark.read.schema(RAW_OBSERVATIONS).option("header", True).csv(path)
    return raw.select("series_id", F.to_date(F.try_to_timestamp("Date", F.lit(date_format))).alias("obs_date"),
                      "price", "implied", "idx_a", "idx_b")


def write_table(df: DataFrame, path: str, partition_by=(), fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a stage table; rows of one partition value are spread over many files, not one task."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table(spark: SparkSession, root: str, name: str, alignment: str) -> DataFrame:
    """A stage table of one alignment version: a partition filter, so other versions are not read."""
    return spark.read.parquet(f"{root}/{name}").filter(F.col("alignment") == alignment)


def read_vintages(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """All releases under ``path``, the vintage date taken from the eight digits in the file's path."""
    files = spark.read.schema(schema).format(fmt).option("header", True).option("recursiveFileLookup", True).load(path)
    tail = F.regexp_extract(F.col("_metadata.file_path"), r"[_=](\d{8})[./]", 1)
    return files.select("*", F.to_date(tail, "yyyyMMdd").alias("vintage_date"))


def melt_predictions(wide: DataFrame, models, keys, prefix: str = "pred_") -> DataFrame:
    """``pred_<model>`` columns to one row per model."""
    return (wide.unpivot(list(keys), [f"{prefix}{m}" for m in models], "model", "pred")
            .withColumn("model", F.substring(F.col("model"), len(prefix) + 1, 200)))


def pivot_predictions(long: DataFrame, models, keys, prefix: str = "pred_") -> DataFrame:
    p = long.groupBy(*keys).pivot("model", list(models)).agg(F.first("pred"))
    return p.select(*keys, *[F.col(m).alias(f"{prefix}{m}") for m in models])


def target_report(frame: DataFrame, horizons, keys=("series_id",)) -> DataFrame:
    """One nested JSON text per series: row count, date range, valid counts and distribution."""
    per = {f"h{h}": F.struct(
        F.count(f"target_vol_{h}").alias("valid_count"), (F.count(F.lit(1)) - h).alias("expected_count"),
        F.min(f"target_vol_{h}").alias("min"), F.median(f"target_vol_{h}").alias("median"),
        F.max(f"target_vol_{h}").alias("max"), F.count_if(F.col(f"target_vol_{h}") < 0).alias("n_negative")) for h in horizons}
    return frame.groupBy(*keys).agg(F.to_json(F.struct(
        F.count(F.lit(1)).alias("row_count"), F.min("obs_date").alias("date_min"), F.max("obs_date").alias("date_max"),
        F.struct(*[c.alias(n) for n, c in per.items()]).alias("horizons"))).alias("report"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").text(path) if report.columns == ["report"] else \
        report.write.mode("errorifexists").json(path)
