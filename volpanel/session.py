"""Session for tests and benches; a cluster passes its own."""

from pyspark.sql import SparkSession


def local_session(name: str, cpus: int = 8, partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "12g")
             # window work is heavy per byte: keep small tables on all cores
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
