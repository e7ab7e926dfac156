"""Stage tables: a written Parquet copy that later steps read.

Each step of a long job ends in a stage table in the cluster's shared
checkpoint folder. That cuts lineage (a lost executor re-reads files, it does
not replay the scan of the raw facts) and keeps column pruning and size
statistics, which a checkpointed RDD would lose.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Unset: a scratch one in local mode, where driver and
    executors are one process; an error on a cluster, whose machines would not see it."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="volpanel-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by \
        else spark.read.parquet(path)
