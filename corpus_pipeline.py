"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
and read again as the next stage's ``docs``. All but the last return the columns of
``docs``, whatever they are called.

Null, empty and wordless texts, and texts under ten words, end in the first stage.
Rows without a doc_id are treated like others, but no row can stand for its class
of near copies without one, so those stay. Repeated rows (same doc_id and text)
become one in the second stage. An empty table gives an empty table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import decontaminate, overlap_join, quality_rules, source_mix, suffix_dedup
from volpanel.llm.common import free_name
from volpanel.sources.stage import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near copies."""
    classes = overlap_join.jaccard_classes(docs)
    head, code = free_name(docs, "head"), free_name(docs, "code")
    heads = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias(head)).distinct()
    return (docs.join(heads, F.col("doc_id").eqNullSafe(F.col(head)), "left_semi")
            .withColumn(code, F.xxhash64("text")).dropDuplicates(["doc_id", code]).drop(code))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 100-byte string covers which also starts earlier."""
    rest = suffix_dedup.without_repeats(docs)
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contaminated(docs, bench, whole_rows=True).where(F.size("hits") == 0).select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: each document with its number of ``copies`` and ``finish``, the virtual time
    that orders the mix. Columns of these two names in ``docs`` give way."""
    code = free_name(docs, "code")
    row = F.xxhash64("doc_id", "text")
    plan = (source_mix.mix(docs.select(row.alias(code), "source", "text"), key=code).where("copies > 0")
            .groupBy(code).agg(F.max("copies").alias("copies"), F.min("finish").alias("finish")))
    return docs.drop("copies", "finish").withColumn(code, row).join(plan, code).drop(code)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", contamination), ("mixing sources", mixture)]

#: The vote model, byte ranges and classes cannot be written in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
