"""Sinks: replaced partitions, versioned stage artifacts, write-once objects, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, exists, path_of


def replace_documents(issues: DataFrame, folder: str, buckets: int = 256, documents: DataFrame | None = None) -> None:
    """Replace the issues of the documents at hand: repeated runs give the same files.

    Rows go to folders by a hash of the document; only folders that hold one of its documents are
    rewritten, with the other documents of those folders kept. ``documents`` (doc_id) names the documents
    of the run, so that one without any finding loses its old ones; by default they are those of the issues.
    Only a missing folder counts as empty; any other failure to read it passes on.
    """
    spark = issues.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    new = issues.withColumn("bucket", bucket)
    run = issues.select("doc_id") if documents is None else documents.select("doc_id").unionByName(issues.select("doc_id"))
    run = run.distinct().withColumn("bucket", bucket)
    gone: set[int] = set()
    if exists(spark, folder):
        old = spark.read.parquet(folder)
        touched = run.select("bucket").distinct()  # as many as there are buckets at most
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(run.select("doc_id"), "doc_id", "left_anti")
        # read and rewritten folders are the same, so the rows leave them through the shared folder first
        new = cut(new.unionByName(kept, allowMissingColumns=True))
        gone = {r.bucket for r in touched.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_anti").collect()}
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for number in gone:  # nothing is left in these
        store, path = path_of(spark, f"{folder}/bucket={number}")
        store.delete(path, True)


def append_issues(first: DataFrame, *more: DataFrame, folder: str, buckets: int = 256, documents: DataFrame | None = None) -> None:
    """Issues of a run and those that later stages add, in one write; columns that a part lacks are null."""
    for part in more:
        first = first.unionByName(part, allowMissingColumns=True)
    replace_documents(first, folder, buckets, documents)


def write_stage(df: DataFrame, folder: str, stage: str, rule_version: str) -> None:
    """A stage's artifact with its rule version."""
    df.withColumn("rule_version", F.lit(rule_version)).write.mode("overwrite").parquet(f"{folder}/{stage}")


def read_stage(spark: SparkSession, folder: str, stage: str, schema: str) -> DataFrame:
    """A stage's artifact; a missing one has no rows, one that can't be read is an error."""
    path = f"{folder}/{stage}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_runs(runs: DataFrame, earlier: DataFrame) -> DataFrame:
    """Runs with the next attempt of their document and stage."""
    last = earlier.groupBy("document_id", "stage").agg(F.max("attempt").alias("last"))
    return runs.join(last, ["document_id", "stage"], "left").withColumn("attempt", F.coalesce("last", F.lit(0)) + 1).drop("last")


def store_once(df: DataFrame, folder: str) -> None:
    """Write once: an existing folder is an error."""
    df.withColumn("sha256", F.sha2("content", 256)).write.mode("errorifexists").parquet(folder)


def kept(documents: DataFrame, days: int = 90) -> DataFrame:
    """Documents that are not older than the newest one by more than a number of days."""
    return documents.sparkSession.sql(f"SELECT * FROM {{d}} WHERE created_at >= (SELECT max(created_at) FROM {{d}}) - INTERVAL {int(days)} DAYS", d=documents)
