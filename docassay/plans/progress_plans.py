"""Queries of the progress stream, run over the event table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import progress


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Events as runs: users as documents, event types as stages."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("value") > 50, "COMPLETED").otherwise("RUNNING")
    return table(s, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), status.alias("status"), F.least(F.lit(100), F.col("value").cast("int")).alias("progress"), "ts", F.col("event_id").alias("run_id"))


def queries() -> dict:
    return {"str3_latest_runs": lambda s, d: progress.latest_runs(_runs(s, d)).select("document_id", "stage", "status", "run_id")}


def oracle_sql() -> dict:
    return {
        "str3_latest_runs": "SELECT user_id AS document_id, event_type AS stage, CASE WHEN event_type = 'error' THEN 'FAILED' WHEN value > 50 THEN 'COMPLETED' ELSE 'RUNNING' END AS status, event_id AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1",
    }
