"""Progress of runs as a stream: the latest run of each stage, snapshots of documents, the end of each.

The source is a folder of run rows (document, stage, status, progress, time, id). State is kept per
document by the engine; a batch over the same rows gives the same snapshots.

Defined results: rows without a document or stage are left out; of runs with equal times the larger id
counts; a redelivered row changes nothing; stages outside of the declared order come last.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "document_id bigint, stage string, status string, progress int, ts timestamp, run_id bigint"
# Statuses after which a document changes no more, stages in order, and how many stages make a whole.
TERMINAL = ["COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED"]
STAGES = ["EXTRACTING", "TABLE_MATH", "REF_DRIFT", "REVISION", "STANDARDS", "LINGUISTIC", "AGGREGATION"]
WHOLE, UNFINISHED_MOST = 6, 95
SNAPSHOT = "document_id bigint, stages string, percent int, current_stage string, failed_stage string, closed boolean"


def read_runs(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of run rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(RUNS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_runs(runs: DataFrame) -> DataFrame:
    """(document_id, stage, status, progress, ts, run_id): the last run of each stage, as stream (update or complete) or batch."""
    last = F.max_by(F.struct("status", "progress", "ts", "run_id"), F.struct("ts", "run_id")).alias("r")
    return runs.where("document_id IS NOT NULL AND stage IS NOT NULL").groupBy("document_id", "stage").agg(last).select("document_id", "stage", "r.*")


def snapshot(document: int, runs: dict[str, tuple]) -> tuple:
    """The snapshot of a document from the last run of each stage (ts, run_id, status, progress)."""
    place = lambda s: (STAGES.index(s) if s in STAGES else len(STAGES), s)
    stages = sorted(runs, key=place)
    done = sum(r[2] in TERMINAL or r[2] == "SKIPPED" for r in runs.values())
    running = [s for s in runs if runs[s][2] == "RUNNING"]
    newest = lambda some: max(some, key=lambda s: runs[s][:2], default=None)
    closed = "AGGREGATION" in runs and runs["AGGREGATION"][2] in TERMINAL
    percent = 100 if closed else min(UNFINISHED_MOST, round(100 * done / WHOLE))
    listed = json.dumps([{"stage": s, "status": runs[s][2], "progress": runs[s][3]} for s in stages])
    return document, listed, percent, newest(running) or newest(runs), newest([s for s in runs if runs[s][2] == "FAILED"]), closed


def _step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs = {k: tuple(v) for k, v in json.loads(state.get[0]).items()} if state.exists else {}
    if state.hasTimedOut:  # nothing came for long: what runs is given up
        runs = {s: (r[0], r[1], "TIMED_OUT" if r[2] == "RUNNING" else r[2], r[3]) for s, r in runs.items()}
        row = snapshot(key[0], runs)
        state.remove()
        yield pd.DataFrame([(*row[:5], True)], columns=["document_id", "stages", "percent", "current_stage", "failed_stage", "closed"])
        return
    for batch in batches:
        for r in batch.itertuples(index=False):
            new = (r.ts.isoformat(), int(r.run_id), r.status, None if pd.isna(r.progress) else int(r.progress))
            if r.stage is not None and (r.stage not in runs or new[:2] > runs[r.stage][:2]):
                runs[r.stage] = new
    row = snapshot(key[0], runs)
    if row[5]:
        state.remove()
    else:
        state.update((json.dumps(runs),))
        state.setTimeoutDuration(600_000)
    yield pd.DataFrame([row], columns=["document_id", "stages", "percent", "current_stage", "failed_stage", "closed"])


def snapshots(runs: DataFrame) -> DataFrame:
    """A full snapshot of each document whenever one of its runs changes; closed documents and those silent for 600 s end."""
    kept = runs.where("document_id IS NOT NULL AND stage IS NOT NULL")
    return kept.groupBy("document_id").applyInPandasWithState(_step, SNAPSHOT, "runs string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def frames(snapshot_rows: DataFrame) -> DataFrame:
    """(document_id, frame): snapshots as server-sent events."""
    body = F.to_json(F.struct("document_id", "percent", "current_stage", "failed_stage", F.from_json("stages", "array<struct<stage:string,status:string,progress:int>>").alias("stages")))
    event = F.when(F.col("closed"), "end").otherwise("stage")
    return snapshot_rows.select("document_id", F.concat(F.lit("event: "), event, F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))


def write_snapshots(snapshot_rows: DataFrame, folder: str, checkpoint: str, **trigger):
    """The snapshots of each micro-batch as Parquet, replaced when a batch is repeated; trigger as of DataStreamWriter.trigger."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = snapshot_rows.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
