"""Job lifecycle: intake stream, status ladder, expiry, snapshots, retention, keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JOB_HOURS = 24
_STATES = {"scheduled": "pending", "queued": "pending", "running": "processing", "completed": "completed"}


def job_status(state: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in _STATES.items():
        out = out.when(state == k, v)
    return out.otherwise("failed")


def expires_at(created: Column, hours: int = JOB_HOURS) -> Column:
    return created + F.make_interval(hours=F.lit(hours))


def lookup_status(expires: Column, now: Column) -> Column:
    """HTTP-like outcome of a read: 404 unknown, 410 expired, else 200."""
    return F.when(expires.isNull(), 404).when(now > expires, 410).otherwise(200)


def result_status(status: Column) -> Column:
    return F.when(status.isin("pending", "processing"), 425).when(status == "completed", 200).otherwise(500)


def snapshot(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """job_id, status, updated_at: the latest of the four moments that are known."""
    return jobs.join(executions, "job_id").select("job_id", job_status(F.col("state")).alias("status"), F.greatest("created_at", "started_at", "completed_at", "progress_at").alias("updated_at"))


def intake(spark: SparkSession, folder: str, files_per_trigger: int = 1000, delete: bool = False) -> DataFrame:
    """A stream of uploads: path, modificationTime, length, content, job_id; files of one content are one job id."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger)
    if delete:
        reader = reader.option("cleanSource", "delete")
    return reader.load(folder).withColumn("job_id", F.sha2("content", 256))


def retention(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Adds expired: older than `days` by modification time, strictly."""
    return files.withColumn("expired", F.col("modificationTime") < now - F.make_interval(days=F.lit(days)))


def retention_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("scanned"), F.count_if("expired").alias("removed"), F.count_if(~F.col("expired")).alias("skipped"))


class JobState(StatefulProcessor):
    """Latest state of each job from events (job_id, state, at), forgotten after a time to live."""

    def __init__(self, ttl_ms: int = JOB_HOURS * 3_600_000) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string, n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        state, n = self.last.get() if self.last.exists() else ("", 0)
        for part in rows:
            if len(part):
                n += len(part)
                state = part.sort_values("at")["state"].iloc[-1]
        self.last.update((state, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [_STATES.get(state, "failed")], "n_events": [n]})

    def close(self) -> None:
        pass


def live_status(events: DataFrame, ttl_ms: int = JOB_HOURS * 3_600_000) -> DataFrame:
    return events.groupBy("job_id").transformWithStateInPandas(JobState(ttl_ms), outputStructType="job_id string, status string, n_events long", outputMode="Update", timeMode="ProcessingTime")
