"""Submissions, stored job rows, point reads, purges, and what a run reports about itself."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import formats
from vellumflow.plans import schema as S
from vellumflow.streaming import jobs

_SCHEMA_CHECK = T.StructType([T.StructField("code", T.StringType()), T.StructField("problem", T.StringType())])


def _schema_problem(text: str) -> tuple[str | None, str | None]:
    try:
        parsed = json.loads(text)
    except ValueError as e:
        return "E2004", f"Invalid JSON in schema: {e}"
    found = S.problems(parsed)
    return ("E2001", "Invalid JSON Schema: " + "; ".join(found)) if found else (None, None)


@F.pandas_udf(_SCHEMA_CHECK)
def _checked_schema(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_schema_problem(t) if t is not None else ("E2002", "A schema must be provided") for t in texts], columns=_SCHEMA_CHECK.names)


def submissions(uploads: DataFrame, limit_mb: int = formats.UPLOAD_LIMIT_MB) -> DataFrame:
    """Uploads (name, length, schema_text, schema_file_text, redact_output) judged: adds job_id, landed_as, schema_as, code, error_code, error.

    code is 202 for an accepted upload, 413 for one above the limit, 400 for a missing, unreadable or
    invalid schema. A schema given as text wins over one given as a file. Only accepted uploads have a
    job id, a random one, so that equal uploads are jobs of their own."""
    once = _checked_schema.asNondeterministic()
    said = uploads.withColumn("schema", F.coalesce("schema_text", "schema_file_text"))
    judged = said.withColumn("_s", once("schema"))
    large = ~formats.accepted_size(F.col("length"), limit_mb)
    error_code = F.when(F.col("name").isNull() | (F.col("name") == ""), "E1001").when(large, "E1002").otherwise(F.col("_s.code"))
    error = F.when(F.col("name").isNull() | (F.col("name") == ""), "A document file must be provided").when(large, F.format_string(f"File exceeds {limit_mb} MB: %d bytes", "length")).otherwise(F.col("_s.problem"))
    marked = judged.withColumn("error_code", error_code).withColumn("error", error).drop("_s")
    code = F.when(F.col("error_code") == "E1002", 413).when(F.col("error_code").isNotNull(), 400).otherwise(202)
    fresh = marked.withColumn("code", code).withColumn("job_id", F.when(F.col("error_code").isNull(), F.uuid()))
    return fresh.withColumn("landed_as", F.concat("job_id", F.coalesce(formats.extension(F.col("name")), F.lit("")))).withColumn("schema_as", F.concat("job_id", F.lit("_schema.json")))


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def stored_row(row: Mapping[str, Column] | None = None) -> Column:
    """A job row as a map of texts, the form a key-value store holds: moments in ISO form, flags as 'true' or 'false'."""
    c = row or {n: F.col(n) for n in ("job_id", "filename", "file_path", "schema_path", "redact_output", "created_at", "expires_at")}
    texts = {n: c[n].cast("string") for n in ("job_id", "filename", "file_path", "schema_path")} | {"redact_output": F.when(c["redact_output"], "true").otherwise("false"), "created_at": _iso(c["created_at"]), "expires_at": _iso(c["expires_at"])}
    return F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])


def read_row(stored: Column) -> Column:
    """The job row of a stored map; a missing flag is false."""
    at = lambda n: F.element_at(stored, n)
    return F.struct(*[at(n).alias(n) for n in ("job_id", "filename", "file_path", "schema_path")], (F.coalesce(at("redact_output"), F.lit("false")) == "true").alias("redact_output"), F.to_timestamp(at("created_at")).alias("created_at"), F.to_timestamp(at("expires_at")).alias("expires_at"))


def created(uploads: DataFrame, now: Column, hours: int = jobs.JOB_HOURS) -> DataFrame:
    """Accepted submissions as new job rows."""
    return uploads.filter("code = 202").select("job_id", F.col("name").alias("filename"), F.col("landed_as").alias("file_path"), F.col("schema_as").alias("schema_path"), "redact_output", now.alias("created_at"), jobs.expires_at(now, hours).alias("expires_at"))


def point_reads(wanted: DataFrame, table: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, table afterwards): job_id, code and the row where the code is 200; reading an expired job deletes it."""
    rest = [c for c in table.columns if c != "job_id"]
    joined = wanted.select("job_id").join(table.withColumn("_there", F.lit(True)), "job_id", "left").withColumn("code", jobs.lookup_status(F.col("expires_at"), now))
    answers = joined.select("job_id", "code", *[F.when(F.col("code") == 200, F.col(c)).alias(c) for c in rest])
    gone = joined.filter("code = 410").select("job_id").distinct()
    return answers, table.join(gone, "job_id", "left_anti")


def result_answers(jobs_table: DataFrame, results: DataFrame) -> DataFrame:
    """job_id, code, result: 425 while a job goes on, 500 for a failed one, its result with 200 otherwise."""
    joined = jobs_table.join(results.select("job_id", "result"), "job_id", "left").withColumn("code", jobs.result_status(F.col("status")))
    return joined.select("job_id", "code", F.when(F.col("code") == 200, F.col("result")).alias("result"))


def purged(spark: SparkSession, files: DataFrame, now: Column, days: int) -> dict[str, int]:
    """Deletes files (path, modificationTime) older than `days`; counts scanned, removed, skipped, errors.

    The list is walked on the driver row by row, never held: deleting is the file system's work."""
    marked = jobs.retention(files.select("path", "modificationTime"), now, days)
    counts = {"scanned": 0, "removed": 0, "skipped": 0, "errors": 0}
    kept = marked.agg(F.count("*").alias("n"), F.count_if(~F.col("expired")).alias("k")).first()
    counts["scanned"], counts["skipped"] = kept["n"], kept["k"]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for row in marked.filter("expired").select("path").toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        try:
            counts["removed" if path.getFileSystem(hadoop).delete(path, False) else "errors"] += 1
        except Exception:  # noqa: BLE001 - any failure of the store is an error of this file
            counts["errors"] += 1
    return counts


# ---- what a run reports -------------------------------------------------------------------
def log_line(message: str, **said: Any) -> str:
    return f"{message} | {', '.join(f'{k}={v}' for k, v in said.items())}" if said else message


@dataclass
class Metrics:
    """Durations and counts of one operation."""

    operation: str
    started: float = field(default_factory=time.monotonic)
    seconds: float | None = None
    succeeded: bool | None = None
    counts: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, value: float = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + value


@contextmanager
def timed(operation: str) -> Iterator[Metrics]:
    """Metrics of a block: its duration, and whether it ended without an error."""
    m = Metrics(operation)
    try:
        yield m
        m.succeeded = True
    except BaseException:
        m.succeeded = False
        raise
    finally:
        m.seconds = time.monotonic() - m.started


@dataclass
class Progress:
    """Steps done of a known number."""

    total: int
    done: int = 0
    message: str = ""

    def step(self, message: str = "", n: int = 1) -> str:
        self.done, self.message = min(self.total, self.done + n), message
        share = 100.0 * self.done / self.total if self.total else 100.0
        return log_line(message, done=self.done, total=self.total, percent=round(share, 1))
