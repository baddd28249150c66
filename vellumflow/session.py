"""Session, table access and the few physical-layout helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are never more than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def local_session(cores: int = 8, name: str = "vellumflow") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Balance a scan's rows over the cores before heavy per-row work.

    A small table is one file and so one task; only then is the shuffle worth it. Rows are
    hashed on the given id columns, so a recomputed task sees the same rows. `scan` has narrow
    steps only: behind a shuffle the count of partitions would run the query, so that is an error.
    """
    if scan._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        raise ValueError("spread takes a scan, before any shuffle")
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, by: str, sizes: DataFrame, distinct: bool = False) -> DataFrame:
    """Left join of rows to one lookup row per key, a hot key's rows spread over as many tasks as they are worth.

    sizes: key, n (its rows), cheap to read again. Only keys with more than `HOT_SHARE` of all rows are
    salted, so their list is bounded whatever the data; only their lookup rows are repeated, once a
    salt. `by` names a high-cardinality column of rows. distinct: whole copies of rows count once,
    for which the join's own partitioning serves."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(sizes.filter(F.col("n") > total * HOT_SHARE).select(key, F.ceil(F.col("n") * 2.0 * parts / max(total, 1)).cast("int").alias("_salts")))
    own = F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("_salts", F.lit(1)))  # nulls meet nothing, so any place will do
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), own).cast("int")).drop("_salts")
    right = lookup.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    left = left.repartition(key, "_salt").distinct() if distinct else left
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder: spark.checkpoint.dir, or the one already given; a local one only on a single machine."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "vellumflow-checkpoints"))
        given = context._jsc.sc().getCheckpointDir()
    return given.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage by a written table in the shared folder, for what is read column by column; removed with the session's end."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)

