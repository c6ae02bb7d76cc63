"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "loam", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here expects; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a private one only where none is set and all runs on one machine (tests)."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(?:\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors reach")
    own = tempfile.mkdtemp(prefix="loam-checkpoint-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Every call writes a folder of its own, so that a retried or repeated query never reads half-written rows. The folder
    lives as long as the driver, since lazy results may still read it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/loam-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # when the driver's JVM ends
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a result whose size has a proven bound; exceeding the bound is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows, though the bound is {most}")
    return rows


def bounded_arrow(df: DataFrame, most: int, what: str):
    """The same as an Arrow table, for results of many rows: rows as objects would take forty times the memory."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"{what}: more than {most} rows, though the bound is {most}")
    return table


def small(df: DataFrame, most: int, what: str) -> DataFrame:
    """A side to broadcast, once it is known to be small: more than ``most`` rows are an error."""
    from pyspark.sql.functions import broadcast

    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows")
    return broadcast(df)


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.sparkContext.defaultParallelism or os.cpu_count() or 1))


def spread(df: DataFrame) -> DataFrame:
    """Rows on all cores, where the scan gives fewer than half as many parts as there are cores (small files).

    Only for rows right from a scan: what has been shuffled is spread as the planner sees fit, and nothing is run here.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if df.isStreaming or "Exchange" in plan.toString():
        return df
    cores = default_parallelism(df.sparkSession)
    return df.repartition(cores) if plan.execute().getNumPartitions() * 2 < cores else df
