"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it names none, a local session gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='turnmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends there and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table over all cores, unless its scan's partitions are so many and so even that no core waits for another.

    A row group is read by one task, whatever the number of partitions that a file is cut into, so the rows of each
    are counted; that reads the files' footers. Large even scans stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    by_part = scan.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    rows, most = by_part.agg(F.sum("n"), F.max("n")).first()
    return scan.repartition(cores if (rows or 0) < 1_000_000 else 4 * cores) if (most or 0) * cores > 2 * (rows or 1) else scan
