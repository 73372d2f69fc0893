"""What every operator needs of a session."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where the driver does; on a cluster that has it installed, this changes nothing."""
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def own_folder(spark: SparkSession) -> str:
    """A folder for sessions without spark.checkpoint.dir, if they run on one machine (as in tests); on a cluster its executors wouldn't see each other's files."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/tidewright-shared"


_written: dict[str, list[str]] = {}


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share (spark.checkpoint.dir; one of our own in a local session without one).

    For tables that several later steps read: each would else compute all of it again. The table survives the loss of executors. Results that
    have yet to be computed may read it; release() removes all of a session's.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark)
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join with another table of documents: both are sorted by the key and merged.

    Spark would go by the size of the files that df comes from. Those of millions of documents may take a few MB, where texts repeat or rows are
    made of a number; their rows would all be gathered on the driver and sent to every executor.
    """
    return df.hint("merge")


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df dealt to as many tasks as Spark uses for shuffles, by the key, so that grouping by it needs no further shuffle.

    A file of a few MB is read by one task, which would also render and split the texts of all its documents.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def release(spark: SparkSession) -> int:
    """Removes the tables that settled() wrote in this application, once no result reads them any more; returns how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
