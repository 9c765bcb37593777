"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below the one that ``spark.checkpoint.dir`` names for driver and executors.

    Only where no such folder is set on a single machine, as in tests, a temporary one is made.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="pellucid-"))
    root = context.getCheckpointDir().rstrip("/")
    return f"{root}/pellucid-{uuid.uuid4().hex}"


#: What an Arrow batch of a step that is written holds at most, so that workers stay small.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again, which cuts its lineage.

    Lost executors then cost the unfinished step alone, and later steps read only the columns they use.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}.parquet"
    before = {name: spark.conf.get(name) for name in _BATCH}
    for name, value in _BATCH.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(col) -> F.Column:
    """A text column's UTF-8 bytes, a missing text being empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


WORD_PATTERN = r"[^\x20\x09-\x0D]+"
