"""Session settings and fault-tolerant staging of intermediate tables."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "spark.kipimo.partitions"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` names it.

    Only where one JVM is driver and executors alike (``local`` masters, as in tests)
    does a session without one get a temporary folder; any other is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _local[context.applicationId] = folder
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/kipimo-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's folder in the shared one."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> bool:
    """Remove everything that this application has staged; nothing may read it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there.

    For results that several aggregates read: unlike a cache it survives lost
    executors, and each reader prunes to its own columns.
    """
    path = scratch_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame) -> DataFrame:
    """Spread a compact input before work that multiplies it, if the session asks for it.

    One Parquet row group is one task, however much work each row brings.  Set
    ``spark.kipimo.partitions`` to deal the rows out over that many tasks; unset (large
    inputs have splits enough) the scan's own splits are kept.
    """
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def bound_batches(spark: SparkSession, size: str = "1m") -> None:
    """Let batches for Python end at ``size`` bytes, unless the session has set a bound.

    Spark's own bounds (10,000 rows, 64 MB) are tens of megabytes of text a batch, which
    executors and Python workers hold several times over and do not give back.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)
