"""Size checks and lineage pinning.

Nothing in this package broadcasts or sorts a whole group in one task on faith.
``is_small`` bounds a frame by the bytes its leaf scans can read at most; every
plan that is only safe for bounded input asks it first and has a distributed
alternative otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES_KEY = "podium.small.bytes"
SMALL_BYTES_DEFAULT = 256 * 1024 * 1024
UNKNOWN_BYTES = 1 << 62
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def input_bytes(df: DataFrame) -> int:
    """Upper bound on the bytes the leaf scans of ``df`` read (unknown counts as huge)."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return UNKNOWN_BYTES
    leaves = jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes()))
               for i in range(leaves.size()))


def small_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(SMALL_BYTES_KEY, str(SMALL_BYTES_DEFAULT)))


def is_small(df: DataFrame) -> bool:
    """True when everything ``df`` derives from fits comfortably in one task."""
    return input_bytes(df) <= small_limit(df.sparkSession)


def bounded_parts(df: DataFrame, size: int) -> int:
    """Partitions, so that each holds what about ``size`` bytes of the leaf scans make; the session's number at least."""
    least, known = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if known >= UNKNOWN_BYTES else max(least, -(-known // size))


def broadcast_if_small(df: DataFrame, limit: int = 32 * 1024 * 1024) -> DataFrame:
    """Hint a broadcast only when the bound on the input proves it harmless."""
    return F.broadcast(df) if input_bytes(df) <= limit else df


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared directory of the session (a local one only in local mode), removed when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="spark-podium-")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later branches see identical rows, lineage ends there (a lost executor re-reads files), and the
    files give the next size check an exact answer.  What was shuffled on the way goes with the write, as nothing reads it again.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession, "pin")
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)
