"""Tables in the folder that all machines share, and joins whose small side is measured."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured payload is at most this many bytes.
BROADCAST_BYTES = 24 * 1024 * 1024
#: Whether a query's shuffle files are deleted as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share, from ``spark.checkpoint.dir``.

    Only a session on one machine gets a temporary folder where that is unset; on a
    cluster it is an error, as other machines would not see the files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, replaces: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran, and values
    such as ``monotonically_increasing_id()`` are fixed once written. ``replaces`` are
    stored tables that nothing reads any more; they are deleted. So are the shuffle files
    of the write once it is through, which would else stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    for old in replaces:
        if at := getattr(old, "stored_at", None):
            folder = spark._jvm.org.apache.hadoop.fs.Path(at)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return found


def payload(table: DataFrame, row_bytes: int, texts: Sequence[str] = ()) -> int:
    """Bytes of a stored table: so many per row, and the length of its text columns."""
    sizes = [F.coalesce(F.sum(F.octet_length(F.col(c)).cast("long")), F.lit(0)) for c in texts]
    row = table.agg(F.count(F.lit(1)), *sizes).first()
    return row[0] * row_bytes + sum(row[1:])


def size_checked(table: DataFrame, row_bytes: int, texts: Sequence[str] = (), limit: int = BROADCAST_BYTES, beyond: str = "merge") -> DataFrame:
    """``table``, marked for broadcast if its measured payload is within ``limit``.

    Beyond it the join is left to a shuffle, where adaptive execution splits hot keys. For a
    table of distinct keys that meets a much larger one, ``beyond`` may be "shuffle_hash":
    then its share of a partition is held and the larger side is not sorted.
    """
    return F.broadcast(table) if payload(table, row_bytes, texts) <= limit else table.hint(beyond)
