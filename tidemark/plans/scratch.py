"""Where jobs may leave intermediate tables, and when a side is small enough to broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one broadcast side may have at most; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes that it may have, as text.
BROADCAST_BYTES = 32 << 20


def steady(spark: SparkSession) -> None:
    """Deal the rows of a union anew before they are grouped.

    A sum over a union came out in parts once where Spark took the union's
    inputs to be partitioned alike; the extra exchange rules that out.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.

    Only where the session names none (tests on one machine) a local folder is
    made, and the session is told about it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block; what it was before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidied(spark: SparkSession):
    """A block whose jobs remove their shuffle files once they have ended well."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that ran on it.
    The job's shuffle files go when the table stands, so that a chain of such
    steps takes the disk of its tables and of the running step only.
    """
    path = new_folder(df.sparkSession, name)
    with tidied(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of stored tables that no frame still in use reads."""
    bare = lambda path: re.sub("/+", "/", path.removeprefix("file:"))
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not bare(folder).startswith(bare(shared_dir(spark))):
                raise ValueError(f"{folder} is no folder of stored()")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and `most_bytes` bytes, else df itself.

    Rows are counted, and bytes are summed up over the values as text, so pass a
    stored or trivially cheap frame.
    """
    size = F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(8)))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most_bytes else df
