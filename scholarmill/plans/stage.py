"""Stage tables: cut lineage with Parquet in the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only in a local session that names none.

    On a cluster without one an executor would write to a disk that no other reads, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scholarmill-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
    return at


_made: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with the stage tables."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(at)
    return at


def clear_stages(spark: SparkSession) -> int:
    """Delete the stage tables made so far, once what was built on them is written; the number of folders."""
    jvm, n = spark.sparkContext._jvm, len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, partition_by: list[str] | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it again.

    The files survive the loss of any executor, and what follows plans with their true size. ``release`` deletes the
    shuffle files of the write as soon as it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if release:
            spark.conf.set(CLEANUP, "true")
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a stage table, as ``stage`` gave it, that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made[:] = [m for m in _made if m.rpartition("/")[2] != folder.rpartition("/")[2]]
