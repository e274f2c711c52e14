"""Session settings and the one way lineage is cut in this library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roadloom", cores: str | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if "MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or '*'}]")
    return (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a session in one process (tests, the bench) makes
    one; on a cluster that is an error, since executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, instead_of: DataFrame | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there, so that a lost executor costs no lineage.

    A table that is read has sizes of its own. A checkpointed plan keeps the estimates of the plan behind it, and in a loop
    of joins these multiply with each round until planning takes longer than the work. ``instead_of`` is an earlier frame
    of this function that nothing reads any more; its files go, so a loop leaves one table and not one for each round.
    ``partition_by`` names columns of which each value gets a folder, so that a round can read its own part alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frame-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._frame_path = path
    old = getattr(instead_of, "_frame_path", None) if instead_of is not None else None
    if old:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def dealt(df: DataFrame, per_core: int = 4) -> DataFrame:
    """``df`` in a number of partitions for each core, whatever its size: for rows that are few bytes and much work, which
    a scan would leave to the one or two tasks that read them."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)
