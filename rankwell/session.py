"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on or profit from.  Partition counts are left to
#: adaptive execution: it starts from ``shuffle.partitions`` and merges small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "rankwell", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the session comes from ``spark-submit``; only tests build one here.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    partitions = os.cpu_count() if cores == "*" else int(cores)
    options = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a fresh temporary folder; a
    cluster session is refused, because a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rankwell-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_folder(spark)}/rankwell-{name}-{uuid.uuid4().hex[:12]}"


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are over.

    It does so when the driver's garbage collector finds their plans unreachable, which
    on a quiet driver may take longer than the disks can wait.  For use between large
    steps whose results are written; files that a live plan needs are not touched.
    """
    spark.range(1).collect()  # the session holds on to its last plan: now to this one
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage of ``frame`` with a reliable checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back.

    Keeps columnar pruning for later passes, which a checkpoint does not, and
    survives the loss of any executor.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def written_bucketed(frame: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """As :func:`written`, as a table bucketed by ``keys``, with the table's name.

    Joins on the keys read the buckets as they lie and shuffle the other side only.
    There are as many buckets as shuffle partitions.  The files are in the shared folder;
    drop the table by its name after :func:`discard`.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    table = f"rankwell_{name}_{path[-12:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    return spark.table(table), table


def discard(frame: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        discard_folder(frame.sparkSession, folder)


def drop_files(spark: SparkSession, files: list[str]) -> None:
    """Delete some files of a table made by :func:`written`, which is read in parts."""
    for file in files:
        if file.rsplit("/", 2)[-2].startswith("rankwell-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder named by :func:`scratch_path`; others are left alone."""
    if not folder.rsplit("/", 1)[-1].startswith("rankwell-"):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_counted(
    frame: DataFrame, name: str, test: Column | None = None
) -> tuple[DataFrame, int]:
    """As :func:`written`, with the number of rows (that pass ``test``) seen on the way."""
    seen = Observation()
    count = F.count(F.lit(1)) if test is None else F.count_if(test)
    return written(frame.observe(seen, count.alias("n")), name), seen.get["n"]
