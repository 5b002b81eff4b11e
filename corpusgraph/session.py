"""Session set-up and the few run-time helpers the iterative operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured row count stays below this.
BROADCAST_ROWS = 200_000


#: Bytes of a file and of a shuffle that one task reads, and pieces of a shuffle before small ones are merged.
BOUNDED = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


def bounded_tasks(spark: SparkSession) -> None:
    """Tasks of bounded size from now on, however large the tables are.

    Adaptive execution only merges the pieces of a shuffle; with the default
    of 200, or a smaller number, a task's share, and the hash map or the sort
    over it, grows with the tables.
    """
    for key, value in BOUNDED.items():
        spark.conf.set(key, value)


def build_session(app: str = "corpusgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join handling and UTC timestamps switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **BOUNDED,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that outlive executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared folder as Parquet and read back.

    A checkpoint computes its last stage twice and writes whole rows; this
    restarts the plan from compressed columns of known size.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` whose last reader is done; others must not be given."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; stops counting just past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions, over ``least`` if that is more.

    Adaptive execution merges partitions by their bytes.  Where few bytes mean
    much work, as in joins that compare pairs, the number is fixed instead.
    """
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
