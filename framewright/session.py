"""Session creation and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "framewright", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session for local use; on a cluster pass the session the cluster gives instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="framewright-")
    return _LOCAL[sc.applicationId]


_LOCAL: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder and read back, so that later steps survive lost executors.

    The table carries its true size into later plans, where a checkpoint would keep an estimate that multiplies with every
    join of an iteration. It is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/framewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned; nothing may read the frame, or what was built on it, any more."""
    _delete(df.sparkSession, df.cut_path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over at least as many partitions as there are cores, for work that is heavy per row.

    Rows are moved only where the files give fewer partitions than that, so a large table is read as it lies. A plan with a shuffle, whose
    partitions are decided as it runs, is left as it is.
    """
    cores, query = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in query.executedPlan().toString():
        return df
    return df if query.toRdd().getNumPartitions() >= cores else df.repartition(cores)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder belongs to the cluster then
        return
