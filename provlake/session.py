"""Session settings and the shared folders that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. Sizes (shuffle partitions, memory) are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "provlake", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once a session, so that they need no path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_provlake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # it already runs from a shipped archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="provlake-ship-"), "provlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._provlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only on a local master, where all tasks see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="provlake-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; every call gives another one."""
    return f"{shared_dir(spark).rstrip('/')}/provlake/{name}-{uuid.uuid4().hex}"


#: Rows that a task of a scan should take, about, and the file size below which they are not counted.
TASK_ROWS, UNCOUNTED = 100_000, 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that yields fewer partitions than cores one partition per core, and one whose
    partitions would hold more than ``TASK_ROWS`` rows as many as that takes.

    Row groups cannot be cut, and few of them hold tables of short rows: what is computed from such a
    row costs far more than to move it. Other tables are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    parts = plan.toRdd().getNumPartitions()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    tasks = -(-df.count() // TASK_ROWS) if size >= UNCOUNTED else 0
    if parts < cores or parts < tasks:
        return df.repartition(max(cores, tasks))
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (executors may be lost) and forget how it was made."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``df``, already materialised, without the size that Spark guessed for it.

    The guess starts from a compressed file and reaches through checkpoints, and a join would broadcast
    by it what is many times as large. Without it only sizes measured at a shuffle lead to a broadcast.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)
