"""Session helpers: a local session for tests and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "fieldproof", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A session for one machine; on a cluster use the session the cluster gives."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("FIELDPROOF_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_checkpoints(spark: SparkSession) -> str:
    """The folder of reliable checkpoints, which all executors share.

    It is spark.checkpoint.dir of the session. Only where that is unset and the session runs on one
    machine, as in tests, a folder of this machine is used; on a cluster it must be set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="fieldproof-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that are written once and read back."""
    return f"{use_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more, as those of earlier rounds of an iteration."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df._jdf.sparkSession().sessionState().newHadoopConf()).delete(path, True)
