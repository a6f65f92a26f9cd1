"""Session construction and the few settings every entry point shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_spark(app: str = "lexloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local work; on a cluster the submitter's own settings win for master and sizes."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    master = master or os.environ.get("LEXLOOM_MASTER")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("LEXLOOM_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder, read by Spark so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, below: int = 64 << 20) -> DataFrame:
    """A small input dealt over all cores.

    A file of one row group is read by one task, which leaves a row-wise program on one core. Inputs from ``below``
    bytes on come in many splits already and are left alone, so that nothing large is shuffled for this.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name where driver and executors both write: below the checkpoint folder that the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in shared storage, so that later passes read and do not compute them, by the columns they name."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> None:
    """Let executors import this package: once per application, unless PYTHONPATH carries it already.

    The driver serves the archive to the executors, as ``--py-files`` would.
    """
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    carried = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in carried or getattr(context, "_lexloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "lexloom").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    context._lexloom_shipped = True
