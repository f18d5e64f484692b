"""Session settings the operators rely on."""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: str = "8", app: str = "pagemill", memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere, and send the package to its Python workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Workers unpickle functions by module name, so they need the package wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    built = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/pagemill", "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(built)  # Spark copies it to every executor


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. One is made only on a local master, as in tests: executors
    of a cluster do not see a folder of the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has: a counter alone begins anew when the package is loaded again in the same
    application, and streams would go on from the checkpoints they find there."""
    return f"{scratch_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: executors may be lost afterwards."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_written = itertools.count()


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back: computed once, and later reads take only their columns."""
    path = f"{scratch_folder(df.sparkSession).rstrip('/')}/{name}-{next(_written)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
