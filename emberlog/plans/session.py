"""Session helpers: a local session for tests, the shared checkpoint folder, task counts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "emberlog", memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="emberlog-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_tasks(spark: SparkSession, times: int = 1) -> int:
    """Number of groups for grouped Python work: follows the session's shuffle partitions, which follow the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * times)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers, where neither their path nor their folder has it: sends it as a zip."""
    root = Path(__file__).resolve().parents[2]
    beside = [os.getcwd()] if is_local(spark) else []  # there the workers start in this folder
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *beside] if p}
    application = spark.sparkContext.applicationId
    if root in known or application in _SHIPPED:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='emberlog-')}/emberlog", "zip", root, "emberlog")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
