"""Session factory used by tests, the bench and ad-hoc runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/timeweave-scratch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``; a local session without one, as in tests, has its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def own_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else has; what is there goes when the application ends."""
    path = f"{shared_folder(spark)}/timeweave/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written as Parquet to the shared folder and read back, so that what follows doesn't compute or plan them again."""
    path = own_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session on ``local[cpus]`` with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("timeweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it by path."""
    import os
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == root:
        return
    context = spark.sparkContext
    if not getattr(context, "_timeweave_shipped", False):
        into = tempfile.mkdtemp()
        shutil.copytree(root / "timeweave", f"{into}/src/timeweave", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{into}/timeweave-package", "zip", f"{into}/src"))
        context._timeweave_shipped = True
