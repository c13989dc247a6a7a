"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on: one time zone, adaptive execution, and the package on the
    workers, whatever folder the application was started from."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, unless their path has it."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    known = (os.environ.get("PYTHONPATH", "").split(os.pathsep), str(package.parent))
    if known[1] in known[0] or str(package).endswith(".zip/tapework") or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    # The driver serves the archive from here to the executors until the application ends.
    folder = tempfile.mkdtemp(prefix="tapework-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = shutil.copytree(package, f"{folder}/in/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", Path(base).parent))


def local_session(cpus: str = "8", app: str = "tapework") -> SparkSession:
    """Single-machine session for tests and timing runs."""
    return configure(
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Recording a call site for every column expression slows the building of wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only on a local master that has none.

    On a cluster every executor would write a temporary folder to its own disk, so that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tapework-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write an intermediate result once and read it back.

    Several operators read their input more than once (slot counts and rows, block totals and
    rows). Writing the input to the shared folder keeps the number of source scans at one, keeps
    column pruning for the later reads, and lets lost executors restart from files instead of
    from the start of the lineage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
