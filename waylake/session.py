"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions that this library opens itself (tests, bench). A cluster brings its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def open_session(master: str = "local[*]", app: str = "waylake", **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` adds to or replaces them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir`` of the session; only where none is set (tests) a local one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waylake-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, tasks_per_core: int = 1) -> DataFrame:
    """``df`` in enough partitions to occupy every core, for work that is heavy for its bytes.

    Small files make few input splits, and unions uneven ones; only where there are fewer than ``tasks_per_core``
    for each core are rows dealt out again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2 * tasks_per_core) if df.rdd.getNumPartitions() < cores * tasks_per_core else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_waylake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Beside the checkpoints if that folder is a file system's; the driver serves the archive to the executors.
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
    archive = os.path.join(tempfile.mkdtemp(prefix="waylake-", dir=shared if shared.startswith("/") else None), "waylake-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._waylake_shipped = True
